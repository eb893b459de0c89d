"""A small reference model of the join aggregates over plain rows.

A blank key is a missing one.  ``n`` and ``w`` are lists of dicts (notifications, work orders).  Pairs are
really paired, one by one, so this is for small inputs.
"""

from collections import Counter, defaultdict


def _words(row):
    text = (row["system_status"] or "").lower()
    return {x for x in ("crtd", "rel", "teco", "clsd") if x in text}


def _by(rows, column):
    out = defaultdict(list)
    for r in rows:
        if r[column]:
            out[r[column]].append(r)
    return out


def funnel_tail(n, w):
    orders, tally = _by(w, "order_no"), Counter()
    for a in n:
        for b in orders.get(a["order_no"], ()) if a["order_no"] else ():
            tally["rel"] += "rel" in _words(b)
            tally["done"] += bool(_words(b) & {"teco", "clsd"})
    return [(tally["rel"], tally["done"])]


def overdue(n, w, as_of):
    orders, tally = _by(w, "order_no"), Counter()
    for a in n:
        if a["required_end"] is None or a["required_end"] >= as_of:
            continue
        for b in orders.get(a["order_no"]) or [None]:
            words = _words(b) if b else set()
            stage = "teco" if words & {"teco", "clsd"} else "rel" if "rel" in words else "crtd"
            tally[a["notif_type"], stage if a["order_no"] else "no_wo"] += 1
    return [(*k, c) for k, c in tally.items()]


def lead_time(n, w):
    orders, waits = _by(w, "order_no"), defaultdict(list)
    for a in n:
        if a["notif_date"] and a["notif_type"] in ("M1", "M2", "M3") and a["criticality"] in ("H", "M", "L"):
            for b in orders.get(a["order_no"], ()):
                if b["created_on"] and b["created_on"] >= a["notif_date"]:
                    waits[a["notif_type"], a["criticality"]].append((b["created_on"] - a["notif_date"]).days)
    # Halves round up, as for non-negative decimals.
    return [(*k, (2 * sum(v) + len(v)) // (2 * len(v)), len(v)) for k, v in waits.items()]


def bad_actors(n, w, least, top):
    stuck = Counter(b["equipment"] for b in w if "rel" in _words(b) and b["actual_finish"] is None)
    often = Counter(a["equipment"] for a in n if a["equipment"])
    best = sorted(((-c, e) for e, c in often.items() if c >= least))[:top]
    return [(e, -c, stuck[e]) for c, e in best]
