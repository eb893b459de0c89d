"""All-text export frames derived from the fixture views, with spoiled cells.

They stand in for uploaded files in the registered ingest queries: each
view column is renamed to its export header and cast to text, then cells are
spoiled by a rule on the row key so every cleaning path is exercised:
blank text (key % 11), text padded with two blanks each side (key % 10),
``n/a`` in number cells (key % 13), ``2024-13-40`` in date cells (key % 17),
and every cell empty (key % 101: the row must vanish).  An extra
``Row key`` column is an unknown header the mapping must ignore.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from upkeep.session import limit_methods
from upkeep.sources import fixtures as fx
from upkeep.sources.ingest import Export

# (header, source expression name or callable, cell class) per export; classes: t text, n number, d date, k key
RAW_LAYOUTS = {
    "notifications": [
        ("Notifictn type", "notif_type", "t"), ("Notif.date", "notif_date", "d"),
        ("Notification", "notification", "t"), ("System status", "system_status", "t"),
        ("Req. start", "req_start", "d"), ("Required End", "required_end", "d"),
        ("Main WorkCtr", "main_workctr", "t"), ("Planner group", "planner_group", "t"),
        ("Description", "description", "t"), ("Order", "order_no", "t"), ("Location", "location", "t"),
        ("Functional Loc.", "functional_loc", "t"), ("Equipment", "equipment", "t"),
        ("Criticallity", "criticality", "t"), ("MaintPlant", "maint_plant", "t"),
        ("Long text", "long_text", "t"), ("Row key", "key", "k"),
    ],
    "work_orders": [
        ("Plant", "plant", "t"), ("Created on", "created_on", "d"), ("Bas. start date", "bas_start_date", "d"),
        ("Basic fin. date", "basic_fin_date", "d"), ("Order", "order_no", "t"),
        ("Description", "description", "t"), ("Location", "location", "t"),
        ("Functional Loc.", "functional_loc", "t"), ("Equipment", "equipment", "t"),
        ("Criticallity", "criticality", "t"), ("System status", "system_status", "t"),
        ("Planner group", "planner_group", "t"), ("TotalPlnndCosts", "total_plan_cost", "n"),
        ("Total act.costs", "total_act_cost", "n"), ("Main WorkCtr", "main_workctr", "t"),
        ("PO number", "po_number", "t"), ("Actual Finish", "actual_finish", "d"),
        ("Actual release", "actual_release", "d"), ("Order Type", "order_type", "t"),
        ("Priority", "priority", "t"), ("Res./Purc. req.", "purc_req", "t"), ("Row key", "key", "k"),
    ],
    "bom": [
        ("Equipment", "equipment", "t"), ("Description", "equipment_desc", "t"), ("Component", "component", "t"),
        ("Description", "component_desc", "t"), ("Quantity", "quantity", "n"),
        ("BOM category", "bom_category", "t"), ("Item text", "component_desc", "t"),
        ("ITEM TEXT", "equipment_desc", "t"), ("Row key", "key", "k"),
    ],
    "cost_lines": [
        ("Project Definition", "project_definition", "t"), ("Posting Date", "posting_date", "d"),
        ("Order", "order_no", "t"), ("Val.in rep.cur.", "val_in_rep_cur", "n"),
        ("WBS Element", "wbs_element", "t"), ("Cost Element", "cost_element", "t"), ("Row key", "key", "k"),
    ],
    # Matches no export kind: must be skipped.
    "asset_status": [("Tag", "tag", "t"), ("Status", "status_a", "t"), ("Row key", "key", "k")],
}


def _extra(view: str) -> dict[str, Column]:
    """Columns an export has that the view lacks, and the spoil key."""
    if view == "notifications":
        return {"long_text": F.when(F.col("has_long_text"), F.lit("X")), "key": F.col("id")}
    if view == "work_orders":
        return {"key": F.split(F.col("id"), "-").getItem(1).cast("bigint")}
    if view == "bom":
        return {"bom_category": F.lit("M"), "key": F.col("id")}
    if view == "cost_lines":
        return {"wbs_element": F.concat(F.lit("W-"), F.col("project_definition")),
                "cost_element": F.lit("400000"), "key": F.col("id")}
    return {"key": F.col("id")}


def spoil(v: Column, k: Column, cls: str) -> Column:
    text = v.cast("string")
    if cls == "t":
        cell = F.when(k % 11 == 0, F.lit("")).when(k % 10 == 0, F.concat(F.lit("  "), text, F.lit("  "))) \
                .otherwise(text)
    elif cls == "n":
        cell = F.when(k % 13 == 0, F.lit("n/a")).otherwise(text)
    elif cls == "d":
        cell = (F.when(k % 17 == 0, F.lit("2024-13-40")).when(k % 19 == 0, F.lit("2024-5"))
                .when(k % 23 == 0, F.concat(text, F.lit(" junk"))).when(k % 29 == 0, F.lit("2024"))
                .when(k % 31 == 0, F.concat(text, F.lit(" 10:30:00"))).otherwise(text))
    else:
        cell = text
    return F.when(k % 101 == 0, F.lit(None).cast("string")).otherwise(cell)


def raw_export(spark: SparkSession, sf_dir: str, view: str) -> Export:
    """The spoiled all-text export of a fixture view."""
    limit_methods(spark)
    base = fx.view(spark, sf_dir, view)
    extra = _extra(view)
    base = base.select("*", *[e.alias(n) for n, e in extra.items() if n not in base.columns])
    layout = RAW_LAYOUTS[view]
    k = F.col("key")
    cells = [spoil(F.col(src), k, cls).alias(f"c{i}") for i, (_, src, cls) in enumerate(layout)]
    return Export(f"{view}_export", base.select(*cells), tuple(h for h, _, _ in layout))
