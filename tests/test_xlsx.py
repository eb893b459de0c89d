"""Workbook exports: typed cells, odd workbooks, and whole ingests."""

import datetime as dt
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from upkeep.sources import ingest as I
from upkeep.sources import xlsx as X
from upkeep.sources.raw_exports import raw_export

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheet, strings="", styles="", pr="", views="", sheets=("sheet1.xml",), more=None):
    """A hand-written workbook; its parts lie where other programs may put them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("_rels/.rels", f'<Relationships {REL}><Relationship Id="a" Type="{OFFICE}/officeDocument" Target="/book/wb.xml"/></Relationships>')
        entries = "".join(f'<sheet name="S{i}" sheetId="{i + 1}" r:id="s{i}"/>' for i in range(len(sheets)))
        z.writestr("book/wb.xml", f'<workbook {NS} xmlns:r="{OFFICE}">{pr}{views}<sheets>{entries}</sheets></workbook>')
        links = "".join(f'<Relationship Id="s{i}" Type="{OFFICE}/worksheet" Target="{t}"/>' for i, t in enumerate(sheets))
        z.writestr("book/_rels/wb.xml.rels", f'<Relationships {REL}>{links}<Relationship Id="x" Type="{OFFICE}/sharedStrings" Target="../common/st.xml"/>'
                   f'<Relationship Id="y" Type="{OFFICE}/styles" Target="/book/sty.xml"/></Relationships>')
        if strings:
            z.writestr("common/st.xml", f"<sst {NS}>{strings}</sst>")
        if styles:
            z.writestr("book/sty.xml", f"<styleSheet {NS}>{styles}</styleSheet>")
        z.writestr("book/sheet1.xml", f"<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")
        for name, body in (more or {}).items():
            z.writestr(name, body)
    return out.getvalue()


STYLES = ('<numFmts><numFmt numFmtId="164" formatCode="dd\\.mm\\.yyyy"/><numFmt numFmtId="165" formatCode="&quot;day&quot; 0.00"/>'
          '<numFmt numFmtId="166" formatCode="[h]:mm"/><numFmt numFmtId="167" formatCode="[Red]0;[Blue]yyyy"/>'
          '<numFmt numFmtId="168" formatCode="[$-407]d. mmm"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs>'
          '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="166"/>'
          '<xf numFmtId="167"/><xf numFmtId="168"/></cellXfs>')


def cells(data):
    return list(X.Workbook(data).rows())


def test_cells_have_their_kinds():
    strings = "<si><t>plain</t></si><si><r><t>in </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si><si/>"
    sheet = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AB1" t="inlineStr"><is><t>x</t></is></c></row>'
             '<row r="4"><c t="n"><v>12</v></c><c><v>1.50</v></c><c><v>1E3</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c>'
             '<c t="str"><f>A1</f><v>made</v></c><c t="d"><v>2001-02-03T04:05:06</v></c><c/><c t="s"><v>2</v></c></row>')
    first, second = cells(book(sheet, strings))
    assert first[0] == 1 and second[0] == 4
    assert first[1] == [("s", "plain"), None, ("s", "in runs"), *[None] * 24, ("s", "x")]
    assert second[1] == [("n", "12"), ("n", "1.5"), ("n", "1000.0"), ("b", "True"), ("e", "#N/A"), ("s", "made"),
                         ("d", "2001-02-03 04:05:06"), None, ("s", "")]


@pytest.mark.parametrize("style,raw,want", [
    (0, "36896", ("n", "36896")), (1, "36896", ("d", "2001-01-05 00:00:00")), (2, "36896.5", ("d", "2001-01-05 12:00:00")),
    (3, "36896", ("n", "36896")), (4, "1.5", ("n", "1.5")), (5, "36896", ("n", "36896")), (6, "59", ("d", "1900-02-28 00:00:00")),
    (1, "1", ("d", "1900-01-01 00:00:00")), (1, "61", ("d", "1900-03-01 00:00:00")), (1, "0.25", ("t", "06:00:00")),
    (1, "99999999999", ("e", "#VALUE!"))])
def test_dates_come_from_formats(style, raw, want):
    assert cells(book(f'<row><c s="{style}"><v>{raw}</v></c></row>', styles=STYLES))[0][1] == [want]


def test_date_system_and_active_sheet():
    data = book('<row><c s="1"><v>0.5</v></c></row>', styles=STYLES, pr='<workbookPr date1904="1"/>',
                views='<bookViews><workbookView activeTab="1"/></bookViews>', sheets=("sheet1.xml", "/elsewhere/two.xml"),
                more={"elsewhere/two.xml": f'<worksheet {NS}><sheetData><row><c s="1"><v>35434</v></c></row></sheetData></worksheet>'})
    assert cells(data) == [(1, [("d", "2001-01-05 00:00:00")])]


def test_written_workbooks_read_back():
    rows = [["a", "b & <c>"], [1, -2.5], [True, None], [dt.date(2001, 1, 5), dt.datetime(1999, 12, 31, 23, 59, 58)], ["  x\n", "\x01é"], []]
    got = [[c and c for c in row] for _, row in cells(X.workbook_bytes(rows))]
    assert got == [[("s", "a"), ("s", "b & <c>")], [("n", "1"), ("n", "-2.5")], [("b", "True"), None],
                   [("d", "2001-01-05 00:00:00"), ("d", "1999-12-31 23:59:58")], [("s", "  x\n"), ("s", "é")], []]


def test_a_workbook_makes_the_same_table_as_its_export(spark, tmp_path):
    ex = raw_export(spark, SF_SMALL, "work_orders")
    rows = ex.raw.collect()

    def cell(v):
        try:
            return dt.datetime.fromisoformat(v) if v and v[4:5] == "-" and len(v) in (10, 19) else v
        except ValueError:
            return v

    path = tmp_path / "orders.xlsx"
    path.write_bytes(X.workbook_bytes([ex.headers, *([cell(v) for v in r] for r in rows)]))
    root, stamp = str(tmp_path / "lake"), dt.datetime(2001, 7, 1)
    out = I.ingest_files(spark, [str(path)], "B1", root, uploaded_at=stamp).first()
    want = I.clean_export(ex, "B1", stamp)
    got = spark.read.parquet(f"{root}/work_orders").select(want.columns)
    assert (out.status, out.kind, out.rows) == ("ok", "work_order", want.count())
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_typed_cells_follow_the_columns(spark, tmp_path):
    header = ["Notifictn type", "Notif.date", "Notification", "Order", "Long text", "Description"]
    rows = [header, ["M1", dt.date(2001, 1, 5), 10001, 4711.0, True, "  pump "], ["M2", "2001-01-06", 10002, None, 1, dt.date(2001, 1, 7)],
            [None] * 6, ["M3", 36896, "10003", "", "x", None], [None] * 6 + ["beyond"]]
    path = tmp_path / "n.xlsx"
    path.write_bytes(X.workbook_bytes(rows))
    ex = I.read_xlsx_export(spark, str(path))
    assert ex.kind == "notification"
    got = I.clean_export(ex, "B").collect()
    by = {r.notification: r for r in got}
    assert len(got) == 4 and by[None].notif_type is None           # a cell beyond the header keeps its row
    assert (by["10001"].notif_date, by["10001"].order_no, by["10001"].has_long_text, by["10001"].description) == (
        dt.date(2001, 1, 5), "4711.0", True, "pump")
    # A text or plain number in a date column is no date; a date in a text column is its text.
    assert by["10002"].notif_date is None and by["10002"].has_long_text and by["10002"].description == "2001-01-07 00:00:00"
    assert by["10003"].notif_date is None and by["10003"].order_no is None
    cost = tmp_path / "c.xlsx"
    cost.write_bytes(X.workbook_bytes([["Project Definition", "WBS Element", "Cost Element", "Val.in rep.cur."], ["p", "w", "c", 0.285],
                                       ["p", "w", "c", True], ["p", "w", "c", "n/a"], ["p", "w", "c", dt.date(2001, 1, 1)]]))
    values = [r.val_in_rep_cur for r in I.clean_export(I.read_xlsx_export(spark, str(cost)), "B").collect()]
    assert sorted(map(str, values)) == ["0.29", "1.00", "None", "None"]


def test_outcomes_of_odd_workbooks(spark, tmp_path):
    header = ["Notifictn type", "Notification"]
    broken = bytearray(X.workbook_bytes([header] + [["M1", f"{i:06}"] for i in range(9000)]))
    broken[len(broken) // 2] ^= 0xFF
    files = {"good.xlsx": X.workbook_bytes([header, ["M1", "1"], ["M2", 2]]), "more.xlsx": X.workbook_bytes([header, ["M1", "3"]]),
             "head.xlsx": X.workbook_bytes([header]), "empty.xlsx": X.workbook_bytes([]), "other.xlsx": X.workbook_bytes([["Foo"], [1]]),
             "text.xlsx": b"no zip", "cut.xlsx": X.workbook_bytes([header, ["M1", "1"]])[:-200], "broken.xlsx": bytes(broken),
             "long.xlsx": X.workbook_bytes([header, ["M1-TOO-LONG-TYPE", "9"]]), "blank.xlsx": X.workbook_bytes([[None], header])}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    paths = [str(tmp_path / name) for name in [*files, "missing.xlsx"]]
    out = {os.path.basename(r.file): (r.status, r.rows) for r in I.ingest_files(spark, paths, "B1", str(tmp_path / "lake")).collect()}
    assert out == {"good.xlsx": ("ok", 2), "more.xlsx": ("ok", 1), "head.xlsx": ("ok", 0), "empty.xlsx": ("skip", 0),
                   "other.xlsx": ("skip", 0), "text.xlsx": ("error", 0), "cut.xlsx": ("error", 0), "broken.xlsx": ("error", 0),
                   "long.xlsx": ("error", 0), "blank.xlsx": ("skip", 0), "missing.xlsx": ("error", 0)}
    table = spark.read.parquet(str(tmp_path / "lake" / "notifications"))
    assert sorted(r.notification for r in table.collect()) == ["1", "2", "3"]


def test_rows_are_streamed():
    """A sheet far larger than a batch is read with few rows held."""
    import tracemalloc
    data = X.workbook_bytes([[f"{i}", i, "some text of a cell"] for i in range(60_000)])
    tracemalloc.start()
    assert sum(1 for _ in X.Workbook(data).rows()) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_cells_of_one_export_are_not_shuffled(spark):
    rows = spark.createDataFrame([(str(i), f"2001-01-{i % 28 + 1:02d}", "a<b" if i % 3 else None) for i in range(50)], "c0 string, c1 string, c2 string")
    books = X.workbooks(rows, ("Notification", "Notif.date", "Description"), F.col("c0").cast("int") % 3, "n")
    ex = I.workbook_export(X.cells_of(books).localCheckpoint(), "n")
    plan = ex.raw._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = sorted((r.notification, str(r.notif_date), r.description) for r in I.clean_export(ex, "B").collect())
    assert got == sorted((str(i), f"2001-01-{i % 28 + 1:02d}", "a<b" if i % 3 else None) for i in range(50))


def test_columns_are_written_as_their_cells():
    values = ["plain", " a&b<c>\x01", "2001-01-05", "2001-13-05", "2001-1&-05", "1999-12-31 23:59:58", "", None, float("nan"), 2.5, True, dt.date(2001, 1, 5)]
    for column in ([v] for v in values), [values], [[v for v in values if v != " a&b<c>\x01"]]:
        for part in column:
            got = cells(X._zipped([c] for c in X._written_column(part)))
            dates = {"2001-01-05": dt.date(2001, 1, 5), "1999-12-31 23:59:58": dt.datetime(1999, 12, 31, 23, 59, 58)}
            want = cells(X.workbook_bytes([None if v != v else dates.get(v, v)] for v in part))
            assert got == want


def listed(batches):
    return [(r, [c and (c["kind"], c["text"]) for c in row]) for b in batches for r, row in zip(*(c.to_pylist() for c in b.columns))]


def parsed(data):
    """Rows by the XML parser, or its error."""
    try:
        return list(X.Workbook(data).rows()), None
    except X.BROKEN as e:
        return None, type(e)


PLAIN = [
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AB1" t="inlineStr"><is><t>x</t></is></c></row>'
    '<row r="4" spans="1:3"><c r="B4" s="1"><v>36896.5</v></c></row>\n <row r="6"/><row><c r="A7"/></row>',
    '<row><c t="n"><v>12</v></c><c><v>1.50</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>a&amp;lt; &quot;x&quot; &lt;é</v></c>'
    '<c t="d"><v>2001-02-03T04:05:06</v></c><c/><c t="s"><v>2</v></c><c t="str"><v></v></c><c t="inlineStr"><is><t></t></is></c></row>',
    '<row><c t="inlineStr"><v>x</v></c><c t="str"><is><t>a</t></is></c><c></c></row>', "", " \n", "<row/>", '<row></row><row r="3"/><row/>',
    '<row><c t="str"><v>a\r\nb\rc\n</v></c></row>', '<row xml:space="preserve"><c s="1"><v>99999999999</v></c><c s="1"><v>0.25</v></c></row>']
OTHER = [
    "x", '<row><c t="str"><v>a\x01</v></c></row>', '<row><c t="str"><v>&#65;</v></c></row>', '<row><c t="str"><v>&foo;</v></c></row>',
    '<row><c t="str"><v>a & b</v></c></row>', "<row><c><v>abc</v></c></row>", '<row><c t="s"><v>77</v></c></row>', '<row><c s="x"><v>1</v></c></row>',
    '<row><c r="C1"><v>1</v></c><c><v>2</v></c></row>', '<row><c r="C1"><v>1</v></c><c r="B1"><v>2</v></c></row>',
    "<row><c><v>1</v></c></row><!-- <row> --><row><c><v>2</v></c></row>", "<row><c><v>1</v></c></row><row><c><v>2</v></row>",
    '<row><c t="str"><v><![CDATA[<x>]]></v></c></row>', '<row><c t="str"><v>a>b</v></c></row>', "<row r='3'><c t='str'><v>a</v></c></row>",
    '<row a:b="1"><c/></row>', '<row r="1" r="2"><c/></row>', '<row xmlns="urn:x"><c><v>1</v></c></row>', '<row><c t="str"><v>￿</v></c></row>',
    '<row><c t="inlineStr"><is><r><t>a</t></r><r><t>b</t></r></is></c></row>', "<row><c><f>A1</f><v>5</v></c> <c> <v>5</v> </c></row>"]


@pytest.mark.parametrize("sheet", PLAIN + OTHER)
def test_blocks_and_the_parser_read_the_same(sheet, monkeypatch):
    data = book(sheet, "<si><t>plain</t></si><si><r><t>in </t></r><r><t>runs</t></r></si><si/>", STYLES)
    want, error = parsed(data)
    if error:
        with pytest.raises(error):
            listed(X.Workbook(data).batches())
    else:
        assert listed(X.Workbook(data).batches()) == want
    if sheet in PLAIN:
        monkeypatch.setattr(X.Workbook, "rows", None)           # no need of the parser
        assert listed(X.Workbook(data).batches()) == want


def test_a_sheet_that_stops_being_plain_is_read_on(monkeypatch):
    monkeypatch.setattr(X, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(X, "BATCH_ROWS", 7)
    rows = [f"<row><c><v>{i}</v></c><c t=\"str\"><v>{'é' * (i % 50)}</v></c></row>" for i in range(300)]
    for odd in ("<row><c t='str'><v>odd</v></c></row>", ""):
        data = book("".join(rows + [odd] + rows))
        got = X.Workbook(data).batches()
        assert [len(b) for b in got][:-1] == [7] * (len(parsed(data)[0]) // 7 - (len(parsed(data)[0]) % 7 == 0))
        assert listed(X.Workbook(data).batches()) == parsed(data)[0]
    data = book("".join(rows + ["<row><c></row>"] + rows))          # what comes before is read in whole batches
    got = []
    with pytest.raises(X.ParseError):
        for batch in X.Workbook(data).batches():
            got.append(batch)
    assert listed(got) == list(zip(range(1, 295), (r for _, r in parsed(book("".join(rows)))[0])))


def test_blocks_are_streamed():
    import tracemalloc
    data = X.workbook_bytes([[f"{i}", i, "some text of a cell"] for i in range(60_000)])
    tracemalloc.start()
    assert sum(len(b) for b in X.Workbook(data).batches()) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_workbooks_of_so_many_rows(spark):
    """Rows stay where they are, null and repeated keys among them."""
    rows = spark.range(0, 45, 1, 2).selectExpr("cast(null as string) as c0", "if(id % 5 = 0, null, concat('a<', id)) as c1",
                                               "date_add(date'2001-01-05', cast(id as int)) as c2", "timestamp'2001-01-05 06:00:00' as c3", "if(id = 3, null, id) as c4")
    made = X.workbooks(rows, ("Key", "Text", "Date", "At", "No"), 10, "n")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    books = {r.path: bytes(r.content) for r in made.collect()}
    assert sorted(len(cells(b)) - 1 for b in books.values()) == [2, 3, 10, 10, 10, 10]
    got = sorted((tuple(c and c[1] for c in row[1:4]) for b in books.values() for _, row in cells(b)[1:]), key=str)
    assert got == sorted(((None if i % 5 == 0 else f"a<{i}", str(dt.datetime(2001, 1, 5) + dt.timedelta(i)), "2001-01-05 06:00:00")
                          for i in range(45)), key=str)


def test_dates_and_marks_are_written_by_column():
    values = ["plain", " a&b<c>\x01", "2001-01-05", "2001-13-05", "2001-02-30", "0000-01-01", "1-001-0105", "1999-12-31 23:59:58", "1999-12-31 24:00:00",
              "2001-01-05T00:00:00", "", None, "é\n&amp;", "2001-01-0é"]
    for some in ([v] for v in values), [values], [[None] * 3]:
        for part in some:
            assert X._written_array(X.pa.array([None, *part], X.pa.string()).slice(1)).to_pylist() == X._written_column(part)


def test_rows_are_dealt_for_workbooks(spark):
    from upkeep.plans.q_ingest import _dealt
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 50)
    cores = spark.sparkContext.defaultParallelism
    assert _dealt(many, 20).rdd.getNumPartitions() == 5 and _dealt(many, 1000).rdd.getNumPartitions() == 1
    spread = _dealt(few, 1)
    assert sorted(r.id for r in spread.collect()) == list(range(100)) and spread.columns == ["id"]
    assert spread.rdd.getNumPartitions() > 1 or cores <= 2
