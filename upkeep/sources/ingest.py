"""Ingest header-labelled exports into typed, batch-stamped tables.

An export is a DataFrame of raw text cells with positional column names plus
its header row.  The layout of its kind maps header names to typed columns
through the cleaners; missing headers give NULL columns, unknown headers are
ignored, rows with every cell empty are dropped.  Reading, mapping and
writing are all distributed; the driver sees one header line and one
outcome row per file.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from upkeep.session import ensure_checkpoint_dir, limit_methods
from upkeep.functions.cleaners import clean_cell, clean_date, clean_number, clean_string, long_text_flag
from upkeep.functions.status import STATUS_WORDS, status_flag, with_status_flags
from upkeep.sources.exports import LAYOUTS, TABLE_OF, detect_kind, header_position, normalise_headers  # noqa: F401
from upkeep.sources.xlsx import read_cells

FILE = "_file"              # the source file of a row, where an export has one
HEAD_BYTES = 65_536         # read of a text file for its header; a longer header is an error
READERS = 16                # heads and footers that are read at once


@dataclass(frozen=True)
class Export:
    """One export: raw cells in positional columns ``c0..cN`` and its header."""
    name: str
    raw: DataFrame
    headers: tuple[str, ...]
    typed_cells: bool = False       # cells are structs (kind, text) of a workbook

    @property
    def kind(self) -> str:
        return detect_kind(self.headers)


def target_type(kind: str, arg) -> T.DataType:
    return {"s": T.StringType(), "d": T.DateType(), "b": T.BooleanType()}.get(
        kind, T.DecimalType(18, arg if arg is not None else 2))


def target_schema(kind: str) -> T.StructType:
    fields = [T.StructField(col, target_type(k, a)) for _, col, k, a in LAYOUTS[kind]]
    fields += [T.StructField("upload_batch", T.StringType()), T.StructField("uploaded_at", T.TimestampNTZType())]
    return T.StructType(fields)


def positional(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def clean_export(export: Export, batch: str, uploaded_at: dt.datetime | None = None,
                 kind: str | None = None, row_id_prefix: str | None = None) -> DataFrame:
    """Typed rows of one export (all-empty rows dropped).

    With ``row_id_prefix`` each row gets a text ``id`` unique across batches:
    ``<prefix>-<monotonic id>``.  The monotonic id depends only on the input
    split and the row's place in it, so a recomputed partition (lost
    executor) gets the same ids again.
    """
    kind = kind or export.kind
    if kind not in LAYOUTS:
        raise ValueError(f"unknown export kind for {export.name}")
    limit_methods(export.raw.sparkSession)
    headers = normalise_headers(export.headers)
    raw = export.raw.na.drop(how="all", subset=[c for c in export.raw.columns if c != FILE])
    types = dict(raw.dtypes)
    cols = []
    for spec, name, k, arg in LAYOUTS[kind]:
        pos = header_position(headers, spec)
        if pos is None:
            cols.append(F.lit(None).cast(target_type(k, arg)).alias(name))
            continue
        c = F.col(f"c{pos}")
        src_type = raw.schema[f"c{pos}"].dataType if types else None
        if export.typed_cells:
            e = clean_cell(c, k, arg)
        elif k == "s":
            e = clean_string(c)
        elif k == "d":
            e = clean_date(c, src_type)
        elif k == "n":
            e = clean_number(c, arg)
        else:
            e = long_text_flag(c, src_type)
        cols.append(e.alias(name))
    # A zone-free literal: the same wall-clock value whatever the session zone.
    stamp = (F.lit(uploaded_at.isoformat(sep=" ")).cast("timestamp_ntz") if uploaded_at
             else F.localtimestamp())
    if row_id_prefix is not None:
        cols.insert(0, F.concat_ws("-", F.lit(row_id_prefix),
                                   F.monotonically_increasing_id().cast("string")).alias("id"))
    if FILE in raw.columns:
        cols.append(F.col(FILE))
    return raw.select(*cols, F.lit(batch).alias("upload_batch"), stamp.alias("uploaded_at"))


def over_long(kind: str) -> Column:
    """Whether some text value of a typed row exceeds its column's limit."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.length(name) > arg, F.lit(False)) for _, name, k, arg in
                                       LAYOUTS[kind] if k == "s" and arg is not None], F.lit(False))


def ingest_exports(exports: list[Export], batch: str, uploaded_at: dt.datetime | None = None,
                   row_ids: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Typed DataFrames per kind (one ``unionByName`` per kind) and the per-export
    outcome table ``(file, status, kind, rows)``; unknown kinds are skipped, and
    an export with a value over its column's limit is an error as a whole: none
    of its rows are loaded.

    Each export is evaluated once: its typed rows are staged in the shared
    folder, and the counts that decide about it are observed while they are
    written.  ``release`` deletes the staged rows once the tables are loaded.
    """
    spark = exports[0].raw.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    by_kind: dict[str, list[DataFrame]] = {}
    outcomes = []
    for pos, ex in enumerate(exports):
        kind = ex.kind
        if kind == "unknown":
            outcomes.append((ex.name, "skip", kind, 0))
            continue
        typed = clean_export(ex, batch, uploaded_at, kind, f"{batch}-{pos}" if row_ids else None)
        seen = Observation()
        # The test is a column: observed expressions are not compiled.
        counts = (F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_bad"), 1)).alias("bad"))
        typed.withColumn("_bad", over_long(kind)).observe(seen, *counts).drop("_bad").write.parquet(f"{folder}/{pos}")
        n, bad = seen.get["n"], seen.get["bad"] > 0
        outcomes.append((ex.name, "error" if bad else "ok", kind, 0 if bad else n))
        if not bad:
            by_kind.setdefault(kind, []).append(spark.read.schema(typed.schema).parquet(f"{folder}/{pos}"))
    tables = {k: reduce(DataFrame.unionByName, v) for k, v in by_kind.items()}
    for table in tables.values():
        table._staged_in = folder
    return tables, spark.createDataFrame(outcomes, "file string, status string, kind string, rows bigint")


def release(tables: dict[str, DataFrame]) -> None:
    """Delete the staged rows behind the tables of ``ingest_exports``."""
    for table in tables.values():
        if folder := getattr(table, "_staged_in", None):
            path, fs = _fs_path(table.sparkSession, folder)
            fs.delete(path, True)


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """``ok/total`` files as one row."""
    return outcomes.agg(F.sum(F.when(F.col("status") == "ok", 1).otherwise(0)).cast("bigint").alias("ok"),
                        F.count(F.lit(1)).alias("total"))


# ------------------------------------------------------------------ files
def uri_key(uri: str) -> str:
    """One spelling of a file's URI, however many slashes follow the scheme."""
    return re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", uri)


def file_uri(spark: SparkSession, path: str) -> str:
    """The URI under which Spark reports a path (escaped, with its scheme)."""
    p, fs = _fs_path(spark, path)
    return uri_key(fs.makeQualified(p).toUri().toString())


def file_head(spark: SparkSession, path: str, size: int = HEAD_BYTES) -> bytes | None:
    """The first bytes of a file (``size`` and one more at most), None if there
    is no such file."""
    p, fs = _fs_path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size + 1))
    finally:
        stream.close()


def first_record(head: bytes, size: int = HEAD_BYTES) -> str | None:
    """The first record of a CSV file with the given head: up to the first line
    break outside quotes.  None if it does not end within ``size`` bytes."""
    whole = len(head) <= size
    text = head[:size].decode("utf-8", "strict" if whole else "ignore").removeprefix("\ufeff")
    quoted = False
    for m in re.finditer(r'["\r\n]', text):
        if m[0] == '"':
            quoted = not quoted
        elif not quoted:
            return text[:m.start()]
    return text if whole else None


def read_header(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header row of a CSV export, parsed as CSV."""
    record = first_record(file_head(spark, path) or b"")
    if record is None:
        raise ValueError(f"the header of {path} is longer than {HEAD_BYTES} bytes")
    return parse_header(record, sep)


def parse_header(line: str, sep: str = ",") -> list[str]:
    return next(csv.reader(io.StringIO(line), delimiter=sep), [])


def read_csv_group(spark: SparkSession, paths: list[str], headers: list[str], sep: str = ",",
                   name: str | None = None, multi_line: bool = True) -> Export:
    """All CSV exports sharing one header row, read by one scan (each file's
    own header line is skipped).  Duplicate headers stay apart by position.
    The source file of every row is kept in ``_file``.  With ``multi_line``
    cells may hold line breaks, and a file is then read by one task; without,
    large files are split."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(headers))])
    raw = (spark.read.option("header", True).option("enforceSchema", True).option("sep", sep)
           .option("multiLine", multi_line).schema(schema).csv(paths)
           .select(*[F.col(f.name) for f in schema.fields], F.col("_metadata.file_path").alias("_file")))
    return Export(name or ",".join(paths), raw, tuple(headers))


def read_csv_export(spark: SparkSession, path: str, sep: str = ",") -> Export:
    """One CSV export with positional all-text columns."""
    ex = read_csv_group(spark, [path], read_header(spark, path, sep), sep, path)
    return Export(path, ex.raw.drop("_file"), ex.headers)


def read_parquet_export(spark: SparkSession, path: str) -> Export:
    df = spark.read.parquet(path)
    return Export(path, positional(df), tuple(df.columns))


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def replace_table(spark: SparkSession, df: DataFrame, path: str, tag: str = "") -> None:
    """Replace a table: the new batches are written as partitions of their own
    first, and only when that has succeeded the other partitions are deleted.
    Nothing is renamed; a crash in between leaves old and new rows, never none."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("upload_batch").parquet(path)
    new = {r[0] for r in df.select("upload_batch").distinct().collect()}
    table, fs = _fs_path(spark, path)
    for status in fs.listStatus(table):
        name = status.getPath().getName()
        if name.startswith("upload_batch=") and unquote(name.split("=", 1)[1]) not in new:
            fs.delete(status.getPath(), True)


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "append", tag: str | None = None
                 ) -> list[str]:
    """Append (default) or replace.  Replace only touches the kinds present in
    this upload and swaps each table in after the new data is fully written;
    each table is partitioned by ``upload_batch`` so a batch can later be
    dropped without rewriting the others.  Status texts get their flag columns
    (not in a table that was begun without them)."""
    if mode not in ("append", "replace"):
        raise ValueError(f"unknown mode {mode}")
    written = []
    for kind, df in tables.items():
        path = f"{root.rstrip('/')}/{TABLE_OF[kind]}"
        if "system_status" in df.columns and _takes_flags(df.sparkSession, path, mode):
            df = with_status_flags(df)
        if mode == "replace":
            replace_table(df.sparkSession, df, path, tag or uuid.uuid4().hex[:12])
        else:
            df.write.mode("append").partitionBy("upload_batch").parquet(path)
        written.append(path)
    return written


def _takes_flags(spark: SparkSession, path: str, mode: str) -> bool:
    """Whether rows written to a table may have flag columns: a new table, a
    replaced one, or one whose rows have them."""
    table, fs = _fs_path(spark, path)
    if mode == "replace" or not fs.exists(table):
        return True
    old = [s.getPath() for s in fs.listStatus(table) if s.getPath().getName().startswith("upload_batch=")]
    return not old or status_flag(STATUS_WORDS[0]) in spark.read.parquet(old[0].toString()).columns


def read_parquet_group(spark: SparkSession, paths: list[str], name: str | None = None) -> Export:
    """Parquet exports sharing one column layout, read by one scan; column
    names are the header row, typed cells (dates, numbers) keep their type."""
    df = spark.read.parquet(*paths)
    headers = tuple(df.columns)
    raw = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(headers)],
                    F.col("_metadata.file_path").alias("_file"))
    return Export(name or ",".join(paths), raw, headers)


def read_xlsx_group(cells: DataFrame, headers: tuple[str, ...], files: list[str] | None, name: str) -> Export:
    """Workbooks sharing one header row, out of the staged cells of many (all of
    them: ``files`` is None).  What stands to the right of the header is one more
    column, which only says that a row is not empty."""
    rows = cells.where("row > 1")
    if files is not None:
        wanted = cells.sparkSession.createDataFrame([(f,) for f in files], "wanted string")
        # The list came from the driver; without the hint all cells are shuffled to it.
        rows = rows.join(F.broadcast(wanted), F.col(FILE) == F.col("wanted"), "left_semi")
    at = [F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(len(headers))]
    beyond = F.get(F.filter(F.slice("cells", len(headers) + 1, F.greatest(F.size("cells"), F.lit(1))),
                            lambda x: x.isNotNull()), F.lit(0))
    return Export(name, rows.select(*at, beyond.alias(f"c{len(headers)}"), FILE), headers, True)


def workbook_export(cells: DataFrame, name: str, some: DataFrame | None = None) -> Export:
    """One workbook export out of its cells; the header is its first row (looked
    for in ``some`` of them, all cells of few workbooks, where that costs less)."""
    heads = (cells if some is None else some).where("row = 1").select(F.transform("cells", lambda x: x["text"]).alias("h"))
    # All of few workbooks: a reader stopped halfway complains.
    head = heads.first() if some is None else next(iter(heads.collect()), None)
    headers = tuple(normalise_headers(head["h"] if head else ()))
    return read_xlsx_group(cells, headers, None, name)


def read_xlsx_export(spark: SparkSession, path: str) -> Export:
    """One workbook export (its active sheet) with positional cells."""
    ex = workbook_export(read_cells(spark, [path]), path)
    return Export(path, ex.raw.drop(FILE), ex.headers, True)


def _heads(spark: SparkSession, paths: list[str], sep: str) -> dict[str, tuple[str, ...] | str]:
    """Header row of each CSV or Parquet path, or the reason why it cannot be
    had.  A bounded part of each file is read, several files at once."""
    def one(path: str):
        try:
            if path.lower().endswith(".parquet"):
                p, fs = _fs_path(spark, path)
                return tuple(spark.read.parquet(path).columns) if fs.exists(p) else "missing"
            head = file_head(spark, path)
            if head is None:
                return "missing"
            record = first_record(head)
            if record is None:
                return "header"
            return tuple(parse_header(record, sep)) if record.strip() else ()
        except (AnalysisException, Py4JError, UnicodeDecodeError, csv.Error) as e:
            return type(e).__name__

    with ThreadPoolExecutor(READERS) as pool:
        return dict(zip(paths, pool.map(one, paths)))


def _staged(spark: SparkSession, files: list[str], typed, folder: str) -> tuple[list[DataFrame], dict[str, str]]:
    """The typed rows of ``files`` in the shared folder, and the files that
    could not be read with their errors.  A failure is narrowed down by halves,
    so that it costs the good files beside it nothing but another write."""
    path = f"{folder}/{uuid.uuid4().hex}"
    rows = typed(files)
    try:
        rows.write.parquet(path)
        return [spark.read.schema(rows.schema).parquet(path)], {}
    except (PySparkException, Py4JError) as e:
        if len(files) == 1:
            return [], {files[0]: type(e).__name__}
    half = len(files) // 2
    left, right = (_staged(spark, part, typed, folder) for part in (files[:half], files[half:]))
    return left[0] + right[0], left[1] | right[1]


def ingest_files(spark: SparkSession, paths: list[str], batch: str, root: str, mode: str = "append",
                 uploaded_at: dt.datetime | None = None, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """Read, detect, clean and write a set of CSV, Parquet or workbook (.xlsx)
    export files; returns the per-file outcome table ``(file, status, kind,
    rows)`` with the paths as given.

    Of CSV files a bounded head is read for the header, of Parquet files the
    footer; workbooks are read once, into staged cells.  Files are grouped by
    format and header row and each group is read by one scan, so the plan does
    not grow with the number of files.  The typed rows are staged in the shared
    folder, where they are counted and checked per file; the sources are not
    read again.  What is staged is deleted at the end.

    ``ok``: loaded, also with no rows (a header alone).  ``skip``: another kind
    of file, no header, or a header of no known kind.  ``error``: the file
    cannot be read (its header does not end within ``HEAD_BYTES``, it is missing
    or broken anywhere), or a value exceeds its column's limit; none of its rows
    are loaded.  The other files are not affected.
    """
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    outcome: dict[str, tuple[str, str, int]] = {p: ("skip", "unsupported", 0) for p in paths}
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    uris = {p: file_uri(spark, p) for p in paths}
    plain = [p for p in paths if p.lower().endswith((".csv", ".parquet"))]
    for p, head in _heads(spark, plain, sep).items():
        if isinstance(head, str):
            outcome[p] = ("error", head, 0)
        else:
            groups.setdefault((p.lower().rpartition(".")[2], head), []).append(p)
    books, cells, own = [p for p in paths if p.lower().endswith(".xlsx")], None, {}
    with ThreadPoolExecutor(READERS) as pool:
        there = dict(zip(books, pool.map(lambda p: _exists(spark, p), books)))
    outcome |= {p: ("error", "missing", 0) for p in books if not there[p]}
    books = [p for p in books if there[p]]
    if books:
        read_cells(spark, books).write.parquet(f"{folder}/cells")
        cells = spark.read.parquet(f"{folder}/cells")
        heads = cells.where("row = 1 or row = -1").select(
            FILE, "error", F.transform("cells", lambda x: x["text"]).alias("head")).collect()
        own = {uri_key(r[FILE]): r[FILE] for r in heads}
        found = {uri_key(r[FILE]): tuple(normalise_headers(r["head"])) for r in heads if r["error"] is None}
        failed = {uri_key(r[FILE]) for r in heads if r["error"] is not None}
        for p in books:
            if uris[p] in failed:
                outcome[p] = ("error", "workbook", 0)
            else:
                groups.setdefault(("xlsx", found.get(uris[p], ())), []).append(p)
    staged: dict[str, list[DataFrame]] = {}
    for pos, ((fmt, header), files) in enumerate(groups.items()):
        kind = detect_kind(header)
        for p in files:
            outcome[p] = ("skip", "unknown" if any(header) else "empty", 0) if kind == "unknown" else ("ok", kind, 0)
        if kind == "unknown":
            continue

        def typed(part: list[str]) -> DataFrame:
            if fmt == "csv":
                # A header with line breaks can only be skipped by the reader of whole records.
                ex = read_csv_group(spark, part, list(header), sep, f"group-{pos}",
                                    multi_line or any("\n" in h or "\r" in h for h in header))
            elif fmt == "xlsx":
                ex = read_xlsx_group(cells, header, [own[uris[p]] for p in part], f"group-{pos}")
            else:
                ex = read_parquet_group(spark, part, f"group-{pos}")
            prefix = f"{batch}-{pos}" if part == files else f"{batch}-{pos}-{files.index(part[0])}"
            return clean_export(ex, batch, uploaded_at, kind, prefix).withColumn("_bad", over_long(kind))

        rows, failed = _staged(spark, files, typed, folder)
        for p, error in failed.items():
            outcome[p] = ("error", error, 0)
        if rows:
            staged.setdefault(kind, []).extend(rows)
    tables = {k: reduce(DataFrame.unionByName, v) for k, v in staged.items()}
    by_uri = {u: p for p, u in uris.items()}
    # One row per file reaches the driver, as the list of paths came from there.
    rejected = []
    for df in tables.values():
        for r in df.groupBy(FILE).agg(F.count(F.lit(1)).alias("n"), F.max("_bad").alias("bad")).collect():
            uri = uri_key(r[FILE])
            p = by_uri.get(uri) or by_uri[next(u for u in _parents(uri) if u in by_uri)]
            status, kind, n = outcome[p]
            outcome[p] = ("error", kind, 0) if r["bad"] or status == "error" else ("ok", kind, n + r["n"])
            if r["bad"]:
                rejected.append(p)
    good = {k: _without_files(df, [uris[p] for p in rejected]).drop(FILE, "_bad") for k, df in tables.items()}
    write_tables(good, root, mode, batch)
    place, fs = _fs_path(spark, folder)
    fs.delete(place, True)
    return spark.createDataFrame([(p, *outcome[p]) for p in paths], "file string, status string, kind string, rows bigint")


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs_path(spark, path)
    return fs.exists(p)


def _parents(uri: str) -> list[str]:
    parts = uri.split("/")
    return ["/".join(parts[:i]) for i in range(len(parts) - 1, 0, -1)]


def _without_files(df: DataFrame, uris: list[str]) -> DataFrame:
    """Rows of other files than ``uris`` (files, or folders of part files)."""
    if not uris:
        return df
    bad = df.sparkSession.createDataFrame([(u,) for u in uris], "bad string")
    key = F.regexp_replace(FILE, r"^([A-Za-z][A-Za-z0-9+.\-]*):/+", "$1:/")
    return (df.join(bad, key == F.col("bad"), "left_anti")
            .join(bad, F.regexp_replace(key, "/[^/]*$", "") == F.col("bad"), "left_anti"))


def without_batch(df: DataFrame, batch: str) -> DataFrame:
    """Rows of every other upload batch (NULL batches are kept); no rows for
    ``"ALL"``."""
    if batch == "ALL":
        return df.limit(0)
    return df.filter(~F.col("upload_batch").eqNullSafe(F.lit(batch)))


def delete_batch_files(spark: SparkSession, table_path: str, batch: str) -> bool:
    """Drop one batch partition of a written table (no rewrite of others), or
    with ``"ALL"`` every one."""
    table, fs = _fs_path(spark, table_path)
    if not fs.exists(table):
        return False
    found = [s.getPath() for s in fs.listStatus(table) if s.getPath().getName().startswith("upload_batch=")]
    dropped = [fs.delete(p, True) for p in found if batch == "ALL" or unquote(p.getName().split("=", 1)[1]) == batch]
    return any(dropped)


def length_violations(df: DataFrame, kind: str) -> DataFrame:
    """Per limited text column: its limit and how many values exceed it."""
    limited = [(name, arg) for _, name, k, arg in LAYOUTS[kind] if k == "s" and arg is not None]
    counts = df.agg(*[F.sum(F.when(F.length(name) > arg, 1).otherwise(0)).cast("bigint").alias(name)
                      for name, arg in limited])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("column"), F.lit(arg).alias("max_len"),
                 F.coalesce(F.col(name), F.lit(0).cast("bigint")).alias("violations"))
        for name, arg in limited])))
