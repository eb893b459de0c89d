"""Section packs: named result sections rendered as JSON text.

A section that is limited, or has one row per code, becomes one row
``(section, n_rows, payload)`` where ``payload`` is a JSON array of the rows in
the section's own order.  ``pack_items`` gives a section of any size as one row
per item, ``(section, position, payload)``: no task holds it as a whole.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from upkeep.session import ensure_checkpoint_dir

JSON_OPTIONS = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
                "timestampFormat": "yyyy-MM-dd HH:mm:ss"}


def pack_section(name: str, df: DataFrame, order: list) -> DataFrame:
    cols = df.columns
    ranked = df.withColumn("_pos", F.row_number().over(Window.orderBy(*order)))
    g = ranked.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.sort_array(F.collect_list(F.struct(F.col("_pos"), F.struct(*cols).alias("row"))))
                   .alias("items"))
    return g.select(F.lit(name).alias("section"), "n_rows",
                    F.to_json(F.transform("items", lambda x: x["row"]), JSON_OPTIONS).alias("payload"))


def pack_json(sections: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """``{name: (df, order)}`` -> one row per section."""
    parts = [pack_section(n, df, order) for n, (df, order) in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def pack_top_lists(df: DataFrame, lists: dict) -> DataFrame:
    """Pack rows for several worklists of one table, computed in one scan
    (see ``worklists.fused_top_lists``).  Same payload text as
    ``pack_section`` over each list separately; a list no row qualifies for
    still gets its row (``n_rows`` 0, payload ``[]``)."""
    from upkeep.operators.worklists import fused_top_lists

    def as_json(spec):
        return F.to_json(F.struct("id", *spec.columns), JSON_OPTIONS)

    rows = fused_top_lists(df, lists, as_json)
    seeds = df.sparkSession.createDataFrame([(name, 0, None) for name in lists],
                                            "_list string, _rn int, _row string")
    real = F.col("_rn") > 0
    return (rows.unionByName(seeds).groupBy(F.col("_list").alias("section"))
            .agg(F.count(F.when(real, F.lit(1))).alias("n_rows"),
                 F.sort_array(F.collect_list(F.when(real, F.struct("_rn", "_row")))).alias("items"))
            .select("section", "n_rows",
                    F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["_row"]), ","),
                             F.lit("]")).alias("payload")))


# monotonically_increasing_id: the partition above 33 bits of row number.
_ROW_BITS = 33


def numbered(df: DataFrame, order: list) -> DataFrame:
    """``df`` with ``position`` from 1 in the given total order.

    The rows are range-partitioned and sorted, and staged with their place (the
    ranges of two sorts need not agree).  The sizes of the partitions, one row
    each, give every partition its offset; no window spans the rows.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/numbered-{uuid.uuid4().hex}"
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    rows = spark.read.schema(placed.schema).parquet(path).withColumn("_part", F.shiftright("_at", _ROW_BITS))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    # One entry per partition: as few as the sort's ranges.
    listed = sizes.agg(F.collect_list(F.struct("_part", "n")).alias("all"))
    offsets = listed.select(F.map_from_entries(F.transform("all", lambda x: F.struct(x["_part"], F.aggregate(
        F.filter("all", lambda y: y["_part"] < x["_part"]), F.lit(0).cast("bigint"), lambda total, y: total + y["n"])))))
    at = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return rows.select(*df.columns, (F.element_at(offsets.scalar(), F.col("_part")) + at + 1).cast("bigint").alias("position"))


def pack_items(sections: dict[str, tuple[DataFrame, list]]) -> DataFrame:
    """``{name: (df, order)}`` -> one JSON row per item of every section, with
    its position."""
    parts = [numbered(df, order).select(F.lit(name).alias("section"), "position",
                                        F.to_json(F.struct(*df.columns), JSON_OPTIONS).alias("payload"))
             for name, (df, order) in sections.items()]
    return reduce(DataFrame.unionByName, parts)
