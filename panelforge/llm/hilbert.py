"""Shards by Hilbert-curve order.

Several metadata dimensions are quantised to a few bits each, rows are ordered by their place on the Hilbert curve
through that grid, and the order is cut into runs. Neighbours on the curve are neighbours in every dimension, so each
shard covers a small box and readers can skip whole shards on any of the dimensions.

Everything is DataFrame expressions; only ids, sizes and checksums are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window as W

from panelforge.llm.common import small_side, stored
from panelforge.operators.order import running_sum


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of the point with the integer coordinates `axes`, each of `bits` bits.

    The axes-to-transpose form of the curve (Skilling 2004) as folds over the levels and axes: bound variables keep the
    expression small, where one projection a step makes the optimiser's constraints grow exponentially.
    """
    n = len(axes)

    def level(x: Column, q: Column) -> Column:
        def axis(y: Column, i: Column) -> Column:
            swap = y[0].bitwiseXOR(y[i]).bitwiseAND(q - 1)
            inside = y[i].bitwiseAND(q) != 0
            change = F.when(inside, q - 1).otherwise(swap)
            return F.transform(y, lambda v, j: F.when((j == 0) | ((j == i) & ~inside), v.bitwiseXOR(change)).otherwise(v))

        return F.aggregate(F.array(*[F.lit(i) for i in range(n)]), x, axis)

    levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
    x = F.aggregate(levels, F.array(*axes), level)
    gray = F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0), lambda a, b: a.bitwiseXOR(b)))
    turn = lambda g: F.aggregate(levels, F.lit(0), lambda t, q: F.when(g[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    turned = F.transform(F.array(gray), lambda g: F.transform(g, lambda v: v.bitwiseXOR(turn(g))))[0]
    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.transform(
        F.array(turned),
        lambda y: F.aggregate(places, F.lit(0), lambda a, b: F.aggregate(y, a, lambda c, v: c * 2 + F.call_function("shiftright", v, b).bitwiseAND(F.lit(1)))),
    )[0]


def ranked(df: DataFrame, cell: str, tie: list[str], rows: int, rows_per_part: int = 20_000, cell_bits: int = 16) -> DataFrame:
    """Adds `rank`, gapless from 0, in the order of `cell`, then a hash of `tie`, then `tie`.

    No task sees the whole order: rows are numbered inside (cell, hash part), and the counts before them are summed in
    three levels (parts of a cell, cells of a range of 256, ranges). A cell with a third of all rows is dealt over
    rows / rows_per_part parts. Rows that are equal in all columns of `tie` may swap their ranks.
    """
    parts = max(1, -(-rows // rows_per_part))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*tie), F.lit(parts)).cast("int"))
    counts = df.groupBy(cell, "_part").agg(F.count("*").alias("_n")).withColumn("_range", F.shiftright(F.col(cell), cell_bits // 2))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts_before = counts.withColumn("_in_cell", before(W.partitionBy("_range", cell).orderBy("_part"))).drop("_n")
    cells = counts.groupBy("_range", cell).agg(F.sum("_n").alias("_n"))
    cells_before = cells.withColumn("_in_range", before(W.partitionBy("_range").orderBy(cell))).drop("_n")
    ranges = cells.groupBy("_range").agg(F.sum("_n").alias("_n"))
    ranges_before = ranges.withColumn("_in_all", before(W.orderBy("_range"))).drop("_n")
    starts = (
        parts_before.join(cells_before, ["_range", cell])
        .join(F.broadcast(ranges_before), "_range")  # at most 2 ** (cell_bits / 2) rows
        .select(cell, "_part", (F.col("_in_cell") + F.col("_in_range") + F.col("_in_all")).alias("_start"))
    )
    at = F.row_number().over(W.partitionBy(cell, "_part").orderBy(*tie)) - 1
    return df.withColumn("_at", at).join(starts, [cell, "_part"]).withColumn("rank", F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def by_value(points: DataFrame, column: str, top: int, out: str) -> DataFrame:
    """points with `out`, the cell from 0 to top in which the middle of the value's rows lies in value order; null is 0.

    Values keep their order, so that a run of cells is a range of values and its least and largest tell what it holds. A
    row per distinct value is counted and summed up by blocks.
    """
    counts = stored(points.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n")), "values")
    total = counts.agg(F.sum("_n")).first()[0] or 1
    upto = running_sum(counts, column, "_n", "_upto")
    cells = upto.select(F.col(column).alias("_value"), F.floor((F.col("_upto") - F.col("_n") / 2) / total * (top + 1)).cast("int").alias("_cell"))
    cells = small_side(stored(cells, "value_cells"), row_bytes=512)
    return points.join(cells, F.col(column) == F.col("_value"), "left").withColumn(out, F.coalesce("_cell", F.lit(0))).drop("_value", "_cell")


def hilbert_shards(docs: DataFrame, n_shards: int = 24, bits: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, size (UTF-8 bytes + 8), text_crc32, hilbert, shard, slot, under the law `rows`.

    Dimensions, of `bits` bits each: language and source by the place of their value, size and id by approximate
    quantiles, all in cells of about equal counts. Shards are runs of the curve order whose row counts differ by one at
    most; slot is the place in the shard.

    Nulls: a null text has size 8 and checksum 0; null language, source or id count as cell 0 of their dimension. Ids may
    be numbers or texts. Repeated rows each get their own slot. An empty table gives no rows. Other columns are ignored.
    """
    top, raw = (1 << bits) - 1, F.encode(F.col(text_col), "UTF-8")
    points = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.col(lang_col).alias("_lang"),
        F.col(source_col).alias("_source"),
    )
    points = stored(points, "points")
    numeric = isinstance(points.schema["doc_id"].dataType, NumericType)
    shares = [k / (top + 1) for k in range(1, top + 1)]
    cut = lambda c: F.percentile_approx(c, shares, 10_000)
    rows, sizes, ids = points.agg(F.count("*"), cut("size"), cut("doc_id") if numeric else F.lit(None)).first()
    cell = lambda c, cuts: F.coalesce(F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x <= F.col(c))), F.lit(0)) if cuts else F.lit(0)
    points = by_value(by_value(points, "_lang", top, "_x0"), "_source", top, "_x1").drop("_lang", "_source")
    points = points.withColumn("_x2", F.least(cell("size", sizes), F.lit(top)))
    points = points.withColumn("_x3", F.when(F.col("doc_id").isNull(), 0).otherwise(F.least(cell("doc_id", ids), F.lit(top)))) if numeric else by_value(points, "doc_id", top, "_x3")
    points = points.withColumn("hilbert", hilbert_index([F.col(f"_x{i}") for i in range(4)], bits)).drop("_x0", "_x1", "_x2", "_x3")
    order = ranked(points, "hilbert", ["doc_id", "text_crc32", "size"], rows, cell_bits=4 * bits)
    shard = F.expr(f"int((rank * {n_shards}) div {max(rows, 1)})")
    first = F.expr(f"(shard * {rows}L + {n_shards - 1}) div {n_shards}")  # the smallest rank of the shard
    return order.withColumn("shard", shard).withColumn("slot", F.col("rank") - first).select("doc_id", "size", "text_crc32", "shard", "slot", "hilbert")
