"""Exact order statistics for tables that no task can hold: global places and ranks, quantiles of large groups, and
quantiles of what came before along one series.

Rows are sorted by range over all tasks; what passes the driver is a count per partition, or a few numbers per pass.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.session import small_side, small_table, stored


def numbered(df: DataFrame, order: list[str], column: str = "place") -> DataFrame:
    """df with `column`: the row's place, gapless from 0, in the order of the given columns (nulls first).

    Rows are range-partitioned and sorted, and the rows of earlier partitions counted. Rows that are equal in all columns
    of the order share a partition, so give columns that tell frequent values apart.
    """
    spark = df.sparkSession
    held = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r[0], r[1]) for r in held.groupBy(part.alias("_part")).agg(F.count("*")).collect())  # a row a partition
    starts = list(accumulate([0, *[n for _, n in counts]]))
    before = small_table(spark, [(p, starts[k]) for k, (p, _) in enumerate(counts)], "_part int, _before long")
    return held.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(column, F.col("_before") + at).select(*df.columns, column)


def tie_ranks(rows: DataFrame, keys: list[str], x: str, tie: list[str], column: str) -> DataFrame:
    """rows with the rank of x (not NULL) inside its keys, from 1, ties averaged. For few large groups: many small ones go through a window.

    `tie` are columns that tell equal values apart, so that a frequent value is dealt over several tasks.
    """
    placed = numbered(rows, [*keys, x, *tie], "_place")
    starts = placed.groupBy(*keys).agg(F.min("_place").alias("_start"))
    ties = stored(placed.groupBy(*keys, x).agg(F.min("_place").alias("_low"), F.count("*").alias("_n")).filter("_n > 1"), "ties")
    out = placed.join(small_side(stored(starts, "starts")), keys) if keys else placed.withColumn("_start", F.lit(0))
    out = out.join(small_side(ties), [*keys, x], "left")
    rank = F.coalesce(F.col("_low") + (F.col("_n") - 1) / 2, F.col("_place").cast("double")) - F.col("_start") + 1
    return out.select(*rows.columns, rank.alias(column))


# quantiles of few large groups


def _same(a: DataFrame, b: DataFrame, by: list[str]) -> Column:
    """Equality of the group columns, NULL being a group of its own."""
    on = F.lit(True)
    for c in by:
        on = on & a[c].eqNullSafe(b[f"_g_{c}"])
    return on


def quantiles(rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], most: int = 4096, buckets: int = 1024, is_stored: bool = False) -> DataFrame:
    """The group columns and, under the names of `wanted`, exact interpolated quantiles of the values that are not NULL.

    Groups of up to `most` values are aggregated at once. In each larger one the values are counted in equal-width
    buckets between their extremes, and the bucket that holds a wanted place is cut again between its own extremes,
    until it holds at most `most` values or a single one; then these few are gathered. Groups without values have no row,
    but without group columns there is always one. Rows are stored first unless they are a stored table.
    """
    data = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    data = data if is_stored else stored(data, "values")
    sizes = data.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    big = stored(sizes.filter(F.col("_n") > most).withColumnsRenamed({c: f"_g_{c}" for c in by}), "large_groups")  # at most rows / most of them
    groups = [f"_g_{c}" for c in by]
    plain = [F.percentile("_v", F.lit(float(q))).alias(name) for name, q in wanted.items()]
    if big.isEmpty():
        return data.groupBy(*by).agg(*plain)
    small = data.join(F.broadcast(big), _same(data, big, by), "left_anti").groupBy(*by).agg(*plain)
    if not by:
        small = small.filter("false")
    places = [F.floor((F.col("_n") - 1) * F.lit(float(q))) for q in wanted.values()] + [F.ceil((F.col("_n") - 1) * F.lit(float(q))) for q in wanted.values()]
    state = big.withColumn("_k", F.explode(F.array_distinct(F.array(*places)))).select(*groups, "_k", F.lit(0).cast("long").alias("_below"), "_a", "_b", "_n")
    state = stored(state, "quantile_state")
    while not state.filter((F.col("_n") > most) & (F.col("_a") < F.col("_b"))).isEmpty():
        wide = (F.col("_n") > most) & (F.col("_a") < F.col("_b"))
        ranges = state.filter(wide).select(*groups, "_below", "_a", "_b").distinct()  # disjoint: a row falls into one at most
        inside = data.join(F.broadcast(ranges), _same(data, ranges, by) & F.col("_v").between(F.col("_a"), F.col("_b")))
        share = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        cells = inside.withColumn("_c", F.least(F.floor(share * buckets), F.lit(buckets - 1))).groupBy(*groups, "_below", "_c").agg(F.count("*").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        upto = F.sum("_m").over(Window.partitionBy(*groups, "_below").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
        cells = cells.select(*[F.col(c).alias(f"_h{c}") for c in groups], F.col("_below").alias("_from"), "_m", "_min", "_max", (F.col("_below") + F.coalesce(upto, F.lit(0))).alias("_to"))
        on = (F.col("_below") == F.col("_from")) & (F.col("_k") >= F.col("_to")) & (F.col("_k") < F.col("_to") + F.col("_m"))
        for c in groups:
            on = on & F.col(c).eqNullSafe(F.col(f"_h{c}"))
        cut = state.filter(wide).join(cells, on).select(*groups, "_k", F.col("_to").alias("_below"), F.col("_min").alias("_a"), F.col("_max").alias("_b"), F.col("_m").alias("_n"))
        state = stored(state.filter(~wide).unionByName(cut), "quantile_state")
    ranges = state.filter("_a < _b").select(*groups, "_below", "_a", "_b").distinct()
    inside = data.join(F.broadcast(ranges), _same(data, ranges, by) & F.col("_v").between(F.col("_a"), F.col("_b")))
    lists = inside.groupBy(*groups, "_below").agg(F.sort_array(F.collect_list("_v")).alias("_list"))  # at most `most` values each
    lists = lists.withColumnsRenamed({**{c: f"_h{c}" for c in groups}, "_below": "_from"})
    on = (F.col("_a") < F.col("_b")) & (F.col("_below") == F.col("_from"))
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_h{c}"))
    found = state.join(lists, on, "left").select(*groups, "_k", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.get("_list", (F.col("_k") - F.col("_below")).cast("int"))).alias("_x"))
    maps = found.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_x"))).alias("_at")).withColumnsRenamed({c: f"_h{c}" for c in groups})
    on = F.lit(True)
    for c in groups:
        on = on & F.col(c).eqNullSafe(F.col(f"_h{c}"))
    out = big.join(maps, on)
    columns = []
    for name, q in wanted.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        x = F.when(low == high, F.col("_at")[low]).otherwise((high - at) * F.col("_at")[low] + (at - low) * F.col("_at")[high])
        columns.append(x.alias(name))
    return small.unionByName(out.select(*[F.col(g).alias(c) for g, c in zip(groups, by)], *columns))


# quantiles along one series


class Fenwick:
    """Counts of 0 or more at each of n places, with the place of the k-th item (from 0) in about log2(n) steps."""

    def __init__(self, counts: list[int]):
        self.n = len(counts)
        self.tree = [0, *counts]
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up] += self.tree[i]
        self.top = 1 << max(self.n, 1).bit_length() - 1

    def add(self, place: int) -> None:
        i = place + 1
        while i <= self.n:
            self.tree[i] += 1
            i += i & -i

    def kth(self, k: int) -> int:
        at, step = 0, self.top
        while step:
            up = at + step
            if up <= self.n and self.tree[up] <= k:
                at, k = up, k - self.tree[up]
            step >>= 1
        return at


def _between(sorted_at, position: float) -> float:
    """The value at a position between two places, by the places' values."""
    low, high = math.floor(position), math.ceil(position)
    return sorted_at(low) if low == high else (high - position) * sorted_at(low) + (position - low) * sorted_at(high)


def expanding_quantile(series: DataFrame, time: str, value: str, q: float, min_periods: int, column: str, block: int | None = None) -> DataFrame:
    """series with the quantile of all values at strictly earlier places in time; NULL under min_periods values.

    `time` must have no repeats; NULL values take no part. Times are cut into blocks and so are the values' ranks, and
    the counts of all (time block, rank block) cells tell, before any block of times, which rank blocks can hold its
    quantiles: a block of T rows moves a quantile by at most T places, so it needs at most about 2 T earlier values and
    the number below them. Each block is then one group, with a Fenwick tree over the ranks of those values and its own.
    """
    spark = series.sparkSession
    placed = stored(numbered(series, [time], "_t"), "series")
    n = placed.count()
    size = block or max(4096, int(8 * math.sqrt(n)))
    tb = F.expr(f"_t div {size}L")
    ranks = stored(numbered(placed.filter(F.col(value).isNotNull()).select("_t", F.col(value).cast("double").alias("_v")), ["_v", "_t"], "_r"), "ranks")
    cells = ranks.groupBy(tb.alias("_b"), F.expr(f"_r div {size}L").alias("_rb")).agg(F.count("*").alias("_c"))
    many = max(1, -(-n // size))
    grid = spark.range(many).select(F.col("id").alias("_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))).alias("_rb"))
    earlier = F.sum(F.coalesce("_c", F.lit(0))).over(Window.partitionBy("_rb").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    grid = grid.join(cells, ["_b", "_rb"], "left").select("_b", "_rb", F.coalesce(earlier, F.lit(0)).alias("_p"))
    at_block = Window.partitionBy("_b")
    grid = grid.withColumn("_under", F.coalesce(F.sum("_p").over(at_block.orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.sum("_p").over(at_block))
    low, high = F.floor((F.col("_m") - 1) * F.lit(q)) - size, F.ceil((F.col("_m") + size) * F.lit(q))
    need = stored(grid.filter((F.col("_p") > 0) & (F.col("_under") <= high) & (F.col("_under") + F.col("_p") > low)), "needed_ranks")
    heads = need.groupBy("_b").agg(F.min("_under").alias("_below"), F.first("_m").alias("_m"))
    spread = ranks.repartition("_t").withColumn("_rb", F.expr(f"_r div {size}L"))  # a rank block is needed by many blocks of times
    before = spread.join(small_side(need.select("_b", "_rb")), "_rb").filter(F.col("_t") < F.col("_b") * size).select("_b", F.lit(None).cast("long").alias("_t"), "_v", F.lit(0).cast("long").alias("_below"), F.lit(0).cast("long").alias("_m"))
    own = placed.select(tb.alias("_b"), "_t", F.col(value).cast("double").alias("_v")).join(small_side(stored(heads, "block_heads")), "_b", "left").select("_b", "_t", "_v", F.coalesce("_below", F.lit(0)).alias("_below"), F.coalesce("_m", F.lit(0)).alias("_m"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows[rows["_t"].notna()].sort_values("_t")
        slice_ = rows.loc[rows["_t"].isna(), "_v"].to_numpy()
        v = mine["_v"].to_numpy()
        here = ~np.isnan(v)
        total, below = int(mine["_m"].iloc[0]), int(mine["_below"].iloc[0])
        values = np.concatenate([slice_, v[here]])
        order = np.argsort(values, kind="stable")
        place = np.empty(len(values), np.int64)
        place[order] = np.arange(len(values))
        counts = np.zeros(len(values), np.int64)
        counts[place[: len(slice_)]] = 1
        tree, ordered = Fenwick(counts.tolist()), values[order].tolist()
        new, out = iter(place[len(slice_) :].tolist()), []
        kth = lambda k: ordered[tree.kth(k - below)]
        for there in here.tolist():
            out.append(_between(kth, q * (total - 1)) if total >= max(min_periods, 1) else None)
            if there:
                tree.add(next(new))
                total += 1
        return pd.DataFrame({"_t": mine["_t"].astype("int64"), column: pd.array(out, "Float64")})

    found = own.unionByName(before).groupBy("_b").applyInPandas(run, f"_t long, {column} double")
    return placed.join(found, "_t").select(*series.columns, column)


def rolling_quantile(series: DataFrame, time: str, value: str, q: float, lookback: int, column: str, history: str, block: int = 4096) -> DataFrame:
    """series with the quantile of the values in the `lookback` rows before each row, and how many values those rows have.

    `time` must have no repeats; NULL values take no part. Blocks of times overlap by the lookback: each is one group with
    a sorted multiset that rows enter and leave.
    """
    size = max(block, lookback)
    placed = stored(numbered(series, [time], "_t"), "series")
    b = F.expr(f"_t div {size}L")
    near = F.col("_t") >= (b + 1) * size - lookback  # also context of the next block
    dealt = placed.select("_t", F.col(value).cast("double").alias("_v"), F.explode(F.when(near, F.array(b, b + 1)).otherwise(F.array(b))).alias("_b"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_t")
        t, v, first = rows["_t"].to_numpy(), rows["_v"].to_numpy(), int(rows["_b"].iloc[0]) * size
        held: list[float] = []
        at, found, counts, leave = [], [], [], 0
        for k in range(len(t)):
            if leave < k and t[leave] < t[k] - lookback:  # places are gapless: at most one row leaves at a time
                if v[leave] == v[leave]:
                    held.pop(bisect_left(held, v[leave]))
                leave += 1
            if t[k] >= first:
                at.append(t[k])
                counts.append(len(held))
                found.append(_between(held.__getitem__, q * (len(held) - 1)) if held else None)
            if v[k] == v[k]:
                insort(held, v[k])
        return pd.DataFrame({"_t": at, history: counts, column: pd.array(found, "Float64")})

    found = dealt.groupBy("_b").applyInPandas(run, f"_t long, {history} long, {column} double")
    return placed.join(found, "_t").select(*series.columns, history, column)


def running_sum(series: DataFrame, time: str, value: str, column: str, block: int = 65_536) -> DataFrame:
    """series with the sum of the values up to each row in time, which must have no repeats: sums inside blocks and of the blocks before."""
    placed = numbered(series, [time], "_t").withColumn("_b", F.expr(f"_t div {block}L"))
    inside = placed.withColumn("_s", F.sum(value).over(Window.partitionBy("_b").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    blocks = sorted((r[0], r[1]) for r in placed.groupBy("_b").agg(F.sum(value)).collect())  # a row a block
    before = small_table(series.sparkSession, [(b, float(s)) for (b, _), s in zip(blocks, accumulate([0.0, *[float(s or 0) for _, s in blocks]]))], "_b long, _before double")
    kind = inside.schema["_s"].dataType
    return inside.join(F.broadcast(before), "_b").withColumn(column, (F.coalesce("_s", F.lit(0)) + F.col("_before")).cast(kind)).select(*series.columns, column)


def with_quantiles(groups: DataFrame, rows: DataFrame, by: list[str], value: str, wanted: dict[str, float], is_stored: bool = False) -> DataFrame:
    """One row a group, as an aggregate gave it, with the quantiles() of its rows; NULL where it has no value."""
    found = quantiles(rows, by, value, wanted, is_stored=is_stored).withColumnsRenamed({c: f"_g_{c}" for c in by})
    return groups.join(found, _same(groups, found, by), "left").drop(*[f"_g_{c}" for c in by])


def edges(rows: DataFrame, value: str, buckets: int) -> DataFrame:
    """One row with `_e`: the rising quantile edges of `buckets` equal shares, without repeats; NULL ones if there are no values."""
    found = quantiles(rows, [], value, {f"_e{k}": k / buckets for k in range(buckets + 1)})
    return found.select(F.array_distinct(F.array(*[f"_e{k}" for k in range(buckets + 1)])).alias("_e"))
