"""Hard negatives by distributed radix selection.

Every anchor has windows of scores: one over the rows of its own label, whose best are its positives, and one per
positive over the other rows, from `low` to `high` per cent of the positive's score. The k best rows of a window are
found without sorting or gathering it: tasks count the window's scores by their leading digit, the summed histogram
tells the bucket of the kth best, and the next pass counts only that bucket by its next digit, until the kth score is
exact. Where more rows have that score than are wanted, ids are refined by digits in the same way. Only then rows are
gathered, and only those that qualify.

A task's histogram ends where its own counts reach what is wanted: the kth best of all rows is never below the kth best
of some, so later buckets can't hold it. A window hence gives at most k histogram rows a tile, however large it is.

Anchors pass the driver in chunks of `chunk_bytes`, each scored against all rows in tiles of exact products; no pair of
rows is ever written but those gathered. Work is anchors times rows by the task's nature, memory is not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelforge.llm.common import bounded_batches, lean, shared_dir, stored

TILE = 4_000_000  # scores of one tile
EXACT = 2**53  # up to here sums of products are exact as doubles


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column, scale: float) -> DataFrame:
    """id, label, q (floor of scale times each component, as long), anchor, for rows that take part.

    Rows with a null label, a null vector, or a component that is null or not finite take no part.
    """
    x = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).filter(finite)
    return rows.select("id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("q"), "anchor")


class _Chunk:
    """Anchors of one chunk: row numbers, ids, labels and components, as arrays that tasks receive."""

    def __init__(self, rows: list, dim: int, exact: bool):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.id = [r["id"] for r in rows]
        self.label = np.array([r["label"] for r in rows], np.int64)
        self.q = _padded([r["q"] for r in rows], dim, exact)


def _padded(lists: list, dim: int, exact: bool) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.float64 if exact else np.int64)
    for k, q in enumerate(lists):
        out[k, : len(q)] = q
    return out


def _tiles(batches: Iterator[pa.RecordBatch], chunk: _Chunk, dim: int, exact: bool, same: bool, lo: np.ndarray, hi: np.ndarray, null_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, score, id) of the rows of each tile that lie in their windows; lo and hi have a row per anchor."""
    least, most = lo.min(1), hi.max(1)
    step = max(1, TILE // max(1, len(chunk.row)))
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            q = part.column("q")
            sizes, flat = np.diff(q.offsets.to_numpy()), q.flatten().to_numpy(zero_copy_only=False)
            if (sizes == dim).all():
                m = flat.reshape(len(sizes), dim).astype(np.float64 if exact else np.int64)
            else:
                m = _padded(np.split(flat, np.cumsum(sizes)[:-1]), dim, exact)
            scores = chunk.q @ m.T
            fits = (scores >= least[:, None]) & (scores <= most[:, None])
            label, row = part.column("label").to_numpy(), part.column("row").to_numpy()
            alike = chunk.label[:, None] == label[None, :]
            fits &= (alike & (chunk.row[:, None] != row[None, :])) if same else ~alike
            a, r = np.nonzero(fits)
            s = scores[a, r].astype(np.int64)
            ids = part.column("id").fill_null(null_id).to_numpy()[r]
            for w in range(lo.shape[1]):
                inside = (s >= lo[a, w]) & (s <= hi[a, w])
                yield a[inside] * lo.shape[1] + w, s[inside], ids[inside]


def _head(window: np.ndarray, digit: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window, digit, count of the first digits of each window, as far as its counts don't reach what is needed before."""
    order = np.lexsort((digit, window))
    window, digit = window[order], digit[order]
    new = np.flatnonzero(np.r_[True, (window[1:] != window[:-1]) | (digit[1:] != digit[:-1])]) if len(window) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(window)])
    window, digit = window[new], digit[new]
    before = np.cumsum(count) - count
    first = np.flatnonzero(np.r_[True, window[1:] != window[:-1]]) if len(window) else new
    before = before - np.repeat(before[first], np.diff(np.r_[first, len(window)]))
    keep = before < need[window]
    return window[keep], digit[keep], count[keep]


def _histogram(table: DataFrame, shared, setup: tuple, lo: np.ndarray, hi: np.ndarray, need: np.ndarray, of_ids: bool, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> list:
    """(window, digit, rows before) of the bucket that holds the last needed row, for windows that have so many rows.

    Scores from `high` down, or ids from `low` up, are counted by what is left above `shift` bits.
    """
    dim, exact, same, null_id = setup

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window, score, ids in _tiles(batches, shared.value, dim, exact, same, lo, hi, null_id):
            key = ids if of_ids else score
            here = (key >= low[window]) & (key <= high[window])
            window, key = window[here], key[here]
            away = (key - low[window] if of_ids else high[window] - key).view(np.uint64) >> shift[window]
            found = _head(window, away.astype(np.int64), need)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["window", "digit", "n"])

    counts = table.mapInArrow(lean(count, "hard_negatives"), "window long, digit long, n long").groupBy("window", "digit").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(W.partitionBy("window").orderBy("digit").rowsBetween(W.unboundedPreceding, 0))
    needed = table.sparkSession.createDataFrame([(int(k), int(v)) for k, v in enumerate(need) if v], "window long, need long")
    placed = counts.withColumn("upto", upto).join(F.broadcast(needed), "window")  # one row a window of this chunk
    return placed.filter("upto >= need and upto - n < need").select("window", "digit", F.col("upto") - F.col("n"), "n").collect()


def _selected(table: DataFrame, shared, setup: tuple, lo: np.ndarray, hi: np.ndarray, k: int, digit_bits: int, ids: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each window the smallest score that qualifies, and the largest id that does with that score.

    A pass costs one scan of the rows; windows whose kth row is known, or that have fewer rows than k, take no part.
    """
    n = lo.size
    least, last = lo.ravel().copy(), np.full(n, np.iinfo(np.int64).max)
    low, high, need = lo.ravel().copy(), hi.ravel().copy(), np.where(lo.ravel() <= hi.ravel(), k, 0)
    tied = np.zeros(n, np.int64)
    for of_ids in (False, True):
        if of_ids:
            need, low, high = tied, np.full(n, ids[0]), np.full(n, ids[1])
            lo = hi = least.reshape(lo.shape)  # only rows that have exactly the last score
        while need.any():
            wide = [int(b - a).bit_length() if m else 0 for a, b, m in zip(low.tolist(), high.tolist(), need)]
            shift = np.array([max(0, w - digit_bits) for w in wide], np.uint64)
            located = _histogram(table, shared, setup, lo, hi, need, of_ids, low, high, shift)
            open_ = np.zeros(n, np.int64)
            for window, digit, before, count in located:
                bits = int(shift[window])
                a, b = int(low[window]), int(high[window])
                if of_ids:
                    low[window] = a + (digit << bits)
                    high[window] = min(b, a + ((digit + 1) << bits) - 1)
                else:
                    high[window] = b - (digit << bits)
                    low[window] = max(a, b - ((digit + 1) << bits) + 1)
                left = int(need[window]) - before
                if bits:
                    open_[window] = left
                elif of_ids:
                    last[window] = low[window]
                else:
                    least[window] = low[window]
                    tied[window] = left if count > left else 0
            need = open_
    return least, last


def _gathered(table: DataFrame, shared, setup: tuple, lo: np.ndarray, hi: np.ndarray, k: int, least: np.ndarray, last: np.ndarray) -> DataFrame:
    """window, score, id, rank of the k best rows of each window: only rows that qualify leave the tasks."""
    dim, exact, same, null_id = setup
    floor = least.reshape(lo.shape)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window, score, ids in _tiles(batches, shared.value, dim, exact, same, np.maximum(lo, floor), hi, null_id):
            keep = (score > least[window]) | (ids <= last[window])
            window, score, ids = window[keep], score[keep], ids[keep]
            order = np.lexsort((ids, -score, window))  # rows that are repeated in full may be many: the first k are enough
            window, score, ids = window[order], score[order], ids[order]
            start = np.searchsorted(window, window)
            first = np.arange(len(window)) - start < k
            known = pa.array(ids[first], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(window[first], pa.int64()), pa.array(score[first], pa.int64()), known], ["window", "score", "id"])

    rows = table.mapInArrow(lean(gather, "hard_negatives"), "window long, score long, id long")
    w = W.partitionBy("window").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchor: Column, per_anchor: int = 5, per_positive: int = 3, low: int = 50, high: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
    scale: float = 256, digit_bits: int = 16, chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the integer inner product of its components, floor(scale * x), with the anchor's. Anchors are the
    rows where `anchor` holds. Their positives are the per_anchor best other rows of the same label; for each, the
    per_positive best rows of other labels with low * positive <= 100 * score <= high * positive are returned, all if
    there are fewer. Higher scores come first, equal ones by smaller id.

    Nulls: rows with a null label, a null vector, or a component that is null or not finite take no part; a null `anchor`
    is no anchor; a null id comes after all others. Repeated rows are rows of their own: a repeated anchor has its own
    rows, and its copy may be its positive. Shorter vectors count as padded with zeros. Without anchors, positives or
    negatives there are no rows, nor for an empty table. Components of which a product doesn't fit 64 bits are an error.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    label = F.col("label") if label is None else label
    clean = whole_vectors(vectors, id_col, vec_col, label, anchor, scale)
    table = stored(clean.withColumn("row", F.monotonically_increasing_id()), "vectors")
    largest = F.greatest(F.array_max("q").cast("double"), -F.array_min("q").cast("double"))
    rows, dim, most, first, last_id, far = table.agg(F.count("*"), F.max(F.size("q")), F.max(largest), F.min("id"), F.max("id"), F.max(F.when(F.col("id").isNull(), 1))).first()
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    bound = int((dim or 0) * (most or 0.0) ** 2)
    if bound >= 2**63:
        raise ValueError("components are too large for 64-bit scores")
    exact, null_id = bound < EXACT, (last_id if last_id is not None else -1) + 1
    ids = (first if first is not None else 0, null_id if far else (last_id or 0))
    size = max(1, chunk_bytes // (8 * max(dim or 0, 1)))
    waiting = []
    for r in table.filter("anchor").select("row", "id", "label", "q").toLocalIterator():
        waiting.append(r)
        if len(waiting) == size:
            _mine_chunk(table, _Chunk(waiting, dim, exact), (dim, exact, null_id, ids, bound), per_anchor, per_positive, low, high, digit_bits).write.mode("append").parquet(path)
            waiting = []
    if waiting:
        _mine_chunk(table, _Chunk(waiting, dim, exact), (dim, exact, null_id, ids, bound), per_anchor, per_positive, low, high, digit_bits).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _mine_chunk(table: DataFrame, chunk: _Chunk, facts: tuple, per_anchor: int, per_positive: int, low: int, high: int, digit_bits: int) -> DataFrame:
    """The result rows of one chunk of anchors."""
    spark, (dim, exact, null_id, ids, bound) = table.sparkSession, facts
    shared = spark.sparkContext.broadcast(chunk)  # at most chunk_bytes of components
    n = len(chunk.row)
    lo, hi = np.full((n, 1), -bound), np.full((n, 1), bound)
    setup = (dim, exact, True, null_id)
    least, last = _selected(table, shared, setup, lo, hi, per_anchor, digit_bits, ids)
    found = _gathered(table, shared, setup, lo, hi, per_anchor, least, last).collect()  # per_anchor rows an anchor
    lo, hi = np.ones((n, per_anchor), np.int64), np.zeros((n, per_anchor), np.int64)
    named = []
    for r in found:
        p, at = r["score"], r["rank"] - 1
        lo[r["window"], at], hi[r["window"], at] = -(-low * p // 100), high * p // 100
        named.append((r["window"] * per_anchor + at, chunk.id[r["window"]], None if r["id"] == null_id else r["id"], p))
    setup = (dim, exact, False, null_id)
    least, last = _selected(table, shared, setup, lo, hi, per_positive, digit_bits, ids)
    rows = _gathered(table, shared, setup, lo, hi, per_positive, least, last)
    names = spark.createDataFrame(named, "window long, anchor_id long, positive_id long, positive_score long")
    out = rows.join(F.broadcast(names), "window")  # per_anchor rows an anchor of this chunk
    return out.select("anchor_id", "positive_id", "rank", F.when(F.col("id") != null_id, F.col("id")).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
