"""Exact n-gram Jaccard join with count-vector R-trees.

Every document is a set of hashed word shingles. Shingles are hashed into groups, and the counts of a set's groups are
a point; the overlap of two sets is at most the sum of the smaller coordinates of their points. Points are packed into
R-trees, whose nodes hold the largest coordinates and the smallest set below them, so whole subtrees fall to one bound;
what survives is verified on the texts.

One tree over a corpus would compare every pair of alike lengths, so the index has shards: two sets that link share one
of their rarest shingles (those left when the necessary overlap is taken away), and each such shingle is a shard with
a tree of its own. Shards whose documents are already in one component by verified links need no search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelforge.llm.common import bounded_batches, lean, small_side, stored
from panelforge.llm.graph import components, forest_roots
from panelforge.llm.shingles import mixed, shingle_sets

NEED_I, NEED_S = 9, 4  # Jaccard of 0.8 or more: 9 * intersection >= 4 * (sum of the sizes)
COARSE = 16
TOKENS_A_BUCKET = 1_000_000
OPEN_PAIRS = 100_000  # under this many pairs to search, no further round of likely links is worth its jobs
ROWS_A_CELL = 4_096
TOKENS_A_BUNDLE = 400_000  # tokens that a task sends on at once
COUNTED, OFTEN = 2_000_000, 8  # tokens that a task counts together, and how often it must meet one there to report it
ROWS_OUT = 100_000
SALT, SECOND = 0x5851F42D4C957F2D, 0x14057B7EF767814F  # of the two hashes of a set


def enough(overlap, sizes):
    """Whether an overlap (or a bound of it) allows a link between sets of that summed size."""
    return overlap * NEED_I >= sizes * NEED_S


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Counts of the token groups: about one token a group, at least 16 groups, a power of two."""
    groups = 1 << int(np.clip(np.log2(len(tokens)), 4, 13))
    while True:
        counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max() < 1 << 16:
            return counts.astype(np.uint16)
        groups *= 2


def folded(vector: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups: groups of a power of two lie inside those of a smaller one."""
    return vector.reshape(-1, groups).sum(0, dtype=np.int64)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Summed coordinate minima, at the finest grouping both have."""
    g = min(len(a), len(b))
    return int(np.minimum(folded(a, g), folded(b, g)).sum())


class CountTree:
    """A packed R-tree over count points: leaves of neighbours in (size, coordinates), `fan` entries a node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan: int = 16):
        self.fan = fan
        order = np.lexsort((points[:, 1], points[:, 0], sizes))
        slab = max(fan * int(np.ceil(np.sqrt(len(order) / fan))), 1)  # slabs of like size, then tiles by the first two coordinates
        parts = [order[k : k + slab] for k in range(0, len(order), slab)]
        self.order = np.concatenate([p[np.lexsort((points[p, 1], points[p, 0]))] for p in parts]) if parts else order
        self.tops, self.least = [points[self.order]], [sizes[self.order]]
        while len(self.least[-1]) > fan:
            cut = np.arange(0, len(self.least[-1]), fan)
            self.tops.append(np.maximum.reduceat(self.tops[-1], cut, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], cut))

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        top, low = self.tops[level], self.least[level]
        keep = np.empty(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            s = slice(k, k + (1 << 16))
            keep[s] = enough(np.minimum(top[i[s]], top[j[s]]).sum(1), low[i[s]] + low[j[s]])
        return keep

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of places whose points may link (each pair once), found from the root down."""
        level = len(self.least) - 1
        i, j = np.triu_indices(len(self.least[level]), 0 if level else 1)
        yield from self._down(level, i, j)

    def _down(self, level: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in range(0, len(i), 1 << 12):  # depth first in blocks: memory stays bounded however many pairs survive
            a, b = i[k : k + (1 << 12)], j[k : k + (1 << 12)]
            keep = self._possible(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield self.order[a], self.order[b]
                continue
            n, step = len(self.least[level - 1]), np.arange(self.fan)
            x = (a[:, None, None] * self.fan + step[None, :, None] + 0 * step[None, None, :]).ravel()
            y = (b[:, None, None] * self.fan + step[None, None, :] + 0 * step[None, :, None]).ravel()
            once = (x < n) & (y < n) & ((x <= y) if level > 1 else (x < y)) | (np.repeat(a < b, self.fan**2) & (x < n) & (y < n))
            yield from self._down(level - 1, x[once], y[once])


def set_table(docs: DataFrame, shingle: int, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, cls and second (two hashes of the set, null if it is empty), point, often: one row per document.

    Some rows carry in `often` (token, times) pairs of 64 bits each: what a task met OFTEN times or more, in different
    sets, among about COUNTED tokens in a row.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, seen, size = [], set(), 0
        for batch in batches:
            n, both, points, often = [], [], [], [None] * len(batch)
            for k, x in shingle_sets(batch["text"], shingle):
                n.append(len(x))
                both.append((set_hash(x, SALT, bits), set_hash(x, SECOND)))
                points.append(count_vector(x).tobytes() if len(x) else None)
                if len(x) and both[-1] not in seen:
                    seen.add(both[-1])
                    met.append(x)
                    size += len(x)
                if size >= COUNTED:
                    often[k] = _often(met)
                    met, seen, size = [], set(), 0
            if len(batch):
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": n, "cls": pd.array([a for a, _ in both], "Int64"), "second": pd.array([b for _, b in both], "Int64"), "point": points, "often": often})
        if met:  # the rest hangs on a row of its own, which near_duplicates() takes out again
            yield pd.DataFrame({"doc_id": pd.array([None], "Int64"), "n_shingles": [-1], "cls": pd.array([None], "Int64"), "second": pd.array([None], "Int64"), "point": [None], "often": [_often(met)]})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInPandas(lean(read, "shingles"), "doc_id long, n_shingles long, cls long, second long, point binary, often binary")


def _often(met: list[np.ndarray]) -> bytes:
    """(token, times) of what OFTEN sets or more hold."""
    keys, n = np.unique(np.concatenate(met), return_counts=True)
    keep = n >= OFTEN
    return np.column_stack((keys[keep], n[keep].astype(np.uint64))).tobytes()


def hot_tokens(sets: DataFrame, at_least: int) -> dict[int, int]:
    """token -> times of the tokens that tasks reported at_least times in all; at most the total over at_least."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["often"]:
                pairs = np.frombuffer(raw, np.uint64).reshape(-1, 2).view(np.int64)
                yield pd.DataFrame({"token": pairs[:, 0], "times": pairs[:, 1]})

    told = sets.filter("often is not null").select("often").mapInPandas(spread, "token long, times long")
    return {r["token"] % (1 << 64): r["times"] for r in told.groupBy("token").agg(F.sum("times").alias("times")).filter(F.col("times") >= at_least).collect()}


def set_hash(tokens: np.ndarray, salt: int, bits: int = 64) -> int | None:
    """A hash of a set of tokens, cut to `bits`; None if it is empty."""
    if not len(tokens):
        return None
    return int(mixed(np.array([mixed(tokens ^ np.uint64(salt)).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0]) >> (64 - bits)


def set_class(tokens: np.ndarray, clashing: frozenset[int] = frozenset(), bits: int = 64) -> int | None:
    """What names a set: its first hash, or the second one where different sets have the same first (`clashing`)."""
    first = set_hash(tokens, SALT, bits)
    return set_hash(tokens, SECOND) if first in clashing else first


def _grouped(sets: DataFrame) -> DataFrame:
    """cls, lowest (doc_id), n, clash (whether second hashes differ): one row per class."""
    return stored(
        sets.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("lowest"), F.max("n_shingles").alias("n"), (F.min("second") != F.max("second")).alias("clash")),
        "classes",
    )


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame, frozenset[int]]:
    """(sets with the classes of set_class(), cls and lowest and n of each class, the clashing first hashes).

    Sets are told apart by 128 bits: those whose first hashes are equal and second ones are not get the second as their
    class. Of n different sets about n * n / 2 ** 65 hashes clash (some hundred of 10 ** 11), so they fit in the plan.
    """
    classes = _grouped(sets)
    clashing = frozenset(r.cls for r in classes.filter("clash").select("cls").collect())
    if clashing:
        sets = sets.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("second")).otherwise(F.col("cls")))
        classes = _grouped(sets)
    return sets.drop("second"), classes.drop("clash"), clashing


def _ids(x: np.ndarray, buckets: int) -> np.ndarray:
    """The short form of tokens: the bucket above, 32 bits below."""
    return ((x >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (x & np.uint64(0xFFFFFFFF))


def shared_shingles(
    docs: DataFrame, shingle: int, buckets: int, text_col: str, hot: dict[int, int] | None = None, clashing: frozenset[int] = frozenset(), bits: int = 64
) -> DataFrame:
    """cls, lost, token, df: the shingles that at least two different sets hold, with how many do.

    A token is 32 bits of its hash and a bucket, so tasks exchange four bytes a token: each batch sends one row per
    bucket, with its tokens and the sets they belong to. `lost` is how many shingles of the set fell together in this
    form. The tokens in `hot` (token -> df) would fill their bucket: they are spread over all buckets, with the df given.
    """
    known: dict[int, int] = {}
    for token, times in (hot or {}).items():
        k = int(_ids(np.array([token], np.uint64), buckets)[0])
        known[k] = known.get(k, 0) + times
    hot_ids, hot_df = np.array(sorted(known), np.uint64), np.array([known[k] for k in sorted(known)], np.int64)

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, head = [], []
            size, sent = 0, set()
            for _, x in shingle_sets(batch["text"], shingle):
                cls = set_class(x, clashing, bits)
                if cls is None or cls in sent:
                    continue
                sent.add(cls)
                ids = np.unique(_ids(x, buckets))
                head.append((cls, len(x) - len(ids)))
                size += len(ids)
                if len(hot_ids):
                    here = np.isin(ids, hot_ids)
                    if here.any():
                        yield _hot_row(cls, len(x) - len(ids), ids[here], buckets)
                        ids = ids[~here]
                tokens.append(ids)
                if size >= TOKENS_A_BUNDLE:
                    yield _bundles(tokens, head)
                    tokens, head, size = [], [], 0
            if tokens:
                yield _bundles(tokens, head)

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, bucket = [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.hot:
                    ids = np.frombuffer(row.tokens, np.uint64)
                    yield _hot_out(row, ids, hot_df[np.searchsorted(hot_ids, ids)])
                    continue
                if row.bucket != bucket and held:
                    yield from _repeated(bucket, held)
                    held = []
                bucket = row.bucket
                held.append(row)
        if held:
            yield from _repeated(bucket, held)

    sent = docs.select(F.col(text_col).cast("string").alias("text")).mapInPandas(lean(send, "shingles"), "bucket long, tokens binary, cls binary, lost binary, runs binary, hot boolean")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = dealt.mapInPandas(lean(meet, "shingles"), "cls long, lost long, token long, df long, hot boolean")
    if not len(hot_ids):
        return found.drop("hot")
    found = stored(found, "met")  # a set that several tasks sent has its hot tokens several times
    return found.filter("not hot").drop("hot").unionByName(found.filter("hot").drop("hot").dropDuplicates(["cls", "token"]))


def _hot_row(cls: int, lost: int, ids: np.ndarray, buckets: int) -> pd.DataFrame:
    cells = {"cls": np.int64(cls).tobytes(), "lost": np.uint32(lost).tobytes(), "tokens": ids.tobytes(), "runs": np.uint32(len(ids)).tobytes()}
    return pd.DataFrame([{"bucket": cls % buckets, **cells, "hot": True}])[["bucket", "tokens", "cls", "lost", "runs", "hot"]]


def _hot_out(row, ids: np.ndarray, df: np.ndarray) -> pd.DataFrame:
    cls, lost = np.frombuffer(row.cls, np.int64)[0], int(np.frombuffer(row.lost, np.uint32)[0])
    return pd.DataFrame({"cls": cls, "lost": lost, "token": ids.view(np.int64), "df": df, "hot": True})


def _bundles(tokens: list[np.ndarray], head: list[tuple[int, int, int]]) -> pd.DataFrame:
    """One row per bucket: its tokens (32 bits each), and cls, lost and run length of the sets they come from."""
    line, owner = np.concatenate(tokens), np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    bucket = (line >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    line, owner, bucket = line[order].astype(np.uint32), owner[order], bucket[order]
    cls, lost = (np.array(x, t) for x, t in zip(zip(*head), (np.int64, np.uint32)))
    cut = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    rows = []
    for a, b in zip(cut[:-1], cut[1:]):
        mine = owner[a:b]
        runs = np.flatnonzero(np.diff(mine, prepend=-1, append=-1))
        who = mine[runs[:-1]]
        rows.append((int(bucket[a]), line[a:b].tobytes(), cls[who].tobytes(), lost[who].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), False))
    return pd.DataFrame(rows, columns=["bucket", "tokens", "cls", "lost", "runs", "hot"])


def _repeated(bucket: int, rows: list) -> Iterator[pd.DataFrame]:
    """The tokens of a bucket that two sets hold. A set that came from several batches counts once."""
    token = np.concatenate([np.frombuffer(r.tokens, np.uint32) for r in rows])
    cls, lost, runs = (np.concatenate([np.frombuffer(getattr(r, c), t) for r in rows]) for c, t in (("cls", np.int64), ("lost", np.uint32), ("runs", np.uint32)))
    first = np.zeros(len(cls), bool)
    first[np.unique(cls, return_index=True)[1]] = True
    token, owner = token[np.repeat(first, runs)], np.repeat(np.flatnonzero(first), runs[first])
    order = np.argsort(token, kind="stable")
    ranked = token[order]
    starts = np.flatnonzero(np.diff(ranked, prepend=ranked[:1] ^ np.uint32(1)) != 0)
    df = np.diff(np.append(starts, len(ranked)))
    df = np.repeat(df, df)
    keep = df >= 2
    who, ranked, df = owner[order][keep], ranked[keep], df[keep]
    for k in range(0, len(who), ROWS_OUT):
        at, s = who[k : k + ROWS_OUT], slice(k, k + ROWS_OUT)
        yield pd.DataFrame({"cls": cls[at], "lost": lost[at].astype(np.int64), "token": ranked[s].astype(np.int64) | (bucket << 32), "df": df[s], "hot": False})


def shards(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """token, cls: the necessary prefix of each set, rarest shingles first; sets without a partner have none.

    A partner shares at least ceil(0.8 n) shingles, so the n - ceil(0.8 n) + 1 rarest hold a common one. Those that no
    other set has come first and need no row. Of shards with the same sets, one is kept.
    """
    need = F.expr("int((4 * n + 4) div 5)")
    slots = shared.groupBy("cls").agg(F.max("lost").alias("lost"), F.count("*").alias("found"))
    slots = slots.join(classes.select("cls", "n"), "cls").withColumn("slots", F.col("lost") - need + 1 + F.col("found")).filter("slots > 0").select("cls", "slots")
    slots = stored(slots, "slots")
    place = F.row_number().over(W.partitionBy("cls").orderBy("df", "token"))
    prefix = stored(shared.join(small_side(slots), "cls").withColumn("_place", place).filter("_place <= slots").select("token", "cls"), "prefix")
    marks = prefix.groupBy("token").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    chosen = stored(marks.filter("rows > 1").groupBy("rows", "x", "y").agg(F.min("token").alias("token")).select("token"), "chosen")
    return prefix.join(small_side(chosen), "token")


def _bound_udf():
    def possible(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for a, b, sizes in batches:
            yield pd.Series([enough(overlap_bound(np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)), s) for x, y, s in zip(a, b, sizes)], dtype=bool)

    return F.pandas_udf(lean(possible, "shingles"), "boolean")


def _verify_udf(shingle: int):
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            said = []
            for (_, x), (_, y) in zip(shingle_sets(left, shingle), shingle_sets(right, shingle)):
                said.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y))))
            yield pd.Series(said, dtype=bool)

    return F.pandas_udf(lean(linked, "shingles"), "boolean")


def _links(pairs: DataFrame, points: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs a, b that link: bounded by their points first, then verified on their texts."""
    side = lambda c, df, *cols: df.select(F.col("cls").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in cols])
    near = pairs.join(side("a", points, "n", "point"), "a").join(side("b", points, "n", "point"), "b")
    near = near.filter(_bound_udf()("a_point", "b_point", F.col("a_n") + F.col("b_n"))).select("a", "b")
    both = near.join(side("a", texts, "text"), "a").join(side("b", texts, "text"), "b")
    return both.filter(_verify_udf(shingle)("a_text", "b_text")).select("a", "b")


def _cells(open_: DataFrame, points: DataFrame, nearest: bool) -> DataFrame:
    """Pairs a, b of different components from the R-trees of the open shards: all that the bounds leave, or, for each
    set, only the nearest by its bound.

    A cell is one shard, or two blocks of a shard with more rows than one tree should hold.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(batch["token"], batch["i"], batch["j"]))
            cut = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
            for a, b in zip(cut[:-1], cut[1:]):
                if keys[a] != key and held:
                    yield from _cell_pairs(pd.concat(held), nearest)
                    held = []
                key = keys[a]
                held.append(batch.iloc[a:b])
        if held:
            yield from _cell_pairs(pd.concat(held), nearest)

    blocks = F.expr(f"int((rows + {ROWS_A_CELL - 1}) div {ROWS_A_CELL})")
    dealt = open_.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
    dealt = dealt.join(points.select("cls", "n", "point"), "cls").select("token", "i", "j", "block", "cls", "comp", "n", "point")
    found = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInPandas(lean(search, "shingles"), "a long, b long")
    return stored(found.distinct(), "pairs")


class _Bounds:
    """Overlap bounds of many pairs of points at once, at the finest grouping each pair has or 32 MiB hold for all."""

    def __init__(self, points: list[np.ndarray]):
        most = 1 << int(np.log2((1 << 23) / max(len(points), 1)))
        self.points, self.sizes = points, np.minimum([len(p) for p in points], max(most, COARSE))
        self.at: dict[int, np.ndarray] = {}

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        found, least = np.zeros(len(x), np.int64), np.minimum(self.sizes[x], self.sizes[y])
        for g in np.unique(least):
            if g not in self.at:
                wide = np.zeros((len(self.points), g), np.int32)
                for k in np.flatnonzero(self.sizes >= g):
                    wide[k] = folded(self.points[k], int(g))
                self.at = {g: wide}
            which, step = np.flatnonzero(least == g), max(1, (1 << 20) // int(g))
            for k in range(0, len(which), step):
                s = which[k : k + step]
                found[s] = np.minimum(self.at[g][x[s]], self.at[g][y[s]]).sum(1)
        return found


def _cell_pairs(cell: pd.DataFrame, nearest: bool) -> Iterator[pd.DataFrame]:
    points = [np.frombuffer(x, np.uint16) for x in cell["point"]]
    cls, comp, block, n = (cell[c].to_numpy() for c in ("cls", "comp", "block", "n"))
    across = cell["i"].iat[0] != cell["j"].iat[0]
    bounds = _Bounds(points)
    most, partner = np.zeros(len(n)), np.full(len(n), -1)
    for x, y in CountTree(np.stack([folded(p, COARSE) for p in points]), n).pairs():
        keep = comp[x] != comp[y]
        if across:
            keep &= block[x] != block[y]
        x, y = x[keep], y[keep]
        overlap, sizes = bounds.of(x, y), n[x] + n[y]
        keep = enough(overlap, sizes)
        x, y, ratio = x[keep], y[keep], overlap[keep] / sizes[keep]
        if nearest:
            order = np.argsort(ratio, kind="stable")  # of the pairs of one set, the last one written is the nearest
            for u, v in ((x[order], y[order]), (y[order], x[order])):
                best, who = np.zeros(len(n)), np.zeros(len(n), np.int64)
                best[u], who[u] = ratio[order], v
                better = best > most
                most[better], partner[better] = best[better], who[better]
        elif len(x):
            yield pd.DataFrame({"a": np.maximum(cls[x], cls[y]), "b": np.minimum(cls[x], cls[y])}).drop_duplicates()
    x = np.flatnonzero(partner >= 0)
    if len(x):
        yield pd.DataFrame({"a": np.maximum(cls[x], cls[partner[x]]), "b": np.minimum(cls[x], cls[partner[x]])}).drop_duplicates()


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, root after the links a, b: components of the old roots, carried over to the nodes."""
    held = small_side(roots)
    of = lambda c: held.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    at = lambda c: F.coalesce(F.col(f"{c}_root"), F.col(c)).alias(c)
    over = components(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(at("a"), at("b")))
    moved = roots.join(small_side(over.select(F.col("node").alias("root"), F.col("root").alias("_up"))), "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
    return stored(moved.unionByName(over.join(held, "node", "left_anti")), "merged")


def _open(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """token, cls, comp, rows (of the shard): the shards that hold several components."""
    placed = stored(cells.join(small_side(roots), F.col("cls") == F.col("node"), "left").select("token", "cls", F.coalesce("root", "cls").alias("comp")), "placed")
    several = placed.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("rows")).filter("_lo != _hi")
    return stored(placed.join(small_side(stored(several.select("token", "rows"), "several")), "token"), "open")


def _pairs_left(open_: DataFrame) -> int:
    """How many pairs of different components the open shards hold."""
    parts = open_.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return parts.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()[0]


def _likely(cells: DataFrame) -> DataFrame:
    """a, b: each set with the smallest set of a shard, of those the one it meets most often."""
    leads = cells.groupBy("token").agg(F.min("cls").alias("b"))
    met = cells.join(leads, "token").filter("cls != b").groupBy(F.col("cls").alias("a"), "b").agg(F.count("*").alias("m"))
    return met.groupBy("a").agg(F.max_by("b", F.struct("m", -F.col("b"))).alias("b"))


def near_duplicates(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, cls, component_id, component_class: one row per document.

    Two documents link when their sets of word shingles have a Jaccard similarity of at least 0.8; component_id is the
    smallest doc_id reachable by links. cls names the set (equal sets are one class, told apart by two 64-bit hashes;
    `bits` of the first, fewer of which only make it clash more often, which gives the same links). Every link
    between different sets either is verified or joins two documents already joined by verified links.

    Null, empty and blank texts have an empty set, cls null and themselves as component. Repeated rows each get a row;
    a null doc_id takes part, but is never the smallest. An empty table gives no rows. Other columns are ignored.
    """
    return _found(docs, shingle, id_col, text_col, bits)[0]


def _found(docs: DataFrame, shingle: int, id_col: str, text_col: str, bits: int) -> tuple[DataFrame, frozenset[int]]:
    """(rows of near_duplicates(), the clashing first hashes)."""
    bounded_batches(docs.sparkSession)
    told = stored(set_table(docs, shingle, id_col, text_col, bits), "sets")
    sets, classes, clashing = set_classes(told.filter("n_shingles >= 0").drop("often"))
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(2, -(-total // TOKENS_A_BUCKET))
    hot = hot_tokens(told, max(TOKENS_A_BUCKET // 2, total // 100_000, OFTEN))  # 100,000 at most
    shared = stored(shared_shingles(docs, shingle, buckets, text_col, hot, clashing, bits), "shared")
    cells = stored(shards(shared, classes), "shards")

    known = stored(cells.select("cls").distinct(), "known")
    points = sets.join(small_side(known), "cls").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("point").alias("point"))
    points = stored(points, "points")
    texts = stored(_texts(docs, points, shingle, id_col, text_col, clashing, bits), "texts")

    # first a likely link of each set, then, round by round, its nearest set of another component, as long as that
    # closes shards, and last all pairs of different components in the shards that are still open
    tree = _links(_likely(cells), points, texts, shingle)
    roots = forest_roots(tree.select(F.col("a").alias("node"), F.col("b").alias("parent")))
    before, nearest = float("inf"), True
    while True:
        open_ = _open(cells, roots)
        left = _pairs_left(open_)
        nearest = OPEN_PAIRS < left <= 0.8 * before
        roots = _merged(roots, stored(_links(_cells(open_, points, nearest), points, texts, shingle), "links"))
        if not nearest:
            break
        before, cells = left, open_.select("token", "cls")

    classes = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "lowest", F.coalesce("root", "cls").alias("comp"))
    lowest = classes.groupBy("comp").agg(F.min("lowest").alias("component_id"))
    final = stored(classes.select("cls", "comp").join(lowest, "comp").select("cls", "component_id", "comp"), "classes")
    rows = sets.select("doc_id", "n_shingles", "cls").join(final, "cls", "left").select(
        "doc_id", "n_shingles", "cls", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.col("comp").alias("component_class")
    )
    return rows, clashing


def _texts(docs: DataFrame, points: DataFrame, shingle: int, id_col: str, text_col: str, clashing: frozenset[int], bits: int) -> DataFrame:
    """cls, text of one document of each class in points. An id may have several texts; the class tells them apart."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [set_class(x, clashing, bits) == c for (_, x), c in zip(shingle_sets(batch["text"], shingle), batch["cls"])]
            yield batch[same]

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    wanted = small_side(points.select("doc_id", "cls"))
    found = source.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id"))).select("cls", "text")
    return found.mapInPandas(lean(pick, "shingles"), "cls long, text string").dropDuplicates(["cls"])


def one_of_each(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id stays.

    Rows whose text has no words all stay. Of repeated rows with the same smallest id, one stays.
    """
    found, clashing = _found(docs, shingle, id_col, text_col, bits)
    alone = stored(found.filter(F.col("cls").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "cls", "component_class").distinct(), "kept")
    names = docs.columns

    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([set_class(x, clashing, bits) for _, x in shingle_sets(batch, shingle)], dtype="Int64")

    keyed = docs.join(small_side(alone.select(F.col("doc_id").alias("_kept")).distinct()), F.col(id_col).eqNullSafe(F.col("_kept"))).drop("_kept")
    keyed = keyed.withColumn("_cls", F.pandas_udf(lean(tag, "shingles"), "long")(F.col(text_col).cast("string")))
    chosen = keyed.join(alone.select(F.col("doc_id").alias("_id"), F.col("cls").alias("_c"), "component_class"), F.col(id_col).eqNullSafe(F.col("_id")) & F.col("_cls").eqNullSafe(F.col("_c")))
    wordless = chosen.filter("_cls is null").select(*names)
    return wordless.unionByName(chosen.filter("_cls is not null").dropDuplicates(["component_class"]).select(*names))
