"""Benchmark decontamination by a prefix-filtered set join.

Each window of ten consecutive words of a benchmark item is a set of three-word shingles with their places. A document
that holds the window holds all of its shingles, so one of them is enough to find it: the necessary prefix for exact
containment is the single rarest shingle, rarity being its count over all documents. Document shingles join the
prefixes; the place in the window bounds where it must start, the document's length bounds where it must end, and the
ten words are then compared one by one. Texts are cut into words once, and those of documents with a prefix again.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelforge.llm.common import measured_side, small_side, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _token(found: Column, at: Column, size: int) -> Column:
    """Hash of `size` words from place `at` (0-based) on."""
    return F.xxhash64(*[F.get(found, at + k) for k in range(size)])


def windows(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, window (words), length, offset, size, token: each shingle of each distinct window of each item."""
    found = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col).cast("string")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = found.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, F.lit(window)).alias("window")).distinct()
    cut = cut.withColumn("length", F.size("window")).withColumn("size", F.least(F.lit(shingle), F.col("length")))
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    token = None
    for size in range(1, shingle + 1):
        hashed = _token(F.col("window"), F.col("offset"), size)
        token = F.when(F.col("size") == size, hashed) if token is None else token.when(F.col("size") == size, hashed)
    return each.withColumn("token", token)


def _tokens(docs: DataFrame, size: int) -> DataFrame:
    """key columns, found (words), at, token: each shingle of each document."""
    return docs.select("*", F.posexplode("found").alias("at", "_word")).drop("_word").withColumn("token", _token(F.col("found"), F.col("at"), size))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, _text and _key, a hash of the text that tells rows with the same id apart."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    docs = docs.withColumn("_key", F.xxhash64(F.coalesce("_text", F.lit(""))))
    return docs


def _found(docs: DataFrame, items: DataFrame, window: int, shingle: int, item_id_col: str, item_text_col: str, broadcast_rows: int, broadcast_bytes: int = 64 << 20) -> DataFrame | None:
    """_id, _k, n_hit, ids (item ids) of the keyed documents that hold windows; None if there are no windows."""
    shingles = stored(windows(items, window, shingle, item_id_col, item_text_col), "windows")
    wide = F.sum(F.octet_length(F.array_join("window", " ")) + 64)
    stats = {r["size"]: (r["n"], r["bytes"]) for r in shingles.groupBy("size").agg(F.count("*").alias("n"), wide.alias("bytes")).collect()}
    small = sum(n for n, _ in stats.values()) <= broadcast_rows and sum(b for _, b in stats.values()) <= broadcast_bytes
    side = F.broadcast if small else (lambda x: x)
    source = docs.select("doc_id", "_key", words(F.col("_text")).alias("found"))
    hits = None
    for size in sorted(stats):
        mine = shingles.filter(F.col("size") == size)
        known = mine.select("token").distinct()
        spots = stored(_tokens(source, size).select("doc_id", "_key", "at", "token").join(side(known), "token"), "spots")
        counts = spots.groupBy("token").agg(F.count("*").alias("n"))
        rarest = F.row_number().over(W.partitionBy("item_id", "window").orderBy("n", "token", "offset"))
        prefix = stored(mine.join(counts, "token").withColumn("_r", rarest).filter("_r = 1").select("item_id", "window", "length", "offset", "token"), "prefix")
        met = spots.join(side(prefix.select("token").distinct()), "token").groupBy(F.col("doc_id").alias("_i"), F.col("_key").alias("_t")).agg(F.collect_list(F.struct("at", "token")).alias("spots"))
        met = measured_side(stored(met, "candidates"), "24L * size(spots)")
        # the words of these documents only, and of them those around each spot
        each = docs.join(met, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_t")))
        each = each.select("doc_id", "_key", words(F.col("_text")).alias("found"), "spots").withColumn("_n", F.size("found")).withColumn("_s", F.explode("spots"))
        base = F.greatest(F.col("_s.at") - window, F.lit(0))
        each = each.select("doc_id", "_key", "_n", "_s.at", "_s.token", base.alias("_base"), F.slice("found", base + 1, F.lit(2 * window)).alias("found"))
        start = F.col("at") - F.col("offset")
        same = F.slice("found", F.greatest(start - F.col("_base"), F.lit(0)) + 1, F.col("length")) == F.col("window")
        met = each.join(side(prefix), "token").filter((start >= 0) & (start + F.col("length") <= F.col("_n"))).filter(same)
        met = met.select("doc_id", "_key", start.alias("start"), (start + F.col("length")).alias("end"), "item_id")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return None
    spans = hits.groupBy("doc_id", "_key", "start", "end").agg(F.collect_set("item_id").alias("ids"))
    reached = F.max("end").over(W.partitionBy("doc_id", "_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(reached, F.lit(0))), F.lit(0))
    return (
        spans.withColumn("_fresh", fresh)
        .groupBy("doc_id", "_key")
        .agg(F.sum("_fresh").cast("long").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))
        .withColumnsRenamed({"doc_id": "_id", "_key": "_k"})
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of any window; n_items counts the items with occurring windows, and
    items_sha256 is over their ids, sorted as strings and joined by commas. An item of fewer words than a window is one
    window, one without words is none.

    Null and empty texts have no words. Rows with the same id and text each get the same result; rows with the same id
    and another text, or a null id, are told apart. Item rows with the same id are one item; a null item id matches but
    is not counted among the items. Empty tables give no rows, or no hits.

    The benchmark is broadcast only if it has at most broadcast_rows shingles and their windows at most 64 MiB (both
    counted first); a larger one is joined by shuffles.
    """
    docs = _keyed(docs, id_col, text_col)
    found = _found(docs, items, window, shingle, item_id_col, item_text_col, broadcast_rows)
    counted = docs.select("doc_id", "_key", F.coalesce(F.regexp_count("_text", F.lit(ANY_CASE_WORD)), F.lit(0)).cast("long").alias("n_words"))
    if found is None:
        none = F.sha2(F.lit("").cast("binary"), 256)
        return counted.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    ids = F.coalesce(F.array_sort(F.transform("ids", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns; the rules are those of decontaminated()."""
    found = _found(_keyed(docs, id_col, text_col), items, window, shingle, item_id_col, item_text_col, broadcast_rows)
    if found is None:
        return docs
    hit = small_side(stored(found.select("_id", "_k"), "contaminated"))
    key = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("_id")) & (key == F.col("_k")), "left_anti")
