"""Mixing sources to target weights.

Sizes are summed by source, targets follow from the sources' weights and caps, and each document is taken
floor(rate) times plus once more with a probability equal to the fraction of its source's rate.

The trials of a source are seeded by a hash and spread evenly instead of being drawn one by one: documents are put in
order of size inside strata of like sizes, and the number that a document's trial compares with the fraction moves on by
the fraction from one to the next, from a start that is hashed. Each document still has exactly that probability, but the
words taken miss a target by about one document, not by the spread of independent trials (28 % of a source of 50
documents here).

Only ids, sources, sizes and hashes are shuffled. A source with a third of all rows is dealt over strata of bounded size;
only rows that are equal in id and text share one however many they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelforge.llm.common import small_side, stored
from panelforge.operators.order import numbered

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target of a table of source, source_size: shares by weight, at most `most` times the size.

    Sources by code point, null last, weigh as `weights`, repeated. What a cap leaves over is shared by weight among the
    sources below theirs, again and again; every round caps a source at least, and three numbers of it pass the driver.
    Targets are quotients of whole numbers, so they don't depend on the order of summation.
    """
    placed = numbered(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_place")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("_place") % len(weights)).cast("int")).cast("long")
    now = stored(placed.select("source", "source_size", weight.alias("_w"), F.lit(False).alias("_capped")), "mix_sources")
    total = now.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free = ~F.col("_capped")
        caps, share = now.agg(F.coalesce(F.sum(F.when(~free, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(free, F.col("_w"))), F.lit(0))).first()
        fair = F.lit(float(total - caps)) * F.col("_w") / F.lit(float(max(share, 1)))
        above = free & (fair > F.col("source_size") * most)
        if now.filter(above).isEmpty():
            break
        now = stored(now.withColumn("_capped", F.col("_capped") | above), "mix_sources")
    return now.select("source", "source_size", F.when(free, fair).otherwise((F.col("source_size") * most).cast("double")).alias("target"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 13, stratum_rows: int = 1_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (words), source_size, target (of its source), taken (words the mix takes, repeats counted), copies.

    Nulls: a null text has size 0, a null source is a source of its own, a null id is an id like others. Repeated rows are
    documents of their own. Documents without words are taken as the rate says, which is 0 words. An empty table gives no
    rows. Other columns are ignored. The same rows give the same result, however they are dealt.
    """
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(id_col, text_col).alias("_hash")), "sizes")
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
    classes = stored(rows.groupBy("source", "_class").agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "size_classes")
    goals = stored(targets(classes.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most), "targets")
    strata = _joined(classes, goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    strata = stored(strata.select(F.col("source").alias("_s"), F.col("_class").alias("_k"), F.ceil(F.col("_n") / stratum_rows).alias("_parts"), "source_size", "target"), "strata")
    told = _joined(rows, strata, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_k")))
    told = told.withColumn("_part", F.pmod(F.xxhash64("_hash", F.lit(seed)), F.col("_parts")))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    out = told.withColumn("_rate", rate).withColumn("_whole", F.floor("_rate")).withColumn("_fraction", F.col("_rate") - F.col("_whole"))
    place = F.row_number().over(W.partitionBy("source", "_class", "_part").orderBy("size", F.xxhash64("_hash", F.lit(seed)), "doc_id"))
    start = _uniform(F.xxhash64("source", "_class", "_part", F.lit(seed)))
    moved = start + (place - 1) * F.col("_fraction")
    copies = F.col("_whole") + F.when(F.floor(moved + F.col("_fraction")) > F.floor(moved), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def copied(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: the rows of docs, each as often as the plan of mixed() says for its id. Ids must be unique and not null."""
    told = docs.join(plan.filter("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies")), F.col(id_col) == F.col("_id"))
    return told.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)


def _uniform(hashed: Column) -> Column:
    """A number from 0 up to 1 of 52 bits of a hash."""
    return F.shiftrightunsigned(hashed, 12).cast("double") / float(1 << 52)


def _joined(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """left with its row of right, a stored table that is broadcast if it is small."""
    return left.join(small_side(right, row_bytes=256), on)
