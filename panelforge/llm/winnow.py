"""Document fingerprints by winnowing, as DataFrame functions.

Every run of k code points has a rolling hash: its symbols (pairs of code points for an even k, else single ones) are
hashed, shifted by the code points that follow and combined by exclusive or, a polynomial over bits. The hash of two
neighbouring runs gives that of both together, so all k-grams cost log2(k) passes over the text, not k, and no product
has to be kept from overflowing. Of each window of w neighbouring hashes the smallest is kept, the
rightmost one if several are equal, with its position. Two texts that share a run of w + k - 1 code points share a kept
hash. What a fingerprint holds is the 64-bit hash of each kept gram; the low 31 bits of the rolling hash only choose.

A hash and its position are packed in one long (hash above, complement of the position below), so that the smaller long
is the smaller hash or the one further right, and the window minimum is log2(w) passes of pairwise minima. Texts are
read as UTF-32, where the code point at any place is a slice of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LAST = (1 << 31) - 1  # positions are below this
MASK = (1 << 31) - 1  # of a rolling hash, the low 31 bits choose


def _let(value: Column, use) -> Column:
    """use(value), where value is evaluated once and then bound."""
    return F.transform(F.array(value), use)[0]


def _joined(a: Column, b: Column, size: int) -> Column:
    """Hash of a run, given the hash of its first part and that of the `size` code points after it."""
    return F.shiftleft(a, size).bitwiseXOR(b)


def _rolled(x: Column, k: int, span: int, use) -> Column:
    """use(y, (v, at) -> rolling hash of the run of k code points at place `at`, where y has v), given the hashes x of
    all runs of `span`. A place is read by its own lambda variable, its neighbour by its place: no pass copies a shifted
    array, and the last doubling is part of the caller's pass."""
    if k == span:
        return use(x, lambda v, at: v)

    def from_halves(y: Column) -> Column:
        both = lambda v, at: _joined(v, F.get(y, at + k // 2), k // 2)
        if k % 2 == 0:
            return use(y, both)
        return _let(F.transform(y, both), lambda z: use(z, lambda v, at: _joined(v, F.get(x, at + (k - 1)), 1)))

    return _rolled(x, k // 2, span, lambda y, half: from_halves(y) if k // 2 == span else _let(F.transform(y, half), from_halves))


def _keys(raw: Column, start: Column, end: Column, k: int) -> Column:
    """Packed hash and position of the k-grams that start at places start to end - 1 of a UTF-32 binary.

    A text shorter than k is one gram; as there is nothing to choose from, it needs no hash here.
    """
    span = 2 if k % 2 == 0 else 1
    symbol = lambda at: F.xxhash64(F.substring(raw, at, F.lit(4 * span)))
    symbols = F.transform(F.sequence(start * 4 + 1, (end + (k - 1 - span)) * 4 + 1, F.lit(4)), symbol)
    packed = lambda y, hash_of: F.slice(F.transform(y, lambda v, at: F.shiftleft(hash_of(v, at).bitwiseAND(F.lit(MASK)), 31).bitwiseOR(F.lit(LAST) - start - at)), F.lit(1), end - start)
    none = F.array().cast("array<bigint>")
    short = F.array((F.lit(LAST) - start).cast("bigint"))
    whole = F.floor(F.octet_length(raw) / 4) >= end + (k - 1)
    return F.when(start >= end, none).when(~whole, short).otherwise(_let(symbols, lambda x: _rolled(x, k, span, packed)))


def _window_minima(keys: Column, w: int) -> Column:
    """Minimum of each w neighbours (w a power of two); of all of them if they are fewer."""

    def over(x: Column) -> Column:
        def halved(y: Column, width: int) -> Column:
            """Minima of w neighbours, given those of `width` in y; the last pass makes only the places of whole windows."""
            least = lambda at: F.least(F.get(y, at), F.get(y, at + width))
            if width * 2 == w:
                return F.transform(F.sequence(F.lit(0), F.size(x) - w), least)
            return _let(F.transform(y, lambda v, at: F.least(v, F.get(y, at + width))), lambda z: halved(z, width * 2))

        whole = halved(x, 1) if w > 1 else x
        return F.when((F.size(x) >= w) & (F.size(x) > 0), whole).when(F.size(x) > 0, F.array(F.array_min(x))).otherwise(F.array().cast("array<bigint>"))

    return _let(keys, over)


def _grams(n: Column, k: int) -> Column:
    """How many k-grams a text of n code points has: a short text that is not empty is one gram."""
    return F.when(n >= k, n - (k - 1)).otherwise(F.least(n, F.lit(1)))


def kept_grams(text: Column, k: int, w: int) -> Column:
    """The packed window minima of a text in text order, each once; null counts as empty."""
    n = F.coalesce(F.length(text), F.lit(0))
    keys = _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), lambda raw: _keys(raw, F.lit(0), _grams(n, k), k))
    return F.array_distinct(_window_minima(keys, w))


def hashes(kept: Column, text: Column, k: int) -> Column:
    """The 64-bit hashes of the kept grams of `text` in text order; `kept` has each window minimum once."""
    gram = lambda raw: lambda x: F.xxhash64(F.substring(raw, (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("int") * 4 + 1, F.lit(4 * k)))
    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), lambda raw: F.transform(kept, gram(raw)))


def positions(kept: Column) -> Column:
    """The positions of the kept hashes, in the same order."""
    return F.transform(kept, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def _of_first_windows(kept: Column, count: Column, w: int) -> Column:
    """Those of the kept grams of a text (each once, in text order) that its first `count` windows of w grams keep.

    The minimum of the last of these windows is the least kept gram inside it, and the kept grams before that one belong
    to earlier windows, as the places of minima never go back.
    """
    place = lambda x: x.bitwiseAND(F.lit(LAST))  # noqa: E731  LAST minus the position
    last = _let(F.lit(LAST) - count + 1, lambda top: F.array_min(F.filter(kept, lambda x: place(x).between(top - (w - 1), top))))
    return F.when(count < 1, F.array().cast("array<bigint>")).otherwise(_let(place(last), lambda low: F.filter(kept, lambda x: place(x) >= low)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of hashes; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1.0)))


def fingerprints(docs: DataFrame, k: int = 8, w: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes, positions of each document. Null and empty texts have none; a text of fewer than k code points
    is one gram, one of fewer than w grams is one window. Repeated rows each have theirs, a null id is carried along, an
    empty table gives no rows, other columns are ignored."""
    part = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    part = part.withColumn("m", kept_grams(F.col("_text"), k, w))
    return part.select("doc_id", hashes(F.col("m"), F.col("_text"), k).alias("hashes"), positions(F.col("m")).alias("positions"))


def _bucketed(docs: DataFrame, rows_per_bucket: int, cells: int = 256, block_of: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """docs with `bucket`, which rises with doc_id and holds about rows_per_bucket rows; and bucket, next_bucket: the
    next bucket that is not empty going down, the highest one after the lowest.

    Approximate quantiles of doc_id give `cells` ranges of about equal counts, each cut in ranges of equal width. Rows
    without an id follow below all others, in ranges of their texts' hashes, so that they too are many buckets.
    """
    edges = [i / cells for i in range(cells + 1)]
    rows, idless, cuts = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.percentile_approx("doc_id", edges, 10_000)).first()
    cuts = sorted(set(cuts or []))
    parts = max(1, round(rows / cells / rows_per_bucket))
    if len(cuts) < 2:
        cell, part = F.lit(0), F.lit(0)
    else:
        bounds = F.array(*[F.lit(int(c)) for c in cuts])
        at = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts[1:-1]]).cast("array<bigint>"), lambda c: c <= F.col("doc_id")))
        low, high = bounds[at], bounds[at + 1]
        cell, part = at, F.least(F.greatest(F.floor((F.col("doc_id") - low) / (high - low) * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    ranges = max(1, round(idless / rows_per_bucket))
    place = F.floor((F.xxhash64("text") / F.lit(2.0**64) + 0.5) * ranges)  # rises with the hash
    bucket = F.when(F.col("doc_id").isNull(), -1 - F.least(place, F.lit(ranges - 1))).otherwise(cell.cast("bigint") * parts + part)
    dealt = docs.withColumn("bucket", bucket.cast("bigint"))
    # the bucket before each: inside blocks of buckets by a window, for a block's first from the block before it; there
    # are rows / rows_per_bucket / block_of buckets in a block's table, so no task sees all buckets
    there = dealt.select("bucket").distinct().withColumn("_block", F.floor(F.col("bucket") / block_of))
    blocks = there.groupBy("_block").agg(F.max("bucket").alias("_top"))
    before = W.orderBy("_block")
    blocks = blocks.select("_block", F.lag("_top").over(before).alias("_before"), F.max("_top").over(before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("_highest"))
    follow = F.coalesce(F.lag("bucket").over(W.partitionBy("_block").orderBy("bucket")), F.col("_before"), F.col("_highest"))
    return dealt, there.join(F.broadcast(blocks), "_block").select("bucket", follow.alias("next_bucket"))


def edit_study(docs: DataFrame, k: int = 8, w: int = 16, rows_per_bucket: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like these and the next documents they are.

    The edited text has the last floor(n / 2) code points replaced by as many, or all, from the start of the next
    document, going down by doc_id (after the last: the first). Columns: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint (hashes joined by commas), near_edited, near_next, n_kept, positions (of the kept hashes).

    Null texts count as empty, null ids come last; rows with the same id follow in the order of their texts' hashes. A
    single document is next to itself. Texts are shuffled once; windows of an edited text that lie in either of its
    halves are taken from the two documents.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt, follow = _bucketed(base, rows_per_bucket)
    order = W.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    lined = dealt.withColumn("_next", F.lead("text").over(order)).withColumn("_row", F.row_number().over(order))
    first = lined.filter("_row = 1").select(F.col("bucket").alias("next_bucket"), F.col("text").alias("_first"))
    first = first.join(follow, "next_bucket").select("bucket", "_first")
    own = lined.join(first, "bucket", "left").withColumn("_after", F.coalesce("_next", "_first"))
    own = own.withColumn("n", F.length("text")).withColumn("_kept", kept_grams(F.col("text"), k, w))
    own = own.withColumn("_hashes", hashes(F.col("_kept"), F.col("text"), k))
    own = own.withColumn("_there", F.lead("_kept").over(order)).withColumn("_hashes3", F.lead("_hashes").over(order))
    own = own.withColumn("_there", F.when(F.col("_next").isNull(), kept_grams(F.col("_after"), k, w)).otherwise(F.col("_there")))
    own = own.withColumn("_hashes3", F.when(F.col("_next").isNull(), hashes(F.col("_there"), F.col("_after"), k)).otherwise(F.col("_hashes3")))
    half = F.floor(F.col("n") / 2).cast("int")
    own = own.withColumn("_keep", F.col("n") - half).withColumn("_new", F.expr("substring(_after, 1, n - _keep)"))
    own = own.withColumn("_n2", F.col("_keep") + F.length("_new")).withColumn("_edited", F.concat(F.expr("substring(text, 1, _keep)"), F.col("_new")))
    # windows that lie in the kept part are those of the document itself, windows that lie in the new part are those of
    # the next document; only grams of the windows between them are hashed anew
    run = w + k - 2
    own = own.withColumn("_m", F.when(F.col("n") >= k, F.greatest(F.col("_keep") - run, F.lit(0))).otherwise(F.lit(0)))
    own = own.withColumn("_m2", F.greatest(F.length("_new") - run, F.lit(0)))
    end = F.when(F.col("_m2") > 0, F.col("_keep") + (w - 1)).otherwise(_grams(F.col("_n2"), k))
    between = _let(F.encode("_edited", "UTF-32"), lambda raw: _keys(raw, F.col("_m"), end, k))
    # fewer than w grams are a window of their own only where no whole window lies in the kept part
    rest = _let(between, lambda x: F.when((F.col("_m") == 0) | (F.size(x) >= w), _window_minima(x, w)).otherwise(F.array().cast("array<bigint>")))
    beyond = F.transform(_of_first_windows(F.col("_there"), F.col("_m2"), w), lambda x: x - F.col("_keep"))
    own = own.withColumn("_kept2", F.array_distinct(F.concat(_of_first_windows(F.col("_kept"), F.col("_m"), w), rest, beyond)))
    own = own.withColumn("_hashes2", hashes(F.col("_kept2"), F.col("_edited"), k))
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return own.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        joined("_hashes").alias("fingerprint"),
        joined("_hashes2").alias("edited_fingerprint"),
        likeness(F.col("_hashes"), F.col("_hashes2")).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_hashes3")).alias("near_next"),
        F.size("_hashes").cast("long").alias("n_kept"),
        F.array_join(positions(F.col("_kept")).cast("array<string>"), ",").alias("positions"),
    )
