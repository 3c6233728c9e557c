"""Ranked lexical search by sort-based accumulation.

A first pass turns each document into its length and the counts of those terms that the items hold, a table much smaller
than the texts; document frequencies are plain aggregates of it. The second pass reads that table. For every posting of a
document, the items that hold its term are looked up and (item, document, impact) arrays concatenated; a radix sort of
the packed (item, document) keys brings the impacts of a pair together, and `numpy.add.reduceat` sums them. Keys are cut
into ranges of documents, each small enough for one sort, so memory is bounded whatever a document or term holds. Tasks
keep a heap of the k best documents of each item; the heads of all tasks are ranked once more by item.

Items pass the driver in chunks of `chunk_terms` postings, each searched in all documents.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelforge.llm.common import bounded_batches, lean, shared_dir, stored

PAIRS = 2_000_000  # (item, document, impact) entries of one sort
WORD = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(0x80, 0x100))
FORM = bytes(c if c in WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))  # A-Z lower-cased, what is no term a space


def terms(text: str | None) -> list[bytes]:
    """The terms of a text as UTF-8: runs of ASCII digits and letters and of all other code points from 0x80 on, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FORM).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned 64-bit keys, by 16-bit digits from the lowest; digits that are alike everywhere are left out."""
    order = np.arange(len(keys))
    if not len(keys):
        return order
    differ = int(np.bitwise_or.reduce(keys ^ keys[0]))
    for shift in range(0, 64, 16):
        if differ >> shift & 0xFFFF:
            digit = (keys[order] >> np.uint64(shift)).astype(np.uint16)  # numpy sorts 16-bit integers by radix
            order = order[np.argsort(digit, kind="stable")]
    return order


class _Items:
    """The terms of a chunk of items, and for each term the items that hold it and how often."""

    def __init__(self, rows: list):
        counts = [Counter(terms(r["text"])) for r in rows]
        self.vocabulary: dict[bytes, int] = {}
        for c in counts:
            for t in c:
                self.vocabulary.setdefault(t, len(self.vocabulary))
        at = [(self.vocabulary[t], k, n) for k, c in enumerate(counts) for t, n in c.items()]
        at = np.array(sorted(at), np.int64).reshape(-1, 3)
        self.start = np.searchsorted(at[:, 0], np.arange(len(self.vocabulary) + 1))
        self.item, self.times = at[:, 1].astype(np.uint64), at[:, 2].copy()
        self.n_items = len(rows)


def _postings(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms (numbers in the items' vocabulary) and tfs of every document."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, at, tfs = [], [[]], [[]]
            for text in batch.column("text"):
                words = terms(text.as_py())
                sizes.append(len(words))
                found = [(k, n) for t, n in Counter(words).items() if (k := number(t)) is not None]
                at.append([k for k, _ in found])
                tfs.append([n for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(at[1:], pa.list_(pa.int32())), pa.array(tfs[1:], pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(lean(index, "lexical_search"), "id long, n long, terms array<int>, tfs array<long>")


def _heads(postings: DataFrame, shared, total: int, length: int, k: int) -> DataFrame:
    """item, id, score of the k best documents of each item in each task."""

    def accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        best: dict[int, list] = {}
        bar = np.ones(items.n_items, np.int64)  # the score that a document needs to be kept
        held = items.start[1:] - items.start[:-1]
        for batch in batches:
            n = batch.column("n").to_numpy()
            offsets = batch.column("terms").offsets.to_numpy()
            term = batch.column("terms").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tfs").flatten().to_numpy()
            doc = np.repeat(np.arange(len(n)), np.diff(offsets))
            m = 25 + (75 * n * total) // max(length, 1)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            useful = impact > 0
            term, doc, impact = term[useful], doc[useful], impact[useful]
            upto = np.cumsum(held[term])
            ids = batch.column("id").to_pylist()
            a = 0
            while a < len(term):  # a range of postings, cut at a document, with a bounded number of entries
                b = int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right"))
                b = max(b, a + 1)
                if b < len(term):
                    cut = int(np.searchsorted(doc, doc[b]))
                    b = cut if cut > a else int(np.searchsorted(doc, doc[b], "right"))
                for item, d, score in zip(*_summed(items, held, term[a:b], doc[a:b], impact[a:b], bar, k)):
                    heap, entry = best.setdefault(item, []), (score, *((0, 0) if ids[d] is None else (1, -ids[d])))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        bar[item] = heap[0][0]
                a = b
        rows = [(item, -x if known else None, score) for item, heap in best.items() for score, known, x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["item", "id", "score"])

    return postings.mapInArrow(lean(accumulate, "lexical_search"), "item long, id long, score long")


def _summed(items: _Items, held: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, bar: np.ndarray, k: int) -> tuple[list, list, list]:
    """item, place of the document in the batch, score of the pairs that reach the item's bar."""
    many = held[term]
    at = np.repeat(items.start[term] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    keys = items.item[at] << np.uint64(32) | np.repeat(doc, many).astype(np.uint64)
    values = np.repeat(impact, many) * items.times[at]
    order = radix_order(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    score, keys = np.add.reduceat(values, first), keys[first]
    item = (keys >> np.uint64(32)).astype(np.int64)
    keep = score >= bar[item]
    return item[keep].tolist(), (keys[keep] & np.uint64(0xFFFFFFFF)).tolist(), score[keep].tolist()


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chunk_terms: int = 1_000_000) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item with a score above 0, all if there are fewer.

    Terms are runs of ASCII letters and digits and of code points from 0x80 on, A-Z lower-cased. With N documents that
    have terms, L terms in all, n terms in a document, a term's df and tf: weight floor(1000 * ln((2N+2)/(2df+1))), and a
    document scores the sum over the item's terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m)) with
    m = 25 + 75 n N div L. Equal scores are ranked by ascending doc_id.

    Nulls: null and empty texts have no terms and never rank; a null doc_id ranks after all others of its score; a null
    item_id is kept. Repeated rows are rows of their own: a repeated document ranks twice, a repeated item has its own
    rows. Empty tables give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = items.schema[item_col].dataType.simpleString()
    path, schema = f"{shared_dir(spark)}/ranked-{uuid.uuid4().hex}", f"item_id {kind}, rank int, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    waiting, size = [], 0
    for r in items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).toLocalIterator():
        waiting.append(r)
        size += len(set(terms(r["text"])))
        if size >= chunk_terms:
            _search_chunk(docs, waiting, kind, k, id_col, text_col).write.mode("append").parquet(path)
            waiting, size = [], 0
    if waiting:
        _search_chunk(docs, waiting, kind, k, id_col, text_col).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _search_chunk(docs: DataFrame, rows: list, kind: str, k: int, id_col: str, text_col: str) -> DataFrame:
    """The result rows of one chunk of items."""
    spark, items = docs.sparkSession, _Items(rows)
    postings = stored(_postings(docs, spark.sparkContext.broadcast(items.vocabulary), id_col, text_col), "postings")
    total, length = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(len(items.vocabulary), np.int64)
    for t, df in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():  # one row a term of the chunk
        weight[t] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    items.vocabulary = {}
    heads = _heads(postings, spark.sparkContext.broadcast((items, weight)), total, length, k)
    w = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    best = heads.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item long, item_id {kind}")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")
