"""Language identification with interpolated Kneser-Ney character models.

For each language, a character model of order four is counted over all training documents, and no n-gram is dropped.
Discounted probabilities and back-off weights lie in sorted arrays of packed n-grams while these are counted and small
(`Model`), else in tables in the shared folder that are joined with the n-grams of blocks of texts (`Tables`); both give
the same figures. A text gets the language of lowest cross-entropy per character; a text that is worse under its best
language than nearly all training texts is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, free_name, held_by, lean, stored

ORDER = 4
SPACE = 32
CHUNK = 1 << 17  # characters of texts that are handled together in a task
SHIFT = np.uint64(16)
HELD = 1 << 19  # n-grams that a task holds before it sums them up, and sums before it gives them on


@held_by("langid")
@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """For each code point: its lower case if it is a letter, else a space; letters over U+FFFE share one code."""
    table = np.full(0x110000, SPACE, np.uint16)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = min(ord(low) if len(low) == 1 else c, 0xFFFE)
    return table


def _codes(text: str | None) -> np.ndarray:
    """Folded letters with single spaces between runs, a space first and last; empty without letters."""
    if not text:
        return np.empty(0, np.uint16)
    x = _folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    space = x == SPACE
    if space.all():
        return np.empty(0, np.uint16)
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    x = x[keep]
    return np.concatenate(([SPACE] * int(x[0] != SPACE), x, [SPACE] * int(x[-1] != SPACE))).astype(np.uint16)


def _grams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams ending at each character but the first of each part, and how many each part has.

    A part's first space follows three zeros, so no n-gram reaches over two parts.
    """
    pad = np.zeros(ORDER - 2, np.uint16)
    line = np.concatenate([y for x in parts for y in (pad, x)]) if parts else np.empty(0, np.uint16)
    sizes = np.array([max(len(x) - 1, 0) for x in parts], np.int64)
    wide = line.astype(np.uint64)
    packed = wide.copy()
    for k in range(1, ORDER):
        packed[k:] |= wide[:-k] << np.uint64(16 * k)
    starts = np.cumsum([0] + [len(x) + len(pad) for x in parts])[:-1] + len(pad)
    use = np.zeros(len(line), bool)
    for s, n in zip(starts, sizes):
        use[s + 1 : s + 1 + n] = True
    return packed[use], sizes


def _chunks(texts, extra) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Texts in groups of about CHUNK characters, with what belongs to each; a long text is a group of its own."""
    tags, parts, size = [], [], 0
    for tag, text in zip(extra, texts):
        x = _codes(text)
        tags.append(tag)
        parts.append(x)
        size += len(x)
        if size >= CHUNK:
            yield tags, parts
            tags, parts, size = [], [], 0
    if tags:
        yield tags, parts


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, gram (four packed characters), n: over all rows with text and language, summed in each task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for _, parts in _chunks(rows["text"], rows["text"]):
                    held.setdefault(lang, []).append(np.unique(_grams(parts)[0], return_counts=True))
                    size += len(held[lang][-1][0])
                    if size > HELD:
                        held = {x: [_summed(parts)] for x, parts in held.items()}
                        size = sum(len(parts[0][0]) for parts in held.values())
                        if size > HELD // 2:
                            yield from flushed(held)
                            held, size = {}, 0
        yield from flushed(held)

    def flushed(held: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            keys, n = _summed(parts)
            for k in range(0, len(keys), CHUNK):
                yield pd.DataFrame({"lang": lang, "gram": keys[k : k + CHUNK].view(np.int64), "n": n[k : k + CHUNK]})

    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    bounded_batches(docs.sparkSession)
    return source.mapInPandas(lean(count, "langid"), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys of several sorted lists of (key, count) and their summed counts."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


@dataclass
class Model:
    """grams[n]: sorted packed n-grams, seen[n]: their discounted probability by language; contexts and weights alike."""

    langs: list[str]
    alphabet: int
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    seen: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    reject_over: np.ndarray | None = None

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """For each packed four-gram and language, the log probability of the last character after the others."""
        p = np.full((len(keys), len(self.langs)), 1.0 / self.alphabet)
        for n in range(1, ORDER + 1):
            gram = keys & np.uint64((1 << (16 * n)) - 1)
            weight = _look(self.contexts[n], self.weights[n], gram >> SHIFT, 1.0)
            p = _look(self.grams[n], self.seen[n], gram, 0.0) + weight * p
        return np.log(p).astype(np.float32)


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], values[at], default)


def _fit(counts: pd.DataFrame, discount: float) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, distinct left neighbours below it."""
    langs = sorted(counts["lang"].unique())
    by = {x: counts[counts["lang"] == x] for x in langs}
    now = {x: (by[x]["gram"].to_numpy().view(np.uint64), by[x]["n"].to_numpy(np.float64)) for x in langs}
    model = Model(langs, 2 + len({int(k) & 0xFFFF for x in langs for k in np.unique(now[x][0] & np.uint64(0xFFFF))}))
    for n in range(ORDER, 0, -1):
        found, ahead = {}, {}
        for x in langs:
            keys, c = now[x]
            context = keys >> SHIFT
            head, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, c), np.bincount(at)
            found[x] = keys, np.maximum(c - discount, 0) / total[at]
            ahead[x] = head, discount * kinds / total
            lower, left = np.unique(keys & np.uint64((1 << (16 * (n - 1))) - 1), return_inverse=True) if n > 1 else (None, None)
            now[x] = (lower, np.bincount(left).astype(np.float64)) if n > 1 else (None, None)
        model.grams[n], model.seen[n] = _matrix(found, langs, 0.0)
        model.contexts[n], model.weights[n] = _matrix(ahead, langs, 1.0)
    return model


def _matrix(by: dict[str, tuple[np.ndarray, np.ndarray]], langs: list[str], default: float) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique(np.concatenate([by[x][0] for x in langs]))
    values = np.full((len(keys), len(langs)), default)
    for j, x in enumerate(langs):
        values[np.searchsorted(keys, by[x][0]), j] = by[x][1]
    return keys, values


@dataclass
class Tables:
    """The same model as tables: seen[n] (lang, gram, seen) and weights[n] (lang, context, weight), one row for each language."""

    langs: list[str]
    alphabet: int
    seen: dict[int, DataFrame] = field(default_factory=dict)
    weights: dict[int, DataFrame] = field(default_factory=dict)
    reject_over: np.ndarray | None = None

    def probabilities(self, wanted: DataFrame) -> DataFrame:
        """gram, p (by language, in order) of the distinct four-grams of `wanted`, which should be stored.

        Orders are joined from the lowest up, each over its distinct n-grams, so no key has more rows than the alphabet
        has letters.
        """
        langs = F.broadcast(wanted.sparkSession.createDataFrame(list(enumerate(self.langs)), "j int, lang string"))
        below = None
        for n in range(1, ORDER + 1):
            part = wanted.select(_tail("gram", n).alias("gram")).distinct().crossJoin(langs)
            part = part.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("lower", _tail("gram", n - 1))
            part = part.join(self.seen[n], ["lang", "gram"], "left").join(self.weights[n], ["lang", "context"], "left")
            part = part.withColumn("q", F.lit(1.0 / self.alphabet)) if below is None else part.join(below, ["lang", "lower"])
            p = F.coalesce("seen", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("q")
            part = part.select("lang", "j", "gram", p.alias("p"))
            below = part.select("lang", F.col("gram").alias("lower"), F.col("p").alias("q"))
        return part.groupBy("gram").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "p"))), lambda x: x["p"]).alias("p"))


def _tail(gram: str, n: int) -> Column:
    """The last n characters of a packed four-gram."""
    return F.col(gram) if n == ORDER else F.col(gram).bitwiseAND(F.lit((1 << (16 * n)) - 1).cast("long"))


def _tabled(counts: DataFrame, langs: list[str], discount: float) -> Tables:
    """_fit as groupBys and joins, for counts that are too many for the driver."""
    model = Tables(langs, 2 + counts.select(_tail("gram", 1)).distinct().count())
    now = counts
    for n in range(ORDER, 0, -1):
        now = now.withColumn("context", F.shiftrightunsigned("gram", 16))
        ahead = stored(now.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("kinds")), f"contexts{n}")
        found = now.join(ahead, ["lang", "context"])
        model.seen[n] = stored(found.select("lang", "gram", (F.greatest(F.col("n") - F.lit(discount), F.lit(0.0)) / F.col("total")).alias("seen")), f"seen{n}")
        model.weights[n] = ahead.select("lang", "context", (F.lit(discount) * F.col("kinds") / F.col("total")).alias("weight"))
        if n > 1:
            now = stored(now.groupBy("lang", _tail("gram", n - 1).alias("gram")).agg(F.count("*").alias("n")), f"grams{n - 1}")
    return model


def quantiles(values: DataFrame, q: float, by: str, value: str, cells: int = 1024) -> dict[str, float]:
    """The exact quantile of `value` for each `by`, as percentile() gives it; `values` should be stored.

    The two order statistics that it lies between are searched by histograms of `cells` cells over ever smaller ranges,
    so that neither a task nor the driver holds more than the cells.
    """
    span = values.filter(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
    at = {r[by]: (r["n"] - 1) * q for r in span}
    open_, found = {}, {}
    for r in span:
        for k in {int(np.floor(at[r[by]])), int(np.ceil(at[r[by]]))}:
            open_[r[by], k] = (r["low"], r["high"], k)  # the value is the k-th, from 0, of those from low to high
    while open_:
        found |= {key: low for key, (low, high, _) in open_.items() if low == high}
        open_ = {key: x for key, x in open_.items() if x[0] < x[1]}
        if not open_:
            break
        ranges = values.sparkSession.createDataFrame([(b, k, low, high) for (b, k), (low, high, _) in open_.items()], f"`{by}` string, _k long, _low double, _high double")
        inside = values.join(F.broadcast(ranges), by).filter(F.col(value).between(F.col("_low"), F.col("_high")))
        cell = F.least(F.floor((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")) * cells), F.lit(cells - 1))
        rows = inside.groupBy(by, "_k", cell.alias("_cell")).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        left = {key: k for key, (_, _, k) in open_.items()}
        for r in sorted(rows, key=lambda r: r["_cell"]):
            key = r[by], r["_k"]
            if 0 <= left[key] < r["n"]:
                open_[key] = (r["low"], r["high"], left[key])
            left[key] -= r["n"]
    return {x: found[x, int(np.floor(k))] * (1 - k % 1) + found[x, int(np.ceil(k))] * (k % 1) for x, k in at.items()}


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_held: int = 1_600_000, quantile: float = 0.999, margin: float = 1.0, discount: float = 0.75) -> Model | Tables | None:
    """A model from all rows of `docs` that have text and language; None if there are none.

    All n-grams of all rows count and are kept. While four-grams times languages are most_held or fewer, the model is
    collected and broadcast, else it stays in tables; the figures are the same. Rejection is calibrated on all training
    rows: the limit of each language is the given quantile of its cross-entropy plus a margin in nats.
    """
    counts = stored(gram_counts(docs, text_col, lang_col), "grams")
    sizes = {r["lang"]: r["m"] for r in counts.groupBy("lang").agg(F.count("*").alias("m")).collect()}
    if not sizes:
        return None
    model = _fit(counts.toPandas(), discount) if sum(sizes.values()) * len(sizes) <= most_held else _tabled(counts, sorted(sizes), discount)
    said = predict(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(), model).filter("lang_pred = lang").select("lang", "cross_entropy")
    limits = quantiles(stored(said, "calibration"), quantile, "lang", "cross_entropy")
    loosest = max(limits.values(), default=float(np.log(model.alphabet)))
    model.reject_over = np.array([limits.get(x, loosest) for x in model.langs]) + margin
    return model


Said = tuple[str, float, float | None, bool]


def _said(parts: list[np.ndarray], langs: list[str], log_probability, reject_over: np.ndarray | None) -> list[Said]:
    """lang_pred, score, cross_entropy, rejected of each coded text, given the log probabilities of packed four-grams."""
    k, out = len(langs), []
    nats, lengths = np.zeros((len(parts), max(k, 1))), np.array([max(len(x) - 1, 0) for x in parts])
    if k and lengths.sum():
        grams, sizes = _grams(parts)
        at, keys = pd.factorize(grams)
        table, owner = log_probability(keys), np.repeat(np.arange(len(sizes)), sizes)
        for j in range(k):
            nats[:, j] = -np.bincount(owner, table[at, j], len(sizes))
    for row, n in zip(nats, lengths):
        if not (k and n):
            out.append(("und", 0.0, None, True))
            continue
        best = int(row.argmin())
        share = 1.0 / np.exp(row.min() - row).sum()
        cross = row[best] / n
        out.append((langs[best], float(share), float(cross), bool(reject_over is not None and cross > reject_over[best])))
    return out


ADDED = ["lang_pred", "score", "cross_entropy", "rejected"]
ADDED_TYPES = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, model: Model | Tables | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (the share of the best language among all, 0 to 1), cross_entropy (nats a character), rejected.

    A null text and one without letters give `und`, score 0, a null cross_entropy and rejected true; so does every text
    without a model. Ties go to the language first in order. Whole texts are scored, a long one like any other.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ADDED]
    bounded_batches(spark)
    if isinstance(model, Tables):
        return _predict_by_tables(docs, columns, model, text_col)
    held = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = held.value
        for batch in batches:
            out = []
            for _, parts in _chunks(batch, batch):
                out += _said(parts, m.langs if m else [], m.log_probability if m else None, m.reject_over if m else None)
            yield pd.DataFrame(out, columns=ADDED)

    said = F.pandas_udf(lean(score, "langid"), ADDED_TYPES)
    held_as = free_name("_said", docs.columns)
    return docs.select(*columns, said(F.col(text_col).cast("string")).alias(held_as)).select(*columns, f"{held_as}.*")


def _predict_by_tables(docs: DataFrame, columns: list[str], model: Tables, text_col: str, block_bits: int = 10, alone_bytes: int = 65_536) -> DataFrame:
    """predict() for a model in tables: blocks of 2 ** block_bits rows meet the probabilities of their own four-grams.

    A text of more than alone_bytes is a block of its own, so a block has 64 MiB of texts at most, or one text.
    """
    langs, reject_over = model.langs, model.reject_over
    numbered = docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(columns)], F.col(text_col).cast("string").alias("_text"))
    numbered = stored(numbered.withColumn("_row", F.monotonically_increasing_id()).withColumn("_block", F.when(F.octet_length("_text") > alone_bytes, -1 - F.col("_row")).otherwise(F.shiftright("_row", block_bits))), "texts")

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, rows in batch.groupby("_block"):
                for _, parts in _chunks(rows["_text"], rows["_text"]):
                    yield pd.DataFrame({"_block": block, "gram": np.unique(_grams(parts)[0]).view(np.int64)})

    def score(texts: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        keys = table["gram"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        keys, p = keys[order], np.array(table["p"].tolist(), np.float64).reshape(-1, len(langs))[order]
        look = lambda wanted: np.log(p[np.searchsorted(keys, wanted)]).astype(np.float32)
        out = []
        for rows, parts in _chunks(texts["_text"], texts["_row"]):
            out += [(row, *x) for row, x in zip(rows, _said(parts, langs, look, reject_over))]
        return pd.DataFrame(out, columns=["_row", *ADDED])

    met = stored(numbered.select("_block", "_text").mapInPandas(distinct, "_block long, gram long").distinct(), "block_grams")
    table = met.join(model.probabilities(stored(met.select("gram").distinct(), "wanted")), "gram")
    said = numbered.select("_row", "_block", "_text").groupBy("_block").cogroup(table.groupBy("_block")).applyInPandas(score, f"_row long, {ADDED_TYPES}")
    out = numbered.join(said, "_row")
    return out.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)], *ADDED)
