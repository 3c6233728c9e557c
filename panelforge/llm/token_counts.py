"""Token counts of the sections of documents, by offset-mapped attribution.

A document is encoded once, as a whole. The lengths of its tokens give their character spans, the sections have spans
too, and both lists are in order, so the interval join is two binary searches. A token that crosses a boundary is
allocated by a stated rule:

* start: to the section that holds its first character;
* most: to the section that holds most of its characters, the earlier one of equals;
* split: to every section it touches, by the share of its characters there.

Under each rule the counts of a document's sections sum up to the document's tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, held_by, lean
from panelforge.llm.packing import SPECIAL, default_tokenizer, encode

RULES = ("start", "most", "split")


@held_by("tokens")
@lru_cache(maxsize=1)
def _sizes(ranks_path: str) -> np.ndarray:
    """Bytes of each token id; the special token follows the ranks."""
    with open(ranks_path, "rb") as f:
        ranks = {int(b): len(base64.b64decode(a)) for a, b in (line.split() for line in f)}
    return np.array([ranks[k] for k in range(len(ranks))] + [len(SPECIAL)], np.int64)


def token_spans(text: str, tokenizer: tuple[str, str, str]) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end) of each token; a token of some bytes of a character spans that character."""
    ids = encode(text, tokenizer)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(_sizes(tokenizer[1])[ids])
    return char[ends - _sizes(tokenizer[1])[ids]], char[ends - 1] + 1


def lines(text: str) -> list[int]:
    """Section starts: a section is a line with its line feed."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def attributed(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section, given token spans, section starts (the first is 0) and the rule."""
    counts = np.zeros(len(starts))
    a = np.searchsorted(starts, first, "right") - 1
    if rule == "start":
        return np.bincount(a, minlength=len(starts)).astype(float)
    b = np.searchsorted(starts, end - 1, "right") - 1
    whole = a == b
    counts += np.bincount(a[whole], minlength=len(starts))
    limits = np.append(starts, np.iinfo(np.int64).max)
    for k in np.flatnonzero(~whole):
        touched = np.arange(a[k], b[k] + 1)
        share = np.minimum(limits[touched + 1], end[k]) - np.maximum(limits[touched], first[k])
        if rule == "most":
            counts[touched[int(share.argmax())]] += 1
        else:
            counts[touched] += share / (end[k] - first[k])
    return counts


def section_tokens(docs: DataFrame, rule: str = "start", sections: Callable[[str], list[int]] = lines, tokenizer: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per section: doc_id, section (from 0), start, end (code points), n_tokens, doc_tokens.

    n_tokens is a double, whole under the rules start and most. A null or empty text is one empty section without
    tokens. Repeated rows each give their sections. A null doc_id is carried along; an empty table gives no rows; other
    columns are ignored. `sections` gives the rising section starts of a text, the first being 0.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}: {rule}")
    tokenizer = tokenizer or default_tokenizer()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts: dict[str, list] = {c: [] for c in ("doc_id", "section", "start", "end", "n_tokens", "doc_tokens")}
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                text = text or ""
                first, end = token_spans(text, tokenizer)
                starts = np.array(sections(text), np.int64)
                n = len(starts)
                parts["doc_id"] += [doc_id] * n
                parts["section"].append(np.arange(n))
                parts["start"].append(starts)
                parts["end"].append(np.append(starts[1:], len(text)))
                parts["n_tokens"].append(attributed(first, end, starts, rule))
                parts["doc_tokens"].append(np.full(n, len(first)))
            if parts["doc_id"]:
                yield pd.DataFrame({"doc_id": pd.array(parts.pop("doc_id"), "Int64")} | {c: np.concatenate(x) for c, x in parts.items()})

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    return source.mapInPandas(lean(count, "tokens"), "doc_id long, section long, start long, end long, n_tokens double, doc_tokens long")
