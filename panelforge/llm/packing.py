"""Packing token sequences into windows by minimum bin slack.

Documents are encoded once and cut into whole windows and one remainder. Remainders are packed by a plan made from the
histogram of their lengths alone: a bitset subset-sum over the lengths left picks, for the longest length left, the
multiset that comes closest to the capacity, and repeats it as often as the counts allow. The plan has at most a few
rows for each possible length, however many documents there are; documents find their window by their rank among the
pieces of the same length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, held_by, lean, stored
from panelforge.llm.hilbert import ranked

SPECIAL = "<|endoftext|>"


@held_by("tokens")
@lru_cache(maxsize=1)
def _fast_encoder(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@held_by("tokens")
@lru_cache(maxsize=1)
def _whole_encoder(json_path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def default_tokenizer() -> tuple[str, str, str]:
    """(vocabulary as JSON, the same vocabulary as ranks, split pattern) of the public byte-level tokenizer."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def encode(text: str | None, tokenizer: tuple[str, str, str]) -> np.ndarray:
    """The ids of a text, those of the JSON vocabulary's own encoder.

    The faster encoder gives the same ids. It knows no special token, and its pattern matching panics on white-space runs
    of about a million characters; the panic is no Exception. The JSON vocabulary's encoder takes such texts.
    """
    if not text:
        return np.empty(0, np.uint32)
    ids = None
    if SPECIAL not in text:
        try:
            ids = _fast_encoder(*tokenizer[1:]).encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, GeneratorExit):
            raise
        except BaseException:
            pass
    return np.array(_whole_encoder(tokenizer[0]).encode(text, add_special_tokens=False).ids if ids is None else ids, np.uint32)


def pieces(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids, with end_id last, cut every `window` ids."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = np.append(encode(text, tokenizer), np.uint32(end_id)).astype("<u4")
                raw, n = ids.tobytes(), len(ids)
                rows += [(doc_id, s, min(window, n - s), zlib.crc32(raw[4 * s : 4 * (s + window)]), n) for s in range(0, n, window)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bounded_batches(docs.sparkSession)
    return source.mapInPandas(lean(cut, "tokens"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The (length, copies) whose sum comes closest to the capacity from below, by a bitset over reachable sums."""
    full, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, batch = min(counts[length], capacity // length), 1
        while left > 0:  # copies in powers of two
            take = min(batch, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & full
            left, batch = left - take, batch * 2
        if reach >> capacity & 1:
            break
    at, picked = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            picked[length] = picked.get(length, 0) + take
            at -= length * take
    return sorted(picked.items(), reverse=True)


def plan(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, copies in a window, windows, first window, offset) for all pieces of the histogram.

    Each round fixes the longest length left and repeats its best multiset until one of its lengths runs short, so the
    number of rounds is bounded by the number of lengths, not of pieces.
    """
    left, used, rows, window_id = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = {k: v - (k == longest) for k, v in left.items() if v > (k == longest)}
        chosen = dict(fill(rest, window - longest))
        chosen[longest] = chosen.get(longest, 0) + 1
        times, offset = min(left[k] // m for k, m in chosen.items()), 0
        for length, copies in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], copies, times, window_id, offset))
            offset += length * copies
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        window_id += times
    return rows


def packed(docs: DataFrame, window: int = 2048, end_id: int = 1, tokenizer: tuple[str, str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the single id end_id. Repeated rows are packed one by one. An empty table gives no rows.
    Only the histogram of lengths (at most `window` rows) and the plan pass the driver.
    """
    cut = stored(pieces(docs, window, end_id, tokenizer, id_col, text_col), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    before, start = 0, {}
    for length in sorted(counts):
        start[length] = before
        before += counts[length]
    schema = "length long, first long, copies long, times long, window_id long, base long"
    rows = [(k, start[k] + first, copies, times, at, base) for k, first, copies, times, at, base in plan(counts, window)]
    table = docs.sparkSession.createDataFrame(rows, schema)
    order = ranked(cut.withColumn("_length", F.col("length").cast("int")), "_length", ["doc_id", "start", "ids_crc32", "doc_tokens"], before).drop("_length")
    k = F.col("rank") - F.col("first")
    return (
        order.alias("p")
        .join(F.broadcast(table).alias("t"), (F.col("p.length") == F.col("t.length")) & (k >= 0) & (k < F.col("copies") * F.col("times")))
        .select(
            "doc_id",
            "start",
            "p.length",
            "ids_crc32",
            "doc_tokens",
            (F.col("window_id") + F.floor(k / F.col("copies"))).alias("sequence_id"),
            (F.col("base") + (k % F.col("copies")) * F.col("p.length")).alias("offset"),
        )
    )
