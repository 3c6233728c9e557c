"""Removal of long repeated byte strings with suffix arrays made by two-stage sorting.

Each window of `length` bytes belongs to the smallest hash of the `gram`-byte strings inside it, so equal windows, in
whatever document, meet under the same anchor hash. Windows in a row with one anchor hash form a segment. Anchors that
occur once are dropped; segments that occur several times as a whole are repeats as a whole; the others are gathered
by anchor, a suffix array of each gathering is built, and windows whose common prefix with a neighbour in the array
reaches `length` bytes are repeats.

The suffix array takes two stages: suffixes smaller than their successors are sorted directly, all others are induced
from them by scanning the buckets of first bytes in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, held_by, lean, measured_side, stored
from panelforge.llm.shingles import BASE, INVERSE, U, mixed

CHUNK = 1 << 18  # bytes that are handled at once in a task
BUNDLE = 1 << 18  # bytes of segments that share a suffix array, but for the anchor that fills it up
HOT_BYTES = 1 << 22  # an anchor with more bytes of different segments is no single array: its windows are counted one by one


@held_by("suffix_dedup")
@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = np.full(2 * CHUNK, U(BASE)), np.full(2 * CHUNK, U(INVERSE))
    up[0] = down[0] = 1
    return mixed(np.arange(1, 257, dtype=np.uint64)), np.multiply.accumulate(up), np.multiply.accumulate(down)


def _sums(line: np.ndarray) -> np.ndarray:
    values, up, _ = _tables()
    sums = np.zeros(len(line) + 1, np.uint64)
    np.cumsum(values[line] * up[: len(line)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    """Hashes of the strings of `size` bytes from each start."""
    return mixed((sums[start + size] - sums[start]) * _tables()[2][start] + np.asarray(size, np.uint64))


def _minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    width = 1
    while 2 * width <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (w - width)], x[w - width :]) if width < w else x


def segments(texts: list[bytes], length: int, gram: int) -> pd.DataFrame:
    """text (its place in the list), start, windows, anchor, times (of the anchor in it), content: all segments."""
    line = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(texts)), sizes)
    w, n = length - gram + 1, len(line) - length + 1
    names = ["text", "start", "windows", "anchor", "times", "content"]
    if n <= 0:
        return pd.DataFrame({c: np.empty(0, np.int64) for c in names})
    sums = _sums(line)
    at = np.arange(len(line) - gram + 1)
    grams = _hashes(sums, at, gram)
    least = _minima(grams, w)
    valid = np.flatnonzero(owner[:n] == owner[length - 1 : length - 1 + n])
    if not len(valid):
        return pd.DataFrame({c: np.empty(0, np.int64) for c in names})
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) > 1) | (least[valid[1:]] != least[valid[:-1]]) | (owner[valid[1:]] != owner[valid[:-1]])
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(valid)))
    start, anchor = valid[head], least[valid[head]]
    inside = np.zeros(n + 1, np.int64)
    inside[1:] = np.cumsum(grams[:n] == least[:n])
    last = start + count - 1
    view = np.lib.stride_tricks.sliding_window_view(grams, w)
    times = inside[last] - inside[start]
    for k in range(0, len(last), 4_096):
        s = slice(k, k + 4_096)
        times[s] += (view[last[s]] == anchor[s, None]).sum(1)
    content = _hashes(sums, start, count + length - 1)
    return pd.DataFrame({"text": owner[start], "start": start - first[owner[start]], "windows": count, "anchor": anchor.view(np.int64), "times": times, "content": content.view(np.int64)})


def _groups(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts in groups of about CHUNK bytes: (places, byte offset of each part, parts). Longer texts come in parts that
    overlap by length - 1 bytes, so each window lies in one part."""
    places, offsets, parts, size = [], [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), CHUNK):
            part = text[at : at + CHUNK + length - 1]
            if size and size + len(part) > CHUNK:
                yield places, offsets, parts
                places, offsets, parts, size = [], [], [], 0
            places.append(k)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield places, offsets, parts


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """anchor, content, cls (MD5 of the text), start, windows, times, doc_id, copies: the segments of each text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [(x or "").encode("utf-8", "surrogatepass") for x in batch["text"]]
            keys = [hashlib.md5(x).digest() for x in texts]
            ids = batch["doc_id"].astype("Int64")
            one, copies = {}, {}
            for k, key in enumerate(keys):
                one.setdefault(key, k)
                copies[key] = copies.get(key, 0) + 1
            mine = list(one.values())
            for places, offsets, parts in _groups([texts[k] for k in mine], length):
                found = segments(parts, length, gram)
                at = found["text"].to_numpy()
                who = np.array([mine[p] for p in places])[at]
                found["start"] += np.array(offsets)[at]
                found["cls"] = [keys[k] for k in who]
                found["doc_id"] = ids.iloc[who].array
                found["copies"] = [copies[keys[k]] for k in who]
                yield found[["anchor", "content", "cls", "start", "windows", "times", "doc_id", "copies"]]

    return docs.mapInPandas(lean(read, "suffix_dedup"), "anchor long, content long, cls binary, start long, windows long, times long, doc_id long, copies long")


def _sorted_directly(line: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """`starts` in the order of the `depth` bytes from there: by eight bytes at once, groups of equals then by all."""
    raw = line.tobytes()
    padded = np.concatenate((line, np.zeros(8, np.uint8)))
    words = np.zeros(len(starts), np.uint64)
    for k in range(8):
        words <<= U(8)
        words |= padded[starts + k]
    order = np.argsort(words, kind="stable")
    ranked, starts = words[order], starts[order]
    cut = np.flatnonzero(np.diff(ranked) != 0) + 1
    first = np.concatenate(([0], cut))
    last = np.append(cut, len(starts))
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        starts[a:b] = sorted(starts[a:b].tolist(), key=lambda i: raw[i : i + depth])
    return starts


def suffix_order(line: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of `line` (bytes) in order, right as far as their first `depth` bytes.

    Stage one sorts the suffixes that are smaller than their successors. Stage two scans the buckets of first bytes
    upwards: a suffix found gives its predecessor, if that is greater than it, the next free place in its bucket.
    """
    n = len(line)
    if not n:
        return np.empty(0, np.int64)
    step = np.sign(line[1:].astype(np.int16) - line[:-1])
    where = np.where(step != 0, np.arange(n - 1, dtype=np.int32), np.int32(n))
    following = np.minimum.accumulate(where[::-1])[::-1] if n > 1 else where
    rising = np.zeros(n, bool)
    rising[: n - 1] = np.append(step, -1)[np.minimum(following, n - 1)] > 0
    direct = _sorted_directly(line, np.flatnonzero(rising), depth)
    heads = line[direct]
    waiting: dict[int, list[np.ndarray]] = {int(c): [] for c in np.unique(line)}
    waiting[int(line[-1])].append(np.array([n - 1]))
    order = []

    def give(found: np.ndarray, c: int) -> np.ndarray:
        """Sends the greater predecessors to their buckets; returns those of the same bucket."""
        before = found[found > 0] - 1
        before = before[~rising[before]]
        to = line[before]
        later = before[to > c]
        if len(later):
            to_later = line[later]
            ranked = np.argsort(to_later, kind="stable")
            cut = np.flatnonzero(np.diff(to_later[ranked], prepend=-1, append=256))
            for a, b in zip(cut[:-1], cut[1:]):
                waiting[int(to_later[ranked[a]])].append(later[ranked[a:b]])
        return before[to == c]

    for c in sorted(waiting):
        layer = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        while len(layer):
            order.append(layer)
            layer = give(layer, c)
        mine = direct[np.searchsorted(heads, c, "left") : np.searchsorted(heads, c, "right")]
        order.append(mine)
        give(mine, c)
    return np.concatenate(order)


def common_prefixes(line: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many leading bytes the suffixes a and b share, at most `most`; both must have `most` bytes."""
    shared = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    words = np.ndarray((max(len(line) - 7, 0),), "<u8", line.tobytes(), strides=(1,))
    done = 0
    while done + 8 <= most and len(alive):
        same = words[a[alive] + done] == words[b[alive] + done]
        shared[alive[same]] += 8
        differs = alive[~same]
        alive = alive[same]
        for k in range(7):  # the differing word: byte by byte
            if not len(differs):
                break
            differs = differs[line[a[differs] + shared[differs]] == line[b[differs] + shared[differs]]]
            shared[differs] += 1
        done += 8
    for k in range(most - done):
        alive = alive[line[a[alive] + done + k] == line[b[alive] + done + k]]
        shared[alive] += 1
    return shared


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, the places whose next `length` bytes also start at another place of any part."""
    sizes = np.array([len(p) + 1 for p in parts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    line = np.frombuffer(b"".join(p.translate(_SHIFT) + b"\0" for p in parts), np.uint8)
    left = np.repeat((first[1:] - 1).astype(np.int32), sizes)
    left -= np.arange(len(line), dtype=np.int32)
    order = suffix_order(line, length)
    order = order[left[order] >= length]
    del left
    full = common_prefixes(line, order[:-1], order[1:], length) >= length
    hit = np.zeros(len(order), bool)
    hit[:-1] |= full
    hit[1:] |= full
    places = np.sort(order[hit])
    cut = np.searchsorted(places, first)
    return [places[a:b] - f for a, b, f in zip(cut[:-1], cut[1:], first)]


_SHIFT = bytes(min(b + 1, 255) for b in range(256))  # UTF-8 has no bytes over 0xF4, so 0 is free for the ends


def _runs(places: np.ndarray) -> list[int]:
    """start, end, start, end, ... of the runs in sorted places."""
    if not len(places):
        return []
    new = np.flatnonzero(np.diff(places) > 1)
    return np.column_stack((places[np.concatenate(([0], new + 1))], places[np.concatenate((new, [len(places) - 1]))] + 1)).ravel().tolist()


def _sorted_repeats(found: DataFrame, length: int) -> DataFrame:
    """anchor, content, runs: repeated windows of the segments anchor, content, bytes, by suffix arrays."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, anchor = {}, 0, None
        for batch in batches:
            for a, c, raw in zip(batch["anchor"], batch["content"], batch["bytes"]):
                if size >= BUNDLE and a != anchor:
                    yield give(held)
                    held, size = {}, 0
                anchor = a
                if (a, c) not in held:
                    held[a, c] = bytes(raw)
                    size += len(raw)
        if held:
            yield give(held)

    def give(held: dict[tuple[int, int], bytes]) -> pd.DataFrame:
        rows = [(a, c, _runs(x)) for (a, c), x in zip(held, repeated_windows(list(held.values()), length))]
        return pd.DataFrame([r for r in rows if r[2]], columns=["anchor", "content", "runs"])

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(lean(search, "suffix_dedup"), "anchor long, content long, runs array<long>")


def _hashed_repeats(found: DataFrame, length: int) -> DataFrame:
    """As _sorted_repeats, for anchors with any number of segments: window hashes are counted by Spark."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, c, raw in zip(batch["anchor"], batch["content"], batch["bytes"]):
                for at in range(0, len(raw) - length + 1, CHUNK):
                    line = np.frombuffer(bytes(raw[at : at + CHUNK + length - 1]), np.uint8)
                    start = np.arange(len(line) - length + 1)
                    yield pd.DataFrame({"anchor": a, "content": c, "place": start + at, "window": _hashes(_sums(line), start, length).view(np.int64)})

    different = found.dropDuplicates(["anchor", "content"])
    windows = stored(different.mapInPandas(lean(spread, "suffix_dedup"), "anchor long, content long, place long, window long"), "windows")
    several = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).filter("n > 1").select("anchor", "window")
    hit = windows.join(several, ["anchor", "window"]).groupBy("anchor", "content").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return hit.select("anchor", "content", F.flatten(F.transform("places", lambda p: F.array(p, p + 1))).alias("runs"))


def deduplicated(docs: DataFrame, length: int = 400, gram: int = 64, hot_bytes: int = HOT_BYTES, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated, and kept (bytes) if keep_text.

    Texts are UTF-8 bytes, null is empty. Every byte is removed that lies in a string of `length` bytes which starts at
    another place too, in the same or another document; matches never cross documents. Repeated rows are documents of
    their own, so texts that occur twice go as a whole (if they are long enough). Texts under `length` bytes stay. A
    null doc_id is carried along. An empty table gives no rows; other columns are ignored. `repeated` is whether
    anything was removed. A text of any length is read in parts that overlap, so none is cut off.

    Anchors with up to hot_bytes of different segments get suffix arrays, so an array's memory is bounded. The windows of
    others, such as passages that a third of all documents hold, are counted by their hashes in Spark aggregates, which
    gives the same rows for any value of hot_bytes.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = stored(anchors(source, length, gram), "segments")
    own = found.groupBy("anchor", "content", "cls", "start").agg(F.min("doc_id").alias("doc_id"), F.max("windows").alias("windows"), F.max("times").alias("times"))
    kinds = own.groupBy("anchor", "content").agg(F.count("*").alias("m"), F.sum("times").alias("times"), F.max("windows").alias("windows"), F.min(F.struct("cls", "doc_id", "start")).alias("one"))
    kinds = stored(kinds, "kinds")
    heads = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("all"), F.sum(F.col("windows") + (length - 1)).alias("size")).filter("all > 1")
    shared = stored(kinds.join(heads, "anchor"), "shared")

    whole = shared.filter("m > 1").select("anchor", "content", F.array(F.lit(0).cast("long"), F.col("windows")).alias("runs"))
    wanted = shared.filter("kinds > 1 or m = 1").groupBy(F.col("one.doc_id").alias("_id"), F.col("one.cls").alias("cls"))
    wanted = stored(wanted.agg(F.collect_list(F.struct(F.col("one.start").alias("start"), "windows", "anchor", "content", (F.col("size") > hot_bytes).alias("hot"))).alias("wanted")), "wanted")

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for text, cls, asked in zip(batch["text"], batch["cls"], batch["wanted"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if hashlib.md5(raw).digest() != bytes(cls):
                    continue  # another text with the same id
                for w in asked:
                    rows.append((w["anchor"], w["content"], raw[w["start"] : w["start"] + w["windows"] + length - 1], w["hot"]))
                    size += len(rows[-1][2])
                    if size > CHUNK:
                        yield pd.DataFrame(rows, columns=["anchor", "content", "bytes", "hot"])
                        rows, size = [], 0
            yield pd.DataFrame(rows, columns=["anchor", "content", "bytes", "hot"])

    asked = source.join(measured_side(wanted, "40L * size(wanted)"), F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "cls", "wanted")
    parts = stored(asked.mapInPandas(lean(fetch, "suffix_dedup"), "anchor long, content long, bytes binary, hot boolean"), "parts")
    repeats = _sorted_repeats(parts.filter("not hot").drop("hot"), length)
    if parts.filter("hot").limit(1).count():
        repeats = repeats.unionByName(_hashed_repeats(parts.filter("hot").drop("hot"), length))
    single = shared.filter("m = 1").select("anchor", "content")
    repeats = stored(repeats.join(single, ["anchor", "content"], "left_semi").unionByName(whole), "repeats")

    spans = found.select("anchor", "content", "cls", "start").join(repeats, ["anchor", "content"]).groupBy("cls").agg(F.collect_set(F.struct("start", "runs")).alias("spans"))
    copies = found.filter("start = 0").groupBy("cls").agg(F.sum("copies").alias("copies")).filter("copies > 1")
    marks = spans.join(copies, "cls", "full").select(F.col("cls").alias("_cls"), "spans", (F.col("copies") > 1).alias("copied"))
    marks = measured_side(stored(marks, "marks"), "coalesce(aggregate(spans, 0L, (n, s) -> n + 32L + 8L * size(s.runs)), 0L)")
    keyed = source.withColumn("cls", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    joined = keyed.join(marks, F.col("cls") == F.col("_cls"), "left").select("doc_id", "text", "spans", "copied")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans, copied in zip(batch["text"], batch["spans"], batch["copied"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone = ([(0, len(raw))] if copied is True or copied == 1 else _merged(spans, length)) if raw else []
                keep, at = [], 0
                for a, b in gone:
                    keep.append(raw[at:a])
                    at = b
                kept = b"".join([*keep, raw[at:]])
                rows.append((len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), bool(gone), kept))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "repeated", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out if keep_text else out.drop(columns="kept")

    return joined.mapInPandas(lean(cut, "suffix_dedup"), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean" + ", kept binary" * keep_text)


def _merged(spans, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that the repeated windows of a text cover."""
    if spans is None:
        return []
    out: list[tuple[int, int]] = []
    pairs = sorted((s["start"] + a, s["start"] + b - 1 + length) for s in spans for a, b in zip(s["runs"][0::2], s["runs"][1::2]))
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
