"""Secret scans whose false positives a random forest removes.

Candidates are runs of eight or more key-like characters that have a digit, a known prefix, upper case after lower case,
or sixteen capitals in a row; and whatever is assigned to a secret word (after = or :), of
six or more characters of any kind, up to the closing quote or else to the next space. Plain words that nothing is
assigned to are none. A forest over a candidate's length, its character transitions, how much of it dictionary words
cover, the path it was found under and the words beside it tells secrets from placeholders, checksums, numbers, versions
and names. The forest is trained by Spark's own learner on labelled
findings; inside tasks its trees are plain arrays.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_batches, free_name, lean

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=\-]{8,}+")
DIGIT, LOWER, CAPITALS = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]{16}")
WORD = re.compile(r"[A-Za-z]{2,}")
NEAR = 32  # characters of context on either side

# Words that stand beside secrets, beside harmless strings, and in paths of samples.
SECRET_WORDS = frozenset("access api apikey auth authorization aws bearer client credential credentials key passphrase passwd password private pwd secret session token".split())
HARMLESS_WORDS = frozenset("build card checksum commit date digest doc etag example file hash id image invoice isbn md5 order page phone placeholder ref release revision serial sha sha1 sha256 sample test tracking uuid version".split())
SAMPLE_PATHS = frozenset("demo doc docs example examples fixture fixtures lock mock sample samples spec test tests vendor".split())
DICTIONARY = frozenset(
    "abc access account admin alpha api app article auth backup base beta build card change changeme client cloud code config conf control core count data date default demo dev "
    "document dummy email en example file fill final first form group home http https image index info insert item key latest list live local login long main manager master message "
    "model module name new none note null number old order page pass password path placeholder port private prod product project public qwerty read release remote report request "
    "room root sample script secret section server service session setting site source stage staging string style system table team temp test text time title token tool type update "
    "upload url user value version video web welcome word xxx year your".split()
)
FEATURES = ["length", "digits", "uppers", "separators", "transitions", "bigram", "entropy", "coverage", "hexlike", "sample_path", "secret_beside", "harmless_beside", "assigned", "quoted", "known_prefix"]
PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-")

KNOWN = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_|xox[abprs]-|sk[-_]|AIza|eyJ|glpat-")
_NAMES = sorted(SECRET_WORDS, key=lambda w: (-len(w), w))
ASSIGNED = re.compile(
    "(?:(?<![A-Za-z])(?i:" + "|".join(_NAMES) + ")|(?<=[a-z])(?:" + "|".join(w.title() for w in _NAMES) + "))"
    r"[\"']?[ \t]{0,3}(?:=>|:=|==?|:)[ \t]{0,3}"
    r"(?:\"((?:[^\"\\\n]|\\.){6,})\"|'((?:[^'\\\n]|\\.){6,})'|([^\s\"'`,;<>(){}\[\]]{6,}))"
)
NEXT_FIELD = re.compile(r"&[A-Za-z_]+=")

_CLASS = np.full(128, 3, np.int8)  # other signs count as separators
for _k, _set in enumerate((string.digits, string.ascii_uppercase, string.ascii_lowercase, "+/_=-")):
    _CLASS[[ord(c) for c in _set]] = _k


def _bigrams() -> np.ndarray:
    """Log probabilities of neighbouring letters in dictionary words, smoothed."""
    n = np.ones((26, 26))
    for word in sorted(DICTIONARY | SECRET_WORDS | HARMLESS_WORDS):
        letters = [ord(c) - 97 for c in word if "a" <= c <= "z"]
        for a, b in zip(letters, letters[1:]):
            n[a, b] += 1
    return np.log(n / n.sum(1, keepdims=True))


_BIGRAM = _bigrams()
_STARTS = frozenset(w[:3] for w in DICTIONARY)


def key_like(raw: str) -> bool:
    """Whether a run has a digit, upper case after lower case, or sixteen capitals in a row. One pass for each."""
    first = LOWER.search(raw)
    later = raw[first.end() :] if first else ""
    return bool(DIGIT.search(raw)) or later != later.lower() or bool(CAPITALS.search(raw))


def _coverage(low: str) -> float:
    """The share of characters inside the longest dictionary words found from left to right."""
    at, covered = 0, 0
    while at < len(low):
        size = next((n for n in range(min(11, len(low) - at), 2, -1) if low[at : at + n] in DICTIONARY), 0) if low[at : at + 3] in _STARTS else 0
        covered += size
        at += size or 1
    return covered / len(low)


def features(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The forest's inputs for one candidate, given the text on either side and the path it was found under."""
    raw = np.frombuffer(candidate.encode("ascii", "replace"), np.uint8) & 127
    kind = _CLASS[raw]
    n = len(raw)
    low = candidate.lower()
    letters = np.frombuffer(low.encode("ascii", "replace"), np.uint8).astype(np.int64) - 97
    both = (letters[:-1] >= 0) & (letters[:-1] < 26) & (letters[1:] >= 0) & (letters[1:] < 26)
    share = np.bincount(raw, minlength=128) / n
    share = share[share > 0]
    beside = [w.lower() for w in WORD.findall(before)[-3:]] + [w.lower() for w in WORD.findall(after)[:2]] + [w.lower() for w in WORD.findall(candidate.split("=")[0])] * ("=" in candidate[:-2])
    head = before.rstrip("\"'` ")
    return [
        float(n),
        float((kind == 0).mean()),
        float((kind == 1).mean()),
        float((kind == 3).mean()),
        float((kind[1:] != kind[:-1]).mean()),
        float(_BIGRAM[letters[:-1][both], letters[1:][both]].mean()) if both.any() else -4.0,
        float(-(share * np.log2(share)).sum()),
        _coverage(low),
        float(bool(re.fullmatch(r"[0-9a-f]+", candidate))),
        float(bool({w.lower() for w in WORD.findall(path)} & SAMPLE_PATHS)),
        float(bool(set(beside) & SECRET_WORDS)),
        float(bool(set(beside) & HARMLESS_WORDS)),
        float(head.endswith(("=", ":")) or "=" in candidate[1:-2]),
        float(before.endswith(("\"", "'")) and after.startswith(("\"", "'"))),
        float(bool(PREFIX.match(candidate))),
    ]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, candidate) in order. A name and its value in one run, as in password=..., are cut to the value.

    An assigned value and the runs inside it are candidates of their own.
    """
    found = {}
    for m in CANDIDATE.finditer(text):
        start, end, raw = m.start(), m.end(), m[0]
        name, sign, value = raw.partition("=")
        if sign and value.strip("=") and WORD.fullmatch(name.replace("_", "").replace("-", "")):
            start, raw = start + len(name) + 1, value
        if len(raw) >= 8 and (key_like(raw) or KNOWN.search(raw)):
            found[start, end] = raw
    for m in ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        if m.lastindex == 3 and (field := NEXT_FIELD.search(text, start, end)):
            end = field.start()
        if end - start >= 6:
            found[start, end] = text[start:end]
    return [(a, b, raw) for (a, b), raw in sorted(found.items())]


def labelled_findings(rows: int = 4_000, seed: int = 11) -> pd.DataFrame:
    """candidate, before, after, path, label: findings made by rule, half of them secrets (label 1).

    A user with findings of their own passes those to train() instead. The bound of the training sample is `rows`.
    """
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    run = lambda chars, n: "".join(chars[i] for i in r.integers(0, len(chars), n))
    alnum, hexes, upper = string.ascii_letters + string.digits, "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    words, plain = sorted(DICTIONARY), ["the", "of", "und", "que", "les", "with", "from", "nicht", "dans", "para", "then", "an"]
    prose = lambda: " ".join(pick(plain) for _ in range(4))
    out = []
    for k in range(rows):
        secret = k % 2
        path = pick(["src/main.py", "app/settings.py", "deploy/env.sh", "notes.txt", "web/main.js", ""] if secret or r.random() < 0.7 else ["tests/test_login.py", "docs/example.md", "package.lock", "fixtures/sample.json"])
        before, after = prose() + " ", " " + prose()
        if secret:
            form = int(r.integers(9))
            value = [
                lambda: pick(["AKIA", "ASIA"]) + run(upper, 16),
                lambda: run(hexes, pick([16, 18, 20, 24, 32, 40, 64])),
                lambda: run(alnum, int(r.integers(12, 48))),
                lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-", "AIza"]) + run(alnum, int(r.integers(20, 38))),
                lambda: run(alnum + "+/", int(r.integers(24, 64))) + pick(["", "=", "=="]),
                lambda: "eyJ" + run(alnum + "_-", int(r.integers(30, 120))),
                lambda: run(string.ascii_letters if r.random() < 0.5 else string.ascii_lowercase, int(r.integers(8, 32))),
                lambda: run(alnum + "!?$%&*#@.+-_", int(r.integers(8, 24))),
                lambda: pick([" ", "-", "_", "."]).join(run(string.ascii_lowercase, int(r.integers(3, 9))) for _ in range(int(r.integers(3, 6)))),
            ][form]()
            if form in (1, 2, 4, 6, 7, 8):
                name, sign = pick(sorted(SECRET_WORDS)), pick(["=", " = ", ": ", ":"])
                quote = pick(["\"", "'"] if " " in value else ["", "\"", "'"])
                before, after = f"{before}{name}{sign}{quote}", quote + after
        else:
            value = [
                lambda: pick(["your_", "my-", "insert_", "example_"]) + pick(words) + pick(["_", "-"]) + pick(words) + run(string.digits, int(r.integers(1, 4))),
                lambda: pick(words) + pick(words) + run(string.digits, int(r.integers(1, 5))),
                lambda: run(string.digits, int(r.integers(8, 20))),
                lambda: f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}",
                lambda: "-".join(run(hexes, n) for n in (8, 4, 4, 4, 12)),
                lambda: run(hexes, pick([32, 40, 64])),
                lambda: pick(["x", "X", "0"]) * int(r.integers(8, 24)) + "1",
                lambda: pick(words) + "/" + pick(words) + "/" + pick(words) + run(string.digits, 2),
                lambda: pick(words) + "-" + str(r.integers(1, 9)) + "-" + str(r.integers(1, 99)) + "-" + pick(words),
                lambda: "".join(pick(plain) for _ in range(int(r.integers(3, 7)))) + run(string.digits, int(r.integers(1, 3))),
                lambda: pick(words) + pick(words).title() + pick(["", pick(words).title()]),
                lambda: pick(["required", "optional", "missing", "invalid", "expired", "unknown", "nothing"]) if r.random() < 0.5 else pick(words) + pick(["_", "-", ""]) + pick(words),
                lambda: " ".join(pick(words + plain) for _ in range(int(r.integers(2, 7)))),
                lambda: "".join(pick(words + plain)[: int(r.integers(3, 9))] for _ in range(12))[: int(r.integers(16, 28))].upper(),
                lambda: (lambda w: w[: len(w) // 2].upper() + w[len(w) // 2 :])("".join(pick(words + plain) for _ in range(int(r.integers(3, 5))))),
            ]
            form = int(r.integers(len(value)))
            value = value[form]()
            if form in (13, 14):  # capitals in running text, with nothing assigned
                pass
            elif form == 5 or r.random() < 0.3:
                before = f"{before}{pick(sorted(HARMLESS_WORDS))}{pick(['=', ' = ', ': ', ' '])}"
            elif form in (11, 12) or (form in (0, 1, 6, 10) and r.random() < 0.6):
                quote = pick(["\""] if " " in value else ["", "\""])
                before, after = f"{before}{pick(sorted(SECRET_WORDS))}{pick(['=', ' = ', ': '])}{quote}", quote + after
        out.append((value, before[-NEAR:], after[:NEAR], path, secret))
    return pd.DataFrame(out, columns=["candidate", "before", "after", "path", "label"])


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at leaves), threshold, left and right child, share of secrets at the leaf."""

    feature: list[np.ndarray]
    threshold: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    share: list[np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees, for each row of x."""
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in zip(self.feature, self.threshold, self.left, self.right, self.share):
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                rows = np.flatnonzero(inner)
                node = at[rows]
                at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
            total += share[at]
        return total / max(len(self.feature), 1)


def train(spark: SparkSession, labelled: pd.DataFrame | None = None, trees: int = 30, depth: int = 8, seed: int = 11) -> Forest:
    """A forest from labelled findings (candidate, before, after, path, label); the made ones if none are given."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = labelled_findings() if labelled is None else labelled
    rows = [features(c, b, a, p) for c, b, a, p in zip(labelled["candidate"], labelled["before"], labelled["after"], labelled["path"])]
    table = pd.DataFrame(rows, columns=FEATURES).assign(label=labelled["label"].astype(float).to_numpy())
    frame = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(spark.createDataFrame(table).coalesce(2))
    fitted = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(frame.select("features", "label"))
    forest = Forest([], [], [], [], [])
    for tree in fitted.trees:
        arrays: list[list] = [[], [], [], [], []]

        def visit(node) -> int:
            at = len(arrays[0])
            for x in arrays:
                x.append(0)
            if node.subtreeDepth() == 0:
                stats = list(node.impurityStats().stats())
                arrays[0][at], arrays[4][at] = -1, stats[1] / max(sum(stats), 1e-9)
            else:
                arrays[0][at], arrays[1][at] = node.split().featureIndex(), node.split().threshold()
                arrays[2][at], arrays[3][at] = visit(node.leftChild()), visit(node.rightChild())
            return at

        visit(tree._call_java("rootNode"))
        for held, x, kind in zip((forest.feature, forest.threshold, forest.left, forest.right, forest.share), arrays, (np.int64, float, np.int64, np.int64, float)):
            held.append(np.array(x, kind))
    return forest


def scan(text: str | None, path: str | None, forest: Forest, threshold: float = 0.5) -> tuple[int, list[tuple[int, int, float]]]:
    """(number of candidates, (start, end, probability) of those that are secrets) of one text; overlapping ones are one."""
    found = candidates(text) if text else []
    if not found:
        return 0, []
    rows = [features(raw, text[max(0, a - NEAR) : a], text[b : b + NEAR], path or "") for a, b, raw in found]
    said = forest.probability(np.array(rows))
    secrets: list[tuple[int, int, float]] = []
    for (a, b, _), p in zip(found, said):
        if p < threshold:
            continue
        if secrets and a < secrets[-1][1]:
            start, end, before = secrets.pop()
            secrets.append((start, max(end, b), max(before, float(p))))
        else:
            secrets.append((a, b, float(p)))
    return len(found), secrets


def scanned(docs: DataFrame, forest: Forest, threshold: float = 0.5, mask: str = "[SECRET]", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with n_candidates, n_secrets, secrets (start, end in code points, probability; in order) and redacted.

    `redacted` is the text with each secret replaced by `mask`. A null text has no candidates and stays null, an empty
    one stays empty; a null path has no words. An empty table gives no rows. Whole texts are read. Columns of docs with these names are replaced;
    repeated rows are handled one by one.
    """
    added = ["n_candidates", "n_secrets", "secrets", "redacted"]
    held = docs.sparkSession.sparkContext.broadcast(forest)  # a fixed number of small trees

    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, paths in batches:
            rows = []
            for text, path in zip(texts, paths):
                n, secrets = scan(text, path, held.value, threshold)
                parts, at = [], 0
                for a, b, _ in secrets:
                    parts += [text[at:a], mask]
                    at = b
                spans = [{"start": a, "end": b, "probability": p} for a, b, p in secrets]
                rows.append((n, len(secrets), spans, "".join([*parts, text[at:]]) if secrets else text))
            yield pd.DataFrame(rows, columns=added)

    path: Column = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    bounded_batches(docs.sparkSession)
    said = F.pandas_udf(lean(read, "secret_scan"), "n_candidates long, n_secrets long, secrets array<struct<start: long, end: long, probability: double>>, redacted string")
    names = [c for c in docs.columns if c not in added]
    held_as = free_name("_said", docs.columns)
    return docs.select(*names, said(F.col(text_col).cast("string"), path).alias(held_as)).select(*names, f"{held_as}.*")


def redacted(docs: DataFrame, forest: Forest, threshold: float = 0.5, text_col: str = "text", path_col: str = "source") -> DataFrame:
    """docs with secrets masked in the text, and n_chars (if there is one) counted anew."""
    out = scanned(docs, forest, threshold, text_col=text_col, path_col=path_col).withColumn(text_col, F.col("redacted"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
