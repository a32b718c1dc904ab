"""Secrets in texts, false positives removed by a random forest.

Candidates are private key blocks as a whole; values of six characters or more assigned to names like ``password`` or
``DB_PASSWORD``, of any length, in quotes also with blanks, without them up to a blank, a quote, a comma, a semicolon, an angle
bracket or the next ``&name=``; and elsewhere runs of 16 key-like characters or more with a digit or a change of case. The
forest sees a candidate's length, how its characters follow each other, how much of it dictionary words cover, the path it
comes from, and the words beside it. It is trained on labelled findings: those given, or FINDINGS made from rules with a
fixed seed, as no table labels secrets - tokens of common formats beside the words that go with them, and what scanners take
for such: digests, identifiers, placeholders, numbers, names, sentences.

Defined cases: a null text or path is empty; a null doc_id and repeated rows each come out; an empty table gives no
rows; a document without a candidate gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import table

#: Findings made for training; also the most that are taken of those given.
FINDINGS = 8000
TREES, DEPTH, LEAF = 40, 8, 4
THRESHOLD = 0.5
NEAR = 48

_RUN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_VALUE = re.compile(
    r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:password|passwd|pwd|secret|token|api_?key|key)\b[\"']?\s{0,3}(?:=>|:=|==?|:)\s{0,3}"
    r"(?:\"([^\"\r\n]{6,})\"|'([^'\r\n]{6,})'|([^\"'\s&<>,;=](?:[^\"'\s&<>,;]|&(?!\w+=)){5,}))"
)
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
#: What may stand before such a name and belong to it.
_PREFIX = re.compile(r"[A-Za-z0-9_.-]*\Z")
_MIXED = re.compile(r"[0-9]|[a-z][A-Z][a-z]*[A-Z]")
_PIECE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")
_ASSIGNED = re.compile(r"[=:]\s*[\"']?$")

_SECRET_WORDS = frozenset("token secret password passwd pwd key apikey api_key auth credential credentials bearer private access login authorization".split())
_OTHER_WORDS = frozenset("sha sha1 sha256 md5 checksum digest hash commit revision etag uuid guid id isbn version example sample test dummy placeholder fixture order invoice serial http https www image blob".split())
_PATH_WORDS = frozenset("test tests testdata example examples sample samples fixture fixtures doc docs mock mocks vendor lock".split())
_DICTIONARY = frozenset(
    "able access account action address admin agent alert alpha array author backend base batch beta block book branch build button cache call case change channel check class client close cloud code column command commit common company config connect content context control copy core count create data database date debug default delete demo design detail device direct document domain double down dummy email enable engine error event example export feature field file filter final first folder form format forward frame free front function future gateway general global graph green group handle header health hello help history home host image import index info input insert instance integer internal item java join json just kernel label language last layer left level library light like limit line link list load local lock login main make manager map master match media member memory menu message method model module monitor move name native network next node note number object offer office open option order output owner package page panel parent part path pattern people phone plain point policy pool port post power press price private product profile project public query queue random range read record release remote report request resource response result return right river role root route rule sample schema score screen script search second secure select send server service session setting shared short simple single size small social source space spark stage start state static status step store stream string style system table target task team template test text theme thread time title token tool topic total track tree type under unit update upload user value version video view water web white window word work world write your zone".split()
)


def entropy(text: str) -> float:
    _, n = np.unique(np.frombuffer(text.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _kind(c: str) -> int:
    return 0 if c in string.digits else 1 if "a" <= c <= "f" else 2 if c.islower() else 3 if c.isupper() else 4


FEATURES = ("length", "log length", "entropy", "entropy share", "digits", "capitals", "signs", "hex", "kind changes", "repeats", "steps", "covered", "longest word", "bad path", "secret words", "other words", "assigned", "quoted", "dashes")


def features(found: str, before: str, after: str, path: str) -> list[float]:
    """The forest's view of a candidate."""
    n, kinds = len(found), np.array([_kind(c) for c in found])
    codes = np.array([ord(c) for c in found])
    step = np.diff(codes)
    words = [w for w in _PIECE.findall(found)]
    covered = sum(len(w) for w in words if w.lower() in _DICTIONARY or len(w) > 3 and not re.search("[bcdfghjklmnpqrstvwxz]{4}", w.lower()) and re.search("[aeiou]", w.lower()))
    beside = re.findall(r"[a-z0-9_]+", before.lower())[-4:]
    near = [*beside, *re.findall(r"[a-z0-9_]+", after.lower())[:2]]
    e = entropy(found)
    return [
        n, log2(n), e, e / max(1.0, log2(min(n, 64))), float((kinds == 0).mean()), float((kinds == 3).mean()), float((kinds == 4).mean()),
        float(((kinds < 2) | ((codes > 64) & (codes < 71))).mean()), float((np.diff(kinds) != 0).mean()) if n > 1 else 0.0, float((step == 0).mean()) if n > 1 else 0.0,
        float((np.abs(step) == 1).mean()) if n > 1 else 0.0, covered / n, max(map(len, words), default=0) / n, float(not _PATH_WORDS.isdisjoint(re.findall("[a-z]+", path.lower()))),
        sum(w in _SECRET_WORDS or any(w.endswith(f"_{x}") for x in ("key", "token", "secret", "password", "passwd", "pwd")) for w in beside), sum(w in _OTHER_WORDS for w in near),
        float(bool(_ASSIGNED.search(before))), float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)), found.count("-") / n,
    ]


def _assigned(text: str) -> Iterator[tuple[int, int, int]]:
    """Start of the name, start and end of the value."""
    for m in _VALUE.finditer(text):
        a, b = m.span(m.lastindex)
        b = b if m.lastindex < 3 else a + len(text[a:b].rstrip(".~-/:)]}"))
        if b - a >= 6:
            yield m.start() - len(_PREFIX.search(text[max(0, m.start() - NEAR) : m.start()])[0]), a, b


def _blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """Private key blocks from their first line to their last; without a last line there is none."""
    at = 0
    while m := _BLOCK.search(text, at):
        last = f"-----END {m[1]}-----"
        end = text.find(last, m.end())
        if end < 0:
            at = m.end()
            continue
        at = end + len(last)
        yield m.start(), m.start(), at


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans in code points, in order, without overlaps: key blocks, assigned values outside them, and what of runs is outside both and the values' names."""
    values = list(_assigned(text)) if "=" in text or ":" in text else []
    if blocks := list(_blocks(text)) if "PRIVATE KEY-----" in text else []:
        starts = [a for a, *_ in blocks]
        values = [v for v in values if not (k := bisect_left(starts, v[2])) or blocks[k - 1][2] <= v[0]]
        values = sorted([*values, *blocks])
    parts, at = [], 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        while at < len(values) and values[at][2] <= start:
            at += 1
        k = at
        while k < len(values) and values[k][0] < end:
            parts.append((start, values[k][0]))
            start, k = max(start, values[k][2]), k + 1
        parts.append((start, end))
    spans = [(a, b) for a, b in parts if b - a >= 16 and _MIXED.search(text, a, b)]
    spans = [(a + len(x) - len(x.lstrip("=.~-/+")), b - len(x) + len(x.rstrip(".~-/"))) for a, b in spans for x in (text[a:b],)]
    return sorted([*((a, b) for a, b in spans if b - a >= 16), *((a, b) for _, a, b in values)])


def view(text: str, start: int, end: int, path: str) -> list[float]:
    return features(text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR], path)


def made_findings(n: int = FINDINGS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of findings made from rules, half of them secrets."""
    rng = random.Random(seed)
    hexes, base64 = "0123456789abcdef", string.ascii_letters + string.digits
    words = sorted(_DICTIONARY)

    def run(signs: str, *sizes: int) -> str:
        return "".join(rng.choices(signs, k=rng.choice(sizes)))

    def prose() -> str:
        return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "ción", "ver", "eau", "st", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 6)))

    x, y = [], []
    for k in range(n):
        secret = k % 2
        path = rng.choice(["src0", "src/app.py", "notes.txt", "conf/prod.env", ""])
        if secret:
            name = rng.choice(["token", "secret", "password", "api_key", "key", "auth_token", "Authorization: Bearer", "TOKEN", "access_key", "Token"])
            value = rng.choice([run(hexes, 32, 40, 64), run(hexes.upper(), 32, 40), run(base64, 20, 24, 32, 40, 43), "sk_" + run(base64, 24, 32), "gh_" + run(base64, 36), run(base64 + "+/", 40, 64, 86) + "==", run(base64 + "!#%", 10, 12, 16)])
            quote = rng.choice(['"', '"', "'", ""])
            sign = " " if name.endswith("Bearer") else rng.choice([" = ", "=", ": ", " "])
            if rng.random() < 0.1:  # nothing beside it tells
                name, sign = rng.choice(["", "value"]), rng.choice([" ", " = "])
        else:
            name = rng.choice(["commit", "sha256", "md5", "checksum", "id", "uuid", "see", "", "", "example token", "version", "etag", "image", "digest"])
            sign, quote = rng.choice([" ", ": ", " = ", "="]), rng.choice(["", "", '"'])
            value = rng.choice([
                run(hexes, 32, 40, 64) if name not in ("", "see", "id") else run("0123456789", 16, 20), "-".join(run(hexes, s) for s in (8, 4, 4, 4, 12)), rng.choice("x0a*1") * rng.randint(16, 40), "".join(w.title() for w in rng.sample(words, rng.randint(3, 5))),
                "_".join(rng.sample(words, rng.randint(3, 5))) + str(rng.randint(0, 99)), "/".join(rng.sample(words, 3)) + "/v2.html", run("0123456789", 16, 18, 22), "YOUR_" + rng.choice(["API_KEY", "TOKEN"]) + "_HERE_123", "example-" + "-".join(rng.sample(words, 2)) + "-0001", "1234567890abcdef1234567890", "2024-01-02T03:04:05.000", "-".join(rng.sample(words, 4)) + "-" + str(rng.randint(1, 2000)),
            ])
            path = rng.choice([path, "tests/fixtures/data.json", "docs/example.md"])
        if k % 10 > 7:  # short values of names that tell
            name = rng.choice(["password", "DB_PASSWORD", "passwd", "pwd", "secret", "api_key", "key", "token", "auth_token"])
            sign, quote = rng.choice([" = ", "=", ": ", ":"]), rng.choice(['"', "", ""])
            word = rng.choice([w for w in words if len(w) > 5])
            if secret:
                value = rng.choice([word + str(rng.randint(1, 9999)) + run("!#%$*", 1, 2), run(base64 + "!#%$*", 8, 9, 10, 12, 14), word[:4] + run("0123456789", 1, 2) + run(base64 + "!#%", 3, 5)])
            else:
                value = rng.choice([word, word, word.title(), word.upper(), f"${{{word.upper()}}}", f"config.{word}", f"{word}.{rng.choice(words)}", f"get_{word}()", "changeme", "undefined", "xxxxxxxx", "********", "{{" + word + "}}"])
        if k % 20 in (10, 11):  # in quotes, with blanks, or long
            name, quote = rng.choice(["password", "secret", "DB_PASSWORD", "key", "token"]), rng.choice("\"'")
            sign = rng.choice([" = ", "=", ": "])
            if secret:
                value = rng.choice([" ".join(run(base64 + "!#%$*", 4, 6, 9) for _ in range(rng.randint(2, 5))), run(base64 + "!#%+/ ", 80, 200, 300), rng.choice(words).title() + " " + run("0123456789", 3, 4) + " " + run(base64 + "!#%", 6, 8)])
            else:
                value = " ".join(rng.sample(words, rng.randint(2, 12))) + rng.choice(["", ".", "!"])
        if k % 100 == 13:
            kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            name, sign, quote = "", "", ""
            value = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(run(base64 + "+/", 64) for _ in range(rng.randint(1, 26))) + f"\n-----END {kind}PRIVATE KEY-----"
        before, after = f"{prose()} {name}{sign}{quote}", f"{quote} {prose()}"
        x.append(features(value, before[-NEAR:], after[:NEAR], path))
        y.append(secret)
    return np.array(x), np.array(y)


class Forest:
    """Trees of (feature, cut, left, right) with leaves of label shares; bootstrap rows and random features from a fixed seed."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(TREES if len(y) else 0):
            own = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[own], y[own].astype(float), rng))

    @staticmethod
    def _grow(x: np.ndarray, y: np.ndarray, rng) -> np.ndarray:
        nodes: list[list[float]] = [[-1, 0, 0, 0, 0]]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            share = y[rows].mean()
            nodes[node][4] = share
            if depth == DEPTH or len(rows) < 2 * LEAF or share in (0, 1):
                continue
            best = (1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                values, left = x[order, f], np.cumsum(y[order])[:-1]
                n = np.arange(1, len(order))
                p, q = left / n, (left[-1] + y[order[-1]] - left) / (len(order) - n)
                gain = share * (1 - share) - (n * p * (1 - p) + (len(order) - n) * q * (1 - q)) / len(order)
                gain[(values[1:] == values[:-1]) | (n < LEAF) | (len(order) - n < LEAF)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    middle = (values[at] + values[at + 1]) / 2
                    best = (gain[at], f, middle if middle < values[at + 1] else values[at])
            if best[1] >= 0:
                right = x[rows, best[1]] > best[2]
                nodes[node][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                todo += [(len(nodes), rows[~right], depth + 1), (len(nodes) + 1, rows[right], depth + 1)]
                nodes += [[-1, 0, 0, 0, 0], [-1, 0, 0, 0, 0]]
        return np.array(nodes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = tree[at, 0].astype(int)
                goes = np.where(x[np.arange(len(x)), np.maximum(f, 0)] > tree[at, 1], tree[at, 3], tree[at, 2]).astype(int)
                at = np.where(f < 0, at, goes)
            total += tree[at, 4]
        return total / max(1, len(self.trees)) if self.trees else np.full(len(x), 0.5)


def train(findings: DataFrame | None = None) -> Forest:
    """findings (text, start, end, path, label 0 or 1), spans in code points; of more than FINDINGS, those of the least hashes."""
    if findings is None:
        return Forest(*made_findings())
    known = findings.where(F.col("label").isin(0, 1) & F.col("text").isNotNull() & (F.col("end") > F.col("start")))
    rows = known.orderBy(F.xxhash64("text", "start", "end"), "label").limit(FINDINGS).select("text", "start", "end", "path", "label").toLocalIterator()
    seen = [(view(r.text, r.start, r.end, r.path or ""), r.label) for r in rows if r.end <= len(r.text)]
    return Forest(np.array([v for v, _ in seen]).reshape(len(seen), len(FEATURES)), np.array([label for _, label in seen]))


def find_secrets(docs: DataFrame, forest: Forest | None = None, path: str = "source") -> DataFrame:
    """(doc_id, start, end, candidate, score, is_secret) of every candidate in docs (doc_id, text, path column)."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or train())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("candidate", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, views = [], []
            for d, t, p in zip(*(c.to_pylist() for c in batch.columns)):
                for a, b in candidates(t or ""):
                    rows.append((d, a, b, t[a:b]))
                    views.append(view(t, a, b, p or ""))
            scores = shared.value.scores(np.array(views)) if views else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], schema.field(k).type) for k in range(4)), pa.array(scores)], schema=schema)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(path).cast("string")).mapInArrow(run, "doc_id long, start long, end long, candidate string, score double")
    return found.withColumn("is_secret", F.col("score") >= THRESHOLD)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every candidate in every document and the forest's verdict; the candidate itself as its digest."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "start", "end", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")
