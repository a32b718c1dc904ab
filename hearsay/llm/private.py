"""Personal data by weak supervision.

Base spans (emails, addresses of hosts, payment cards, telephone numbers) are what fixed expressions match.
Looser expressions propose more spans: numbers without a country code, addresses with "at" and "dot" spelled
out, account and identity numbers, persons. On every candidate four labelers vote for, against or not at all:
its strict format, its check digits, a gazetteer, and the words before it. Expectation-maximisation over the vote
patterns of the whole corpus estimates how reliable each is; its posteriors train a logistic classifier on votes
and features of the span, which decides. Patterns are a few thousand codes at most, so their counts are small
however many documents there are.

Defined cases: a null text is empty; a null doc_id keeps its row; repeated rows each come out; an empty table
gives no rows; the other columns are ignored, and kept by ``redacted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import table

KINDS = ("email", "ip", "card", "phone", "account", "identity", "person")
BASE_KINDS = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match begins at the start of a run of digits: later starts in the run can't match if this one doesn't.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_LOOSE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[\[({]at[\])}]) ?[A-Za-z0-9-]{1,63}(?:(?: ?[\[({]dot[\])}] ?|\.)[A-Za-z0-9-]{1,63}){1,4}")),
    (3, re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])")),
    (4, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (5, re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (6, re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?")),
)

_ENDINGS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl eu ch at us ca au jp cn in br ru se no dk fi pl".split())
_ACCOUNT_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM TR".split())
_GIVEN = frozenset("Anna Carlos Daniel David Elena Emma Eva George Hans Ines James Jan Jean John Jose Julia Karl Laura Lucas Luis Maria Marie Mark Martin Michael Paul Peter Robert Sara Sophie Thomas William".split())
_FOR = (
    frozenset("email mail e-mail contact write address reach correo courriel".split()),
    frozenset("ip host server address from client login".split()),
    frozenset("card visa credit payment paid carte tarjeta karte".split()),
    frozenset("phone tel telephone call mobile cell fax contact dial telefon teléfono téléphone".split()),
    frozenset("iban account bank konto compte cuenta transfer".split()),
    frozenset("ssn social security identity tax".split()),
    frozenset("by with from patient doctor dear met".split()),
)
_AGAINST = frozenset("version order invoice isbn id no nr number total price sku model build part serial page fig figure".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((0, start, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    if text.count(".") > 2:
        out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _checked(kind: int, found: str) -> int:
    """Vote of the check digits, where a kind has them."""
    if kind == 2:
        return 1 if luhn(re.sub("[^0-9]", "", found)) else -1
    if kind == 4:
        flat = found.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1 else -1
    if kind == 5:
        area, group, serial = found.split("-")
        return -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    return 0


def _listed(kind: int, found: str) -> int:
    """Vote of the gazetteers."""
    if kind == 0:
        return 1 if re.split(r"[^A-Za-z]+", found.rstrip("])}"))[-1].lower() in _ENDINGS else -1
    if kind == 4:
        return 1 if found[:2] in _ACCOUNT_COUNTRIES else -1
    if kind == 6:
        return 1 if found.split()[1] in _GIVEN else 0
    if kind == 3:
        digits = re.sub("[^0-9]", "", found)
        return -1 if len(set(digits[-7:])) == 1 else 0
    return 0


def _told(kind: int, text: str, start: int) -> int:
    """Vote of the words before the span."""
    words = [w.strip(".,:;()\"'").lower() for w in text[max(0, start - 40) : start].split()[-4:]]
    return 1 if any(w in _FOR[kind] for w in words) else -1 if any(w in _AGAINST for w in words) else 0


LABELERS = 4


def _code(kind: int, strict: bool, text: str, start: int, end: int) -> int:
    """Kind, votes and features of a candidate in one number."""
    found = text[start:end]
    votes = (1 if strict else 0, _checked(kind, found), _listed(kind, found), _told(kind, text, start))
    features = (start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum(), end - start > 16)
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    for f in features:
        code = code * 2 + bool(f)
    return code


def _decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    features = np.stack([codes >> k & 1 for k in (2, 1, 0)], 1)
    rest, votes = codes >> 3, []
    for _ in range(LABELERS):
        votes.append(rest % 3 - 1)
        rest = rest // 3
    return rest, np.stack(votes[::-1], 1), features


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans; and further candidates (kind, start, end, code) that overlap none of their kind."""
    base, more = base_spans(text), []
    taken: dict[int, list[tuple[int, int]]] = {}
    for kind, a, b in base:
        taken.setdefault(kind, []).append((a, b))
    digits = bool(_DIGIT.search(text))
    for kind, loose in _LOOSE:
        if kind == 0 and "at" not in text or kind in (3, 4, 5) and not digits or kind == 6 and "." not in text:
            continue
        spans = iter(taken.get(kind, []))
        at = next(spans, None)
        for m in loose.finditer(text):
            while at and at[1] <= m.start():
                at = next(spans, None)
            if not at or at[0] >= m.end():
                more.append((kind, m.start(), m.end(), _code(kind, False, text, m.start(), m.end())))
    return base, more


def estimate(counts: dict[int, int], rounds: int = 30) -> set[int]:
    """Codes of candidates that the final classifier takes for personal data.

    counts: of each code over the corpus. Labelers start as right four times in five.
    """
    if not counts:
        return set()
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes.tolist()], float)
    kind, votes, features = _decoded(codes)
    cast = votes != 0
    right, prior = np.full(LABELERS, 0.8), np.full(len(KINDS), 0.5)
    for _ in range(rounds):
        # log odds of being personal data
        odds = np.log(prior / (1 - prior))[kind] + (votes * np.log(right / (1 - right))).sum(1)
        truth = 1 / (1 + np.exp(-odds))
        agree = np.where(votes > 0, truth[:, None], 1 - truth[:, None]) * cast * weight[:, None]
        right = np.clip((agree.sum(0) + 8) / ((cast * weight[:, None]).sum(0) + 10), 0.55, 0.99)
        for k in range(len(KINDS)):
            own = kind == k
            prior[k] = (truth[own] @ weight[own] + 5) / (weight[own].sum() + 10)
        prior = np.clip(prior, 0.05, 0.95)
    x = np.concatenate([np.ones((len(codes), 1)), votes, cast[:, 1:], features, np.eye(len(KINDS))[kind]], 1)
    w, scale = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(25):  # Newton steps, with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (scale * (p - truth)) + 1e-3 * w
        bend = (x * (scale * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return set(codes[p >= 0.5].tolist())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for x in batch.column(0):
            text = x.as_py() or ""
            base, more = candidates(text)
            seen.update(c for *_, c in more)
            seen.update(_code(k, True, text, a, b) for k, a, b in base)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])


def train(docs: DataFrame) -> set[int]:
    """The accepted codes, from the votes on all candidates in all of ``docs``."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return estimate({r.code: r.n for r in counts.collect()})


def spans_of(text: str, accepted: set[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans; by kind and start."""
    base, more = candidates(text)
    return base, sorted([*base, *((k, a, b) for k, a, b, c in more if c in accepted)])


def find_private(docs: DataFrame, accepted: set[int] | None = None) -> DataFrame:
    """(doc_id, base, spans) of every row of docs (doc_id, text): arrays of (kind, start, end) in code points."""
    accepted = train(docs) if accepted is None else accepted
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans_of(x.as_py() or "", accepted) for x in batch.column(1)]
            both = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in f[j]] for f in found], pa.list_(span)) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *both], ["doc_id", "base", "spans"])

    of = "array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, base {of}, spans {of}")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced with their kind; what overlaps is replaced once, by the first kind."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and n_chars, if there is such a column, as long as the text then is."""
    accepted = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [x.as_py() for x in batch.column(at)]
            clean = [t if t is None else redact(t, spans_of(t, accepted)[1]) for t in texts]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def query(spark, sf_dir: str) -> DataFrame:
    """op6: personal data in every document."""
    found = find_private(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in KINDS[:BASE_KINDS]]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
