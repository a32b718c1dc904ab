import random
import re

from hearsay.llm import private

DATA = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_base_spans_of_random_texts():
    rng = random.Random(2)
    found = 0
    for _ in range(6000):
        text = "".join(rng.choices(["@", ".", "+", "-", " ", "a", "é", "٣", "(", ")", "0", "1", "9", "25", "4111111111111111", "a@b.c", "1.2.3.4", "+1 555"], k=rng.randint(0, 14)))
        want = brute(text)
        assert [(private.KINDS[k], a, b) for k, a, b in private.base_spans(text)] == want, text
        found += len(want)
    assert found > 3000


def test_query_against_brute_force(spark):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = private.query(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want) for x in private.KINDS[:4]]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))
    assert sum(r.n_email + r.n_card for r in rows)


def test_votes_add_spans():
    real = ["please call (415) 555-2671 now", "my phone is 415-555-2671 thanks", "write to jo[at]example[dot]com please", "iban GB29 NWBK 6016 1331 9268 19 is mine", "ssn 123-45-6789 here", "as told by Dr. Anna Smith today"]
    odd = ["order number 000-000-0000 shipped", "part XX00 1234 5678 9012 3456 made"]
    counts = {}
    for t in real * 20 + odd * 20:
        for *_, c in private.candidates(t)[1]:
            counts[c] = counts.get(c, 0) + 1
    accepted = private.estimate(counts)
    assert all(private.spans_of(t, accepted)[1] for t in real)
    assert not any(private.spans_of(t, accepted)[1] for t in odd)
    assert private.estimate({}) == set()


def test_edge_cases(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a@b.co", "x"), (4, "+1 (555) 123-4567x" + "9" * 5000 + "." * 90000 + "a" * 90000, "x"), (4, "é 10.0.0.1", "x"), (4, "é 10.0.0.1", "x")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, spans string, n_chars int")
    found = private.find_private(docs).collect()
    assert len(found) == 6
    assert sorted([len(r.base) for r in found]) == [0, 0, 1, 1, 1, 1]
    assert private.find_private(docs.where("false")).count() == 0
    clean = private.redacted(docs).collect()
    assert [r.text for r in clean][:3] == [None, "", "<EMAIL>"] and clean[4].text == "é <IP>" and clean[4].n_chars == 6
    assert clean[0].spans == "x" and clean[3].text.startswith("<PHONE>")
