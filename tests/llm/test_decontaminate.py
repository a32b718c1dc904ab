import random
import re

from hearsay.llm import decontaminate

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        windows += [(i, w[k : k + n]) for k in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w, hit, names = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    if i is not None:
                        names.add(str(i))
        out.append((d, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def got(spark, docs, items):
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    return sorted((tuple(r) for r in decontaminate.contamination(d, i).collect()), key=str)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = brute(docs, items)
    found = [(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontaminate.query(spark, DATA).collect()]
    assert sorted(found, key=str) == sorted(((d, n, h, len(i)) for d, n, h, i in want), key=str)
    assert any(h for *_, h, _ in found)


def test_every_shared_window_is_found(spark):
    rng = random.Random(3)
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz"):
        items = [(k, " ".join(rng.choices(letters, k=n))) for k, n in enumerate([1, 3, 9, 10, 11, 30])]
        docs = [(k, " ".join(rng.choices(letters, k=n))) for k, n in enumerate([0, 2, 9, 10, 13, 60])]
        for k in range(8):
            w = items[rng.choice([3, 4, 5])][1].split()
            docs.append((100 + k, " ".join(rng.choices(letters, k=k) + w[: 10 + k] + rng.choices(letters, k=3))))
        assert got(spark, docs, items) == brute(docs, items)


def test_edge_cases(spark):
    items = [(1, None), (2, "--"), (None, "alpha beta gamma"), (3, "É one2 TWO"), (3, "É one2 TWO"), (10, "é x y"), (4, " ".join("abcdefghijklmnop"))]
    docs = [(1, None), (2, ""), (None, "alpha-Beta gamma"), (3, "x É ONE2 two y"), (3, "x É ONE2 two y"), (5, "q A b c d e f g h i j z"), (6, "w " * 30000 + " ".join("bcdefghijklm"))]
    assert got(spark, docs, items) == brute(docs, items)
    assert got(spark, docs, []) == brute(docs, [])
    assert got(spark, [], items) == []


def test_clean_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (2, "z", "s"), (None, "a b c d", "s")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    assert sorted(r.doc_id or 0 for r in decontaminate.clean_documents(docs, items).collect()) == [0, 2]
