import random
import re

from hearsay.llm import similar

DATA = "/root/testdata/sf0.001"


def brute(rows, least=0.8):
    """Smallest doc_id of each row's group, by comparing all pairs of shingle sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both / (len(sets[a]) + len(sets[b]) - both) >= least:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, (d, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(d)
    return sorted(str((d, min((x for x in groups[find(k)] if x is not None), default=None))) for k, (d, _) in enumerate(rows))


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
    return sorted(str((r.doc_id, r.component_id)) for r in similar.similar_groups(df, **more).collect())


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_edge_cases_and_chains_of_copies(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (4, "one"), (None, "ONE"), (None, "alone here"), (7, "É é"), (6, "é é"), (9, "w " * 60_000), (8, "W " * 50_000)]
    text = rng.choices(words, k=300)
    for k in range(40):  # each a little further from the first
        text = [*text]
        text[rng.randrange(300)] = rng.choice(words)
        rows.append((None if k % 9 == 4 else 1000 - k, " ".join(text)))
    for k in range(60):  # copies that share a passage only
        rows.append((2000 + k, " ".join(rng.choices(words, k=60) + text[:40])))
    want = brute(rows)
    assert got(spark, rows) == want
    assert got(spark, rows, block=6, set_block=4) == want
    assert got(spark, []) == []


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", "s"), (1, "A B c d", "s"), (5, "other words are here", "s"), (None, "a b c d", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id or 0 for r in similar.keep_one(docs).collect()) == [0, 1, 5]
