import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hearsay.llm import simhash
from hearsay.llm.common import written
from hearsay.llm.graph import components

DATA = "/root/testdata/sf0.001"


def naive(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute(rows):
    ids = [r[0] for r in rows]
    fps = [naive(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = {}
    for k in range(len(rows)):
        group = [ids[j] for j in range(len(rows)) if find(j) == find(k) and ids[j] is not None]
        out.setdefault(ids[k], set()).add((f"{fps[k]:016x}", min(group, default=None)))
    return out


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    assert len(found) == len(rows)
    out = {}
    for d, f, c in found:
        out.setdefault(d, set()).add((f, c))
    return out


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    for r in simhash.query(spark, DATA).collect():
        assert want[r.doc_id] == {(r.fingerprint, r.component_id)}


def test_edge_cases(spark):
    long = " ".join(random.Random(1).choices("abcdefg", k=80_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "One", "x"), (4, "one", "x"), (None, "ONE", None), (None, "alone here", "x"), (9, long, "x"), (8, long + " z", "x"), (7, "É é", "x"), (6, "é é", "x")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, rows[:0]) == {}


def test_links_of_random_and_dense_fingerprints(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in list(fps[:20]):
        for _ in range(6):
            x = base
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    dense = rng.getrandbits(64)
    fps += [dense ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(a)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(simhash._signed(f), k) for k, f in enumerate(fps)], "fp long, rep long")
    for block in (8192, 40):
        found = {r.node: r.component for r in components(simhash.links(nodes, block)).collect()}
        label = list(range(len(fps)))
        arr = np.array(fps, np.uint64)
        changed = True
        while changed:
            changed = False
            for k in range(len(fps)):
                near = np.flatnonzero(np.bitwise_count(arr ^ arr[k]) <= 3)
                least = min(label[j] for j in near)
                for j in near:
                    if label[j] > least:
                        label[j], changed = least, True
        assert [found.get(k, k) for k in range(len(fps))] == label


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d", "s"), (1, "A B c d", "s"), (5, "other words are here", "s"), (None, "a b c d", "s")], "doc_id long, text string, source string")
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 1, 5]


def test_rows_without_doc_id_link_others(spark):
    rng = random.Random(2)
    words = rng.choices(["".join(rng.choices("abcdefg", k=5)) for _ in range(400)], k=600)

    def far(a, b):
        return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()

    texts = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(0, 600, 3)] + [" ".join(words[:-k]) for k in range(1, 40)]
    bits = {t: t.encode() for t in texts}
    fps = {t: simhash.fingerprint(b) for t, b in bits.items()}
    first, bridge, last = next((a, b, c) for b in texts for a in texts if 0 < (fps[a] ^ fps[b]).bit_count() <= 3 for c in texts if 0 < (fps[b] ^ fps[c]).bit_count() <= 3 < (fps[a] ^ fps[c]).bit_count())
    assert far(bits[first], bits[last]) > 3
    rows = [(5, first, None), (None, bridge, None), (2, last, None), (None, "some other words are here", None)]
    found = got(spark, rows)
    assert found == brute(rows) and found[5] == {(f"{fps[first]:016x}", 2)} and (f"{fps[bridge]:016x}", 2) in found[None]


def test_broadcasts_neither_keys_nor_rows(spark):
    # both are far larger than the files that Spark takes their size from
    rng = random.Random(8)
    fps = [simhash._signed(rng.getrandbits(64)) for _ in range(3000)]
    near = [(f ^ 1, k + 3000) for k, f in enumerate(fps[:50])]
    nodes, _ = written(spark.createDataFrame([(f, k) for k, f in enumerate(fps)] + near, "fp long, rep long"), "nodes")
    docs = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("a b c d "), F.col("id") % 3).alias("text"))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "2m")
    try:
        assert {(min(r), max(r)) for r in simhash.links(nodes).collect()} == {(k, k + 3000) for k in range(50)}
        found = simhash.near_duplicates(docs)
        assert found.count() == 60_000 == found.where("component_id is not null").count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
