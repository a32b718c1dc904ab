import math

import numpy as np
from pyspark.sql import functions as F

from hearsay.llm import topk

DATA = "/root/testdata/sf0.001"


def brute(rows, every, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in topk.query(spark, DATA).collect()) == brute(rows, 50)


def test_many_shards_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.integers(-3, 4, (400, 3)) / 8)]
    rows += [(1000 + i, [0.5, 0.5, 0.5]) for i in range(50)]  # one point
    rows += [(0, [9.0, 9.0, 9.0]), (7, rows[7][1]), (2000, None), (2001, [1.0, None, 2.0]), (2002, [float("nan"), 1.0, 1.0]), (2003, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (2005, []), (2010, [1e9, 1e9, -1e9]), (3000, [1.0, 2.0]), (3005, [2.0, 2.0])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<double>, score int")
    for shard, block in ((16_384, 2_048), (60, 20)):
        found = topk.top_k(df, F.col("vec_id") % 5 == 0, shard_rows=shard, block_rows=block).collect()
        assert sorted(tuple(r) for r in found) == brute(rows, 5)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 5 == 0).count() == 0
    assert topk.top_k(df.where("vec_id = 1000"), F.col("vec_id") % 5 == 0).count() == 0


def test_pruning_leaves_boxes_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (20, 4))
    points = np.concatenate([c + rng.integers(-5, 6, (300, 4)) for c in centres])
    tree = topk.build(points, np.arange(len(points)), 64)
    asked = []

    class Seen(dict):
        def __getitem__(self, n):
            asked.append(n)
            return super().__getitem__(n)

    tree.ranges = Seen(tree.ranges)
    q = points[:1]
    got = topk.search(tree, q, np.array([-1]), np.array([-(2**62)]))[0]
    want = sorted(((int(s), -i) for i, s in enumerate(points @ q[0])), reverse=True)[:5]
    assert got == want and len(asked) < len(tree.ranges) / 3

def test_a_tree_is_built_once_for_its_unit(monkeypatch):
    import pyarrow as pa

    built = []
    real = topk.build
    monkeypatch.setattr(topk, "build", lambda points, ids: built.append(len(ids)) or real(points, ids))
    monkeypatch.setattr(topk, "BATCH_QUERIES", 3)
    rng = np.random.default_rng(4)
    rows = [(2, s, 0, a, i, rng.integers(-9, 9, 2).tolist(), -(2**62)) for s in (0, 1, 3) for a, n in ((0, 30 if s != 3 else 0), (1, 20 if s != 1 else 0)) for i in range(n)]
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("asks", pa.int32()), ("vec_id", pa.int64()), ("vector", pa.list_(pa.int64())), ("floor", pa.int64())])
    whole = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    found = [r for b in topk._units(5)(whole.slice(a, 7) for a in range(0, len(whole), 7)) for r in b.to_pylist()]
    assert built == [30]
    points = {r[4]: r[5] for r in rows if r[1] == 0 and r[3] == 0}
    for r in (r for r in rows if r[1] == 0 and r[3] == 1):
        want = sorted((-sum(a * b for a, b in zip(r[5], p)), i) for i, p in points.items() if i != r[4])[:5]
        assert sorted(-f["score"] for f in found if f["query_id"] == r[4]) == [s for s, _ in want]
