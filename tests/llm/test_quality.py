import zlib

import numpy as np
from pyspark.sql import functions as F

from hearsay.llm import quality

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_contract(spark):
    rows = quality.query(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    y, s = [], []
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.held_out and r.doc_id in labels:
            y.append(labels[r.doc_id])
            s.append(r.score)
    y, s = np.array(y), np.array(s)
    assert np.mean(s[y == 1][:, None] > s[y == 0]) + np.mean(s[y == 1][:, None] == s[y == 0]) / 2 > 0.97
    assert np.mean((s >= 0.3) == y) > 0.95


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.choice(list(b"abc XYZ!|\n"), 80).tolist()) for _ in range(40)]
    labels = [int(k % 3 > 0) for k in range(40)]
    model = quality.fit([quality.sparse(t) for t in texts], labels, 0.7)
    ask = [*texts[:5], b"", b"a", b"Zq !!"]
    got = model.scores(ask)
    for t, g in zip(ask, got):
        v = quality.terms(t)[model.kept] @ model.project
        v = v / max(np.linalg.norm(v), 1e-12)
        cosine = model.vectors @ v
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 0) ** quality.SHARPNESS * model.weights[near]
        want = vote @ model.labels[near] / vote.sum() if vote.sum() else 0.7
        assert abs(g - want) < 1e-3


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "fine words here", 7), (1, "fine words here", 7), (2, None, 7), (None, "x", 7), (4, "", 7), (5, "!!! ### " * 20000, 7)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    found = quality.score_documents(docs, quality.train(docs, none)).collect()
    assert len(found) == 6 and {r.score for r in found} == {0.5}
    few = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (5, 0, None), (None, 1, "c"), (2, None, "d"), (2, 9, "d")], "doc_id long, quality int, text string")
    found = quality.score_documents(docs, quality.train(docs, few)).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert quality.score_documents(docs.where("false"), quality.train(docs.where("false"), few)).count() == 0


def test_rejected_documents_go(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = quality.accepted(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in quality.query(spark, DATA).collect()}
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(d for d, p in scores.items() if p)
    assert docs.select(quality.held_out(F.lit(None).cast("long"))).first()[0] is False


def test_repetition_is_that_of_the_whole_text():
    varied, same = b" ".join(b"w%d" % k for k in range(400)), b" ".join([b"w"] * 400)
    assert quality._shares(varied)[5] == 0 and quality._shares(same)[5] == 1 - 1 / 400
    for text in (varied + b" " + same, same + b" " + varied):
        assert abs(quality._shares(text)[5] - (1 - 1 / 400) / 2) < 1e-9
    assert abs(quality._shares(varied + b" a a b")[5] - 1 / 403) < 1e-9
