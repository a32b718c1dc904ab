import shutil

import test_decontaminate
import test_packing
import test_similar
from pyspark.sql import functions as F

import corpus_pipeline
from hearsay.llm import private, quality

DATA = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_every_stage_against_brute_force(spark, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    base = docs.orderBy(F.length("text").desc()).first()
    more = [(9000, base.text, "en", "s", 1), (9001, base.text.replace(". ", ".  "), "en", "s", 1), (9002, f"Some words first. {item} And write to jo.doe@mail.example.com now.", "en", "s", 1), (9003, "And write to jo.doe@mail.example.com or +1 (555) 123-4567 about all of this, please.", None, None, None), (9004, None, None, None, None)]
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir = str(tmp_path)
    at = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at[-1], sf_dir)
        out.write.parquet(f"{sf_dir}/stage{k}")
        at.append(spark.read.parquet(f"{sf_dir}/stage{k}"))
    assert all(x.columns == corpus_pipeline.COLUMNS for x in at[:-1])
    start, good, alone, clean, hidden = map(rows, at[:5])

    model = quality.train(at[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = dict(zip(start, model.scores([(r.text or "").encode() for r in start.values()])))
    assert good.keys() == {d for d, s in scores.items() if s >= quality.THRESHOLD}

    # five words and a similarity of 0.8, as asked of stages on word shingles
    assert alone.keys() == {d for d in good if str((d, d)) in test_similar.brute([(d, r.text) for d, r in good.items()])}
    assert 9000 not in alone or base.doc_id not in good

    hits = {d for d, _, n, _ in test_decontaminate.brute([(d, r.text) for d, r in alone.items()], [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]) if n}
    assert clean.keys() == alone.keys() - hits and (9002 in hits or 9002 not in alone)

    assert hidden.keys() == clean.keys()
    for d, r in hidden.items():
        if r.text is None:
            assert clean[d].text is None
            continue
        assert not private.base_spans(r.text) and r.n_chars == len(r.text)
        if not private.candidates(clean[d].text)[0] and not private.candidates(clean[d].text)[1]:
            assert r.text == clean[d].text
    if 9003 in hidden:
        assert hidden[9003].text == "And write to <EMAIL> or <PHONE> about all of this, please."
    test_packing.check(at[5].collect(), [(d, r.text) for d, r in hidden.items()], 2048)

    run = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(key).collect())) == sorted(map(tuple, at[5].select(key).collect()))
    # clean documents of the first table are still there
    assert len(hidden) > 0.6 * len(start)
