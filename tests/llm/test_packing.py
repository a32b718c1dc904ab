import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hearsay.llm import packing

DATA = "/root/testdata/sf0.001"


def test_ids_are_the_tokenizers():
    own, want = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(0)
    signs = [chr(c) for c in range(0x300)] + list(" 　一\U0001f600٠́ ​ ") + [" ", "\n", "\t", "'s", "a", "Z", "9"] * 40
    for text in ["", "\x1c \x1d", "a\x85b  \xa0c", *("".join(rng.choices(signs, k=60)) for _ in range(1500))]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def check(rows, docs, capacity):
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append(want.encode(t or "", add_special_tokens=False).ids + [0])
    crcs = sorted((str(d), *(zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()) for a, n in packing.cut(len(x), capacity))) for d, all_ids in ids.items() for x in all_ids)
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert 0 < r.length <= capacity
    flat = []
    for d, rs in got.items():
        copies = len(ids[d])
        rs = sorted(rs, key=lambda r: (r.piece, r.start))
        assert len(rs) % copies == 0 or copies > 1
        if copies == 1:
            assert [r.piece for r in rs] == list(range(len(rs)))
            assert all(a.start + a.length == b.start for a, b in zip(rs, rs[1:])) and rs[0].start == 0
            flat.append((str(d), *(r.ids_crc32 for r in rs)))
    assert sorted(flat) == [c for c in crcs if len(ids[int(c[0]) if c[0] != "None" else None]) == 1]
    assert sum(r.length for r in rows) == sum(len(x) for xs in ids.values() for x in xs)
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= capacity
    return len(places)


def test_query_round_trip(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = packing.query(spark, DATA).collect()
    used = check(rows, docs, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2


def test_partitions_exchange_documents(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices("abcdefgh", k=rng.choice([1, 3, 9, 20, 30, 31, 60, 200])))) for k in range(900)]
    docs += [(None, "a b"), (7000, None), (7001, ""), (8000, "x"), (8000, "x")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, capacity=64, part_rows=40).collect()
    used = check(rows, docs, 64)
    sizes = np.array([r.length for r in rows])
    assert used <= packing.lower_bound(sizes, 64) * 1.02 + 1
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    assert packing.pack_documents(df.where("false")).count() == 0


def test_groups_stay_small_where_nothing_can_be_exchanged(spark):
    docs = [(k, " ".join("a" * 37)) for k in range(300)]  # any two exceed a sequence
    rows = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), capacity=64, part_rows=20, keep_ids=False).collect()
    assert check(rows, docs, 64) == 300


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 65, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(sizes, 64)
        assert np.bincount(bins, weights=sizes).max() <= 64
        assert packing.lower_bound(sizes, 64) <= bins.max() + 1
    # any two of these exceed a bin; the volume alone says 6
    assert packing.lower_bound(np.array([33] * 10), 64) == 10
    assert packing.lower_bound(np.array([22] * 9), 64) >= 4  # two fit


def test_added_tokens_are_one_id():
    own, want = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    signs = ["<|endoftext|>", "<|endoftext|", "<|", "|>", " ", "  ", "\n", "a", "one page.", "'s", "9", "一", "É"]
    for text in ["one page.<|endoftext|>Another", "<|endoftext|>", "<|endoftext|><|endoftext|> ", " <|endoftext|>  x", *("".join(rng.choices(signs, k=12)) for _ in range(500))]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode("one page.<|endoftext|>Another"), "<u4").tolist() == [505, 2443, 13, 50256, 6610]
