"""Near-duplicates by the Jaccard similarity of word shingles, with op 2's pigeonring filter on a ring of minima.

Sixty-four SimHash bits can't tell texts that share four fifths of their five-word shingles from those that share
three fifths, so this part of the operator files a text under RING symbols: the least of its shingles' hashes under RING
permutations. Two texts differ in a symbol as often as their shingle sets differ. If they differ in at most BUDGET symbols,
there is a place on the ring from which every chain of l symbols differs in at most l * BUDGET / RING (the pigeonring
principle, strong form); its first two are equal, so texts are filed under RING pairs of neighbouring symbols, and the members of a key
pass the longer chains' budgets. Those that do are candidates; of their connected groups, pairs are confirmed by the exact similarity of
their sets. A pair of similarity 0.8 has more than BUDGET differing symbols once in a thousand.

Defined cases: as for the fingerprints: texts of fewer words are one shingle, wordless ones are alike; a null doc_id
takes part in no minimum, and links others; repeated rows each come out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import written
from hearsay.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
RING, BUDGET = 24, 11
#: Members of one key, and texts of one group, that are compared in one unit; more are dealt out as pairs of blocks.
BLOCK, SET_BLOCK = 8192, 512
_random = np.random.default_rng(5)
_FACTORS = _random.integers(1, 2**63, RING, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 2**63, RING, dtype=np.uint64)
_CHUNK = 1 << 14


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; of a text of fewer words that of all of them."""
    words = (text or b"").lower().split()
    parts = zip(*(words[k:] for k in range(size))) if len(words) >= size else [words] if words else []
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(p)) for p in parts], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The ring of a set of hashes; zeros for an empty set."""
    out = np.full(RING, np.iinfo(np.uint64).max if len(hashes) else 0, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        out = np.minimum(out, (hashes[at : at + _CHUNK, None] * _FACTORS + _SHIFTS).min(0))
    return out


def _described(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, rings, keys, sets = [], [], [], []
            for x in batch.column(1):
                hashes = shingles(x.as_py(), size)
                ring = minima(hashes)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes()) - 2**63)
                rings.append((ring >> np.uint64(56)).astype(np.uint8).tobytes())
                after = np.roll(ring, -1)
                keys.append([xxhash.xxh64_intdigest(a + b, k) - 2**63 for k, (a, b) in enumerate(zip((r.tobytes() for r in ring), (r.tobytes() for r in after)))])
                sets.append((hashes >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(rings, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["doc_id", "node", "ring", "keys", "hashes"])

    return run


def spread(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n members the first of its group; near(member, others): which of the others are linked to it.

    Spreads from one member at a time over those not reached yet, so a dense group costs little more than its size.
    """
    group, left = np.full(n, -1, np.int64), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        group[first] = first
        queue = [first]
        while queue and len(left):
            found = near(queue.pop(), left)
            if len(found):
                group[found] = first
                queue.extend(found)
                left = left[group[left] < 0]
    return group


def _rings(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, RING)


def _candidates(rows: pa.Table) -> np.ndarray:
    """Groups of one unit's rows by the budgets of the chains from its place."""
    rings, start = np.roll(_rings(rows.column("ring").combine_chunks()), -rows.column("chain")[0].as_py(), 1), (5, 12, RING)

    def near(one: int, others: np.ndarray) -> np.ndarray:
        for n in start:
            others = others[(rings[others, :n] != rings[one, :n]).sum(1) <= n * BUDGET // RING]
        return others

    return spread(len(rings), near)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; of two empty ones 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _confirmed(similarity: float):
    def run(rows: pa.Table) -> np.ndarray:
        sets = [np.unique(np.frombuffer(x, "<u4")) for x in rows.column("hashes").to_pylist()]
        rings, sizes = _rings(rows.column("ring").combine_chunks()), np.array([len(s) for s in sets])

        def near(one: int, others: np.ndarray) -> np.ndarray:
            some = others[(np.minimum(sizes[others], sizes[one]) >= similarity * np.maximum(sizes[others], sizes[one])) & ((rings[others] != rings[one]).sum(1) <= BUDGET)]
            return some[[jaccard(sets[one], sets[k]) >= similarity for k in some.tolist()]] if len(some) else some

        return spread(len(sets), near)

    return run


def _units(by: list[str], groups: Callable[[pa.Table], np.ndarray]):
    """Sorted rows with a node: links (u, v) that span the groups of each unit, that is of the rows that are alike in ``by``."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        keys = [rows.column(c).to_numpy() for c in by]
        nodes = rows.column("node").to_numpy()
        ends = [*(np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1).tolist(), len(nodes)]
        u, v, a = [], [], 0
        for b in ends:
            if b - a > 1:
                group = groups(rows.slice(a, b - a))
                more = np.flatnonzero(group != np.arange(b - a))
                u.append(nodes[a:b][group[more]])
                v.append(nodes[a:b][more])
            a = b
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            # the last unit may go on in the next batch
            own = [np.asarray(batch.column(batch.schema.get_field_index(c))) for c in by]
            last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in own], axis=0))
            begins = last[-1] + 1 if len(last) else 0
            if kept and (begins or any(kept[-1].column(kept[-1].schema.get_field_index(c))[-1].as_py() != x[0] for c, x in zip(by, own))):
                yield of(pa.Table.from_batches([*kept, batch.slice(0, begins)]))
                kept = [batch.slice(begins)]
            elif begins:
                yield of(pa.Table.from_batches([batch.slice(0, begins)]))
                kept = [batch.slice(begins)]
            else:
                kept.append(batch)
        if kept:
            yield of(pa.Table.from_batches(kept))

    return run


def _dealt(rows: DataFrame, key: list[str], block: int, groups: Callable[[pa.Table], np.ndarray], sizes: DataFrame) -> DataFrame:
    """Links within the rows of each key. sizes (key, n): keys of more than ``block`` rows, which are dealt out as pairs of blocks of them."""
    blocks = F.coalesce(F.ceil(F.col("n") / block).cast("int"), F.lit(1))
    own = rows.join(sizes, key, "left").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    by = [*key, "i", "j"]
    units = own.withColumn("other", other).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select(*by, *(c for c in rows.columns if c not in key))
    return units.repartition(*by).sortWithinPartitions(*by).mapInArrow(_units(by, groups), "u long, v long")


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK, set_block: int = SET_BLOCK) -> DataFrame:
    """(doc_id, node, component_id) of every row of ``docs`` (doc_id, text): texts linked by ``similarity`` or more, at least 0.8."""
    schema = "doc_id long, node long, ring binary, keys array<long>, hashes binary"
    found, _ = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_described(shingle), schema), "rings")
    nodes, _ = written(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("ring").alias("ring"), F.any_value("keys").alias("keys")), "nodes")
    filed = nodes.select("node", "ring", F.posexplode("keys").alias("chain", "key"))
    large = nodes.select(F.posexplode("keys").alias("chain", "key")).groupBy("chain", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    near = components(_dealt(filed, ["chain", "key"], block, _candidates, large))
    grouped = near.union(near.select(F.col("component").alias("node"), "component").distinct())
    # the sets of those that have a candidate only
    sets, _ = written(found.join(grouped, "node").groupBy("node").agg(F.any_value("component").alias("component"), F.any_value("ring").alias("ring"), F.any_value("hashes").alias("hashes")), "sets")
    many = sets.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > set_block)
    linked = components(_dealt(sets, ["component"], set_block, _confirmed(similarity), many))
    groups = linked.union(linked.select(F.col("component").alias("node"), "component").distinct())
    least = groups.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("least"))
    label = nodes.join(groups.join(least, "component"), "node", "left").select("node", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return found.select("doc_id", "node").join(label, "node").select("doc_id", "node", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with only the document of the smallest doc_id of each group.

    A document is known by its doc_id, so repeated rows of the one that stays all stay, as do rows without one.
    """
    gone = similar_groups(docs, similarity, shingle).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
