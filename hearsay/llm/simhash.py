"""SimHash near-duplicates, found by pigeonring filtering.

A 64-bit fingerprint is cut into 9 consecutive segments on a ring. Two fingerprints that differ in at most
3 bits have a segment from which every chain of l following segments differs in at most 3 * l / 9 bits (the
pigeonring principle, strong form). Hence the first two segments of that chain are equal, and of the next three at
most one differs. Each fingerprint is therefore filed under 9 * 3 keys of about 28 bits; the members of a
key pass the longer chains' budgets before the full Hamming check.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; a null doc_id
takes part in no minimum and gets its group's component_id, null if the group has no doc_id; repeated rows
each come out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import written
from hearsay.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 9
#: Members of one key that are compared in one unit; larger keys are dealt out as pairs of blocks.
BLOCK = 8192
_CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash of UTF-8 text: a bit is set if it is set in over half the shingles' hashes."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, counts, digest = len(words) - SHINGLE + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + SHINGLE - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(part, part[1:], part[2:])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])


def segment_masks(segments: int = SEGMENTS) -> list[int]:
    """Bit masks of the ring's segments, the last ones a bit wider if they don't come out even."""
    ends = [64 * k // segments for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


def chain_mask(start: int, length: int, segments: int = SEGMENTS) -> int:
    """Bits of ``length`` consecutive segments from ``start`` on."""
    masks = segment_masks(segments)
    return sum(masks[(start + k) % segments] for k in range(length))


def key_masks() -> list[int]:
    """Mask 3 * s + c: segments s and s + 1, and of the next three all but the one at s + 2 + c."""
    masks = segment_masks()
    return [chain_mask(s, 5) & ~masks[(s + 2 + c) % SEGMENTS] for s in range(SEGMENTS) for c in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_groups(fps: np.ndarray, start: int) -> np.ndarray:
    """For each of the distinct fingerprints the index of its group's first member, linking pairs that pass.

    Spreads from one member at a time over those not reached yet, so a dense group costs little more
    than its size. Pairs drop out by the budgets of the chains from ``start``, then by the full distance.
    """
    tests = [(np.uint64(chain_mask(start, n)), n * DISTANCE // SEGMENTS) for n in (5, 8, SEGMENTS)]
    group = np.full(len(fps), -1, np.int64)
    left = np.arange(len(fps))
    while len(left):
        first, left = left[0], left[1:]
        group[first] = first
        queue = [first]
        while queue and len(left):
            near, diff = left, fps[left] ^ fps[queue.pop()]
            for mask, budget in tests:
                keep = np.bitwise_count(diff & mask) <= budget
                near, diff = near[keep], diff[keep]
            if len(near):
                group[near] = first
                queue.extend(near)
                left = left[group[left] < 0]
    return group


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chain, key, i, j, fp, rep), one unit's rows together: links (u, v) of representatives that span its groups."""

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        chain, _, _, _, fps, reps = rows
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:4]], axis=0)) + 1
        begins, ends = np.r_[0, change], np.r_[change, len(chain)]
        u, v = [], []
        pairs = begins[ends - begins == 2]
        close = pairs[np.bitwise_count((fps[pairs] ^ fps[pairs + 1]).view(np.uint64)) <= DISTANCE]
        u.append(reps[close])
        v.append(reps[close + 1])
        for a, b in zip(begins[ends - begins > 2], ends[ends - begins > 2]):
            group = linked_groups(fps[a:b].view(np.uint64), int(chain[a]) // 3)
            more = np.flatnonzero(group != np.arange(b - a))
            u.append(reps[a:b][group[more]])
            v.append(reps[a:b][more])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    kept: list[np.ndarray] = []
    for batch in batches:
        now = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if not len(now[0]):
            continue
        kept = [np.concatenate(x) for x in zip(kept, now)] if kept else now
        last = np.flatnonzero(np.any([x[1:] != x[:-1] for x in kept[:4]], axis=0))
        if len(last):
            cut = last[-1] + 1
            yield of([x[:cut] for x in kept])
            kept = [x[cut:] for x in kept]
    if kept:
        yield of(kept)


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes: distinct (fp, rep), without nulls. Returns (u, v): links between representatives, enough to join every linked pair."""
    filed = F.explode(F.array(*(F.struct(F.lit(k).cast("short").alias("chain"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(key_masks()))))
    members = nodes.select("fp", "rep", filed.alias("at")).select("at.chain", "at.key", "fp", "rep")
    sizes = members.groupBy("chain", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # Spark takes the members to be as large as the nodes' file, so without the hint it would broadcast 27 rows a node
    shared = members.join(sizes.hint("merge"), ["chain", "key"]).withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own"))))
    units = shared.withColumn("own", own).withColumn("other", other).select(
        "chain", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep"
    )
    by = ["chain", "key", "i", "j"]
    return units.repartition(*by).sortWithinPartitions(*by).mapInArrow(_links, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of ``docs`` (doc_id, text)."""
    found, _ = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    nodes, _ = written(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    # linked by fingerprint, so that those without a doc_id link others too
    linked = components(links(nodes.select("fp", F.col("fp").alias("rep"))))
    groups = linked.union(linked.select(F.col("component").alias("node"), "component").distinct())
    least = groups.join(nodes, groups.node == nodes.fp).groupBy("component").agg(F.min("rep").alias("least"))
    label = nodes.join(groups.join(least, "component"), nodes.fp == F.col("node"), "left").select("fp", F.when(F.col("node").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    # the file of many copies is small for its rows, which may not be broadcast either
    return found.join(label.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with only the document of the smallest doc_id of each group.

    A document is known by its doc_id, so repeated rows of the one that stays all stay, as do rows without one.
    """
    found = near_duplicates(docs)
    gone = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: fingerprint and component of every document."""
    from hearsay.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
