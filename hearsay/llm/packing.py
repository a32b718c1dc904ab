"""Best-fit packing of tokenised documents with certified bin counts.

Documents become token ids and a closing id. Only those over the capacity are cut: the remainder is the
first piece, the others fill a sequence each and need no search. What is shorter than a sequence is packed
partition by partition with best-fit decreasing, and a lower bound from dual feasible functions certifies the
partition's bin count. Partitions that use more bins than the bound give their least filled bins
up; those documents are exchanged among ever fewer partitions and packed again, until what is left fits one, or
no exchange leaves less. No partition of any round has many more than PART_ROWS documents.

Ids are those of the ``tokenizers`` library for the vocabulary: its added tokens, read from the json file beside
the ranks if there is one, stand for themselves wherever a text holds them; what is between them is split on its own. Texts of ASCII and the Latin letters up to
U+024F are split by an equivalent expression of explicit ranges, others by the vocabulary's own, and each
distinct piece is merged once a process.

Defined cases: a null text is empty, that is one closing id; a null doc_id is packed like any other; every repeated
row is packed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.common import table, written

CAPACITY = 2048
CLOSING_ID = 0
#: Documents of one partition in the first round, about.
PART_ROWS = 20_000
#: Partitions whose open bins meet in one partition of the next round.
FAN_IN = 16
#: Distinct pieces of text whose ids a process keeps.
CACHE = 500_000

_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t-\r \u0085 "
_PLAIN = re.compile("[ɐ-\U0010ffff\x1c-\x1f]")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


class ByteTokenizer(dict):
    """Little-endian 32-bit ids of texts; as a mapping, of pieces already merged."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._merge = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._split = regex.compile(pattern).findall
        self._added = {text: struct.pack("<I", number) for text, number in (added or {}).items()}
        # as the library does: the leftmost, of those that begin there the longest
        self._cut = re.compile(f"({'|'.join(map(re.escape, sorted(self._added, key=len, reverse=True)))})").split if self._added else None

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = struct.pack(f"<{len(merged := self._merge(piece.encode()))}I", *merged)
        return ids

    def encode(self, text: str) -> bytes:
        if self._cut is None:
            return self._between(text)
        return b"".join([self._added[part] if k % 2 else self._between(part) for k, part in enumerate(self._cut(text))])

    def _between(self, text: str) -> bytes:
        pieces = self._split(text) if _PLAIN.search(text) else _PIECES.findall(text)
        return b"".join([self[p] for p in pieces])


_LOADED: dict[str, ByteTokenizer] = {}


def added_tokens(ranks_path: str) -> dict[str, int]:
    """Texts and ids of the added tokens in the json file of the same name; none if there is no such file."""
    path = os.path.splitext(ranks_path)[0] + ".json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        found = json.load(f).get("added_tokens") or []
    odd = [t["content"] for t in found if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
    if odd:
        raise ValueError(f"added tokens that take blanks or whole words only: {odd}")
    return {t["content"]: t["id"] for t in found}


def tokenizer(ranks_path: str) -> ByteTokenizer:
    """One for each process and vocabulary file."""
    if ranks_path not in _LOADED:
        import public_tokenizers

        _LOADED[ranks_path] = ByteTokenizer(ranks_path, public_tokenizers.PATTERN, added_tokens(ranks_path))
    return _LOADED[ranks_path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def _pieces(ranks_path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, closing = tokenizer(ranks_path), np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            for k, text in enumerate(batch.column(1)):
                data = own.encode(text.as_py() or "") + closing
                for piece, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    ids = data[4 * start : 4 * (start + length)]
                    for col, x in zip(cols, (k, piece, start, length, zlib.crc32(ids), np.frombuffer(ids, "<u4").astype(np.int32) if keep_ids else None)):
                        col.append(x)
            arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays, names = [*arrays, pa.array(cols[5], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, into the fullest bin that still takes it."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by what is left
    lefts: list[int] = []  # those that have bins, in order
    used = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[k])
        at = bisect_left(lefts, need)
        if at < len(lefts):
            left = lefts[at]
            own = open_bins[left].pop()
            if not open_bins[left]:
                lefts.pop(at)
        else:
            left, own, used = capacity, used, used + 1
        bins[k], offsets[k] = own, capacity - left
        if rest := left - need:
            if not open_bins[rest]:
                insort(lefts, rest)
            open_bins[rest].append(own)
    return bins, offsets


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs: the best of the volume and two families of dual feasible functions, over all their parameters."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    volume, above = np.cumsum(count * np.arange(capacity + 1)), np.cumsum(count[::-1])[::-1]
    best = -(-int(volume[-1]) // capacity)
    e = np.arange(0, capacity // 2 + 1)
    # sizes under e count nothing, those over capacity - e a whole bin
    big = np.r_[above, 0][capacity - e + 1]
    middle = volume[capacity - e] - np.where(e > 0, volume[np.maximum(e - 1, 0)], 0)
    best = max(best, int((big + -(-middle // capacity)).max()))
    for k in range(1, 101):  # rounding x (k + 1) / capacity down to k-ths, but for exact multiples
        x = np.arange(capacity + 1) * (k + 1)
        weight = np.where(x % capacity == 0, np.arange(capacity + 1) * k, x // capacity * capacity)  # in 1 / (k * capacity) of a bin
        best = max(best, -(-int((count * weight).sum()) // (k * capacity)))
    return best


def pack(sizes: np.ndarray, capacity: int = CAPACITY, final: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, offsets and which bins are settled.

    If the bound certifies the count, only the least filled bin is given up, to be filled with others'. Else so
    many of the least filled as the count is over the bound, one more to exchange with, and every other
    bin that is less than nine tenths full. Full bins stay.
    """
    bins, offsets = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    gap = len(fill) - lower_bound(sizes, capacity)
    settled = np.ones(len(fill), bool)
    if not final:
        settled[np.argsort(fill, kind="stable")[: gap + 1]] = False
        settled[(gap > 0) & (fill * 10 < capacity * 9)] = False
        settled[fill == capacity] = True
    return bins, offsets, settled


def _packed(capacity: int, final: bool):
    def run(key, rows):
        part = key[0].as_py()
        sizes = rows.column("length").to_numpy()
        bins, offsets, settled = pack(sizes, capacity, final)
        done = settled[bins]
        return pa.table({"row": rows.column("row"), "length": rows.column("length"), "part": np.full(len(sizes), part, np.int64), "bin": np.where(done, bins, -1), "offset": offsets})

    return run


def pack_documents(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True, part_rows: int = PART_ROWS) -> DataFrame:
    """docs (doc_id, text): (doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset), a row for each piece.

    ranks_path: the vocabulary's merge ranks, a file every executor has; None: the installed one.
    """
    import public_tokenizers

    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    cut_up = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(ranks_path, capacity, keep_ids), schema)
    pieces, _ = written(cut_up.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("row") * 2, "offset": F.lit(0).cast("long")})
    rest = pieces.where(F.col("length") < capacity).select("row", "length")
    n = rest.count()
    parts, placed, level, last = max(1, -(-n // part_rows)), [], 0, False
    while n:
        last = last or parts == 1
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(parts)))
        packed, _ = written(dealt.groupBy("part").applyInArrow(_packed(capacity, last), "row long, length long, part long, bin long, offset long"), "packed")
        # odd numbers, apart for each level, partition and bin
        place = ((F.lit(level) * 2**24 + F.col("part")) * 2**24 + F.col("bin")) * 2 + 1
        placed.append(packed.where("bin >= 0").select("row", place.alias("sequence_id"), "offset"))
        rest = packed.where("bin < 0").select("row", "length")
        if last:
            break
        n, level = rest.count(), level + 1
        fewer = max(-(-parts // FAN_IN), -(-n // part_rows))
        parts, last = min(parts, fewer), fewer >= parts
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, "sequence_id", "offset"]
    out = whole.select(*columns)
    if placed:
        places = placed[0]
        for x in placed[1:]:
            places = places.union(x)
        out = out.union(pieces.where(F.col("length") < capacity).join(places, "row").select(*columns))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """op8: pieces of every document and their places."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
