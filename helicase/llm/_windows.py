"""Word windows as 64-bit hashes, and their exchange in packed fragments.

A batch of texts becomes one array of word hashes; window hashes are polynomials over it. Hashes go out grouped by
fragment, a contiguous range of the hash order: a row holds the ids of some documents, their counts and the hashes' low
bytes in document order. So an exchange moves few, large rows and costs few bytes beside the hashes, and a fragment
holds an even share of any corpus, whatever its documents repeat.

Rows are made of ``PACK_HASHES`` hashes at a time, over all batches of a task, and for ``FAN`` fragments at most; more
fragments are reached in levels, each of which deals the rows of a range of fragments out to ``FAN`` smaller ranges
(``exchange``). So the number of rows follows the number of hashes, whatever the number of fragments.

Hashes are 64 bits wide: among n different windows about n * n / 2**65 pairs collide, 0.0005 for 10**8.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Words whose hashes are remembered between texts; the memory is dropped when full.
REMEMBERED = 1 << 18
#: Bytes of text that are worked on at once.
BATCH_BYTES = 8 << 20


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def of_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; empty where there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= FACTOR
        out += h[j : n + j]
    out ^= out >> np.uint64(32)
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def batches(tables: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, so that memory follows the texts and not the number of rows."""
    for b in tables:
        if b.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:], strict=False):
            yield b.slice(i, j - i)


def texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int32)


def low_bytes(h: np.ndarray, width: int) -> bytes:
    return h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def from_low_bytes(data: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(data, "<u8")
    if width == 4:
        return np.frombuffer(data, "<u4")
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view("<u8")


PACKED = "fragment int, ids binary, counts binary, hashes binary"
#: Hashes that are packed at once, and ranges of fragments that these go to.
PACK_HASHES, FAN = 1 << 21, 64


def at_least(fragments: int) -> int:
    """Fragments for an exchange: few inputs get as many as half a fan, so that rows are as many for each byte at any size."""
    return max(FAN // 2, fragments)


def levels(fragments: int) -> list[int]:
    """Sizes of the ranges of fragments, level by level, the last of one fragment each."""
    sizes = [1]
    while sizes[0] * FAN < fragments:
        sizes.insert(0, sizes[0] * FAN)
    return sizes


def pack(h: np.ndarray, ids: np.ndarray, counts: np.ndarray, fragments: int, width: int, range_size: int = 1) -> pa.RecordBatch:
    """Rows of PACKED: h holds counts[i] hashes of document ids[i] for each i in turn. A row is for a range of fragments."""
    frag = fragment_of(h, fragments) // range_size
    order = np.argsort(frag.astype(np.uint16) if fragments < 1 << 16 else frag, kind="stable")
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[order]
    h, frag = h[order], frag[order]
    del order
    edges = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
    rows: list[list] = [[], [], [], []]
    for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        inside = doc[start:end]
        at = np.flatnonzero(np.concatenate([[True], inside[1:] != inside[:-1]]))  # in document order
        per = np.diff(np.append(at, len(inside)))
        for k, v in enumerate((int(frag[start]), ids[inside[at]].astype("<i8").tobytes(), per.astype("<u4").tobytes(), low_bytes(h[start:end], width))):
            rows[k].append(v)
    return pa.record_batch([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["fragment", "ids", "counts", "hashes"])


def packed(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], fragments: int, width: int, size: int, most: int = PACK_HASHES) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED for ranges of so many fragments; parts: (h, ids, counts) of pack."""
    width = 8 if size > 1 else width  # the bits that tell the fragment must stay until it is reached
    held: list[tuple] = []
    n = 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
            yield pack(*whole, fragments, width, size)
    if n:
        yield pack(*[np.concatenate(x) for x in zip(*held, strict=True)], fragments, width, size)


def _dealt(fragments: int, width: int, size: int) -> Callable:
    def run(tables):
        rows = (row for b in tables for row in zip(*[b.column(k).to_pylist() for k in (1, 2, 3)], strict=True))
        parts = ((from_low_bytes(h, 8), np.frombuffer(i, "<i8"), np.frombuffer(n, "<u4")) for i, n, h in rows)
        yield from packed(parts, fragments, width, size)

    return run


def exchange(rows: DataFrame, fragments: int, width: int) -> DataFrame:
    """Rows of ``packed`` for the first of ``levels``, each fragment's in one partition."""
    first, *finer = levels(fragments)
    out = rows.repartitionById(-(-fragments // first), F.col("fragment"))
    for size in finer:
        out = out.mapInArrow(_dealt(fragments, width, size), PACKED).repartitionById(-(-fragments // size), F.col("fragment"))
    return out


def unpack(tables: Iterable[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(fragment, ids, counts, hashes) of each fragment in a partition; all of its rows must be there."""
    held: dict[int, list] = {}
    for b in tables:
        for f, i, n, h in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
            held.setdefault(f, []).append((i, n, h))
    for f in sorted(held):
        rows = held.pop(f)
        yield f, *(np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in ((0, "<i8"), (1, "<u4"))), from_low_bytes(b"".join(r[2] for r in rows), width)
