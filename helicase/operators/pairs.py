"""Distances of pairs of long strands, given ones or those that share a bucket: probes by slices of entries, strands at two bits a base."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from helicase.functions import minhash
from helicase.functions import seq as q
from helicase.functions.minhash import DIGIT, codes_of
from helicase.shipping import ship
from helicase.tables import checkpoint

#: As DIGIT, for bytes.translate().
DIGITS = DIGIT.astype(np.uint8).tobytes()
#: A byte's four bases as encode_2bit has them, packed.
FOUR = bytes(sum(DIGIT[ord(q.TRANSPORT[x >> 6 - 2 * j & 3])].item() << 2 * j for j in range(4)) for x in range(256))
#: Rows of a block of probes and of a slice of entries, near enough: rows are dealt out by hashes.
PROBES, ENTRIES = 1 << 12, 1 << 13
#: Codes that are kept of a block's probes.
KEPT = 1 << 23
BASES = np.frombuffer(q.BASES.encode(), np.uint8)
#: Packed bytes of a slice of entries, and of a block of the probes that it meets.
SLICE_BYTES, BLOCK_BYTES = 1 << 25, 1 << 25
#: Probes of such a block, and k-mers whose hashes are kept.
MET, HASHED = 1 << 13, 1 << 18
#: Bytes of a block's bitmaps, and rows of a batch of pairs.
BITMAPS, ROWS = 1 << 25, 1 << 18


def pack(strand: str) -> bytes:
    """Two bits a base, after a byte that says how many bases of the last byte count."""
    digits = np.frombuffer(strand.encode().translate(DIGITS), np.uint8)
    four = np.concatenate((digits, np.zeros(-len(digits) % 4, np.uint8))).reshape(-1, 4)
    return bytes([len(digits) % 4]) + (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8).tobytes()


def unpack(packed: bytes) -> str:
    x = np.frombuffer(packed, np.uint8, offset=1)
    digits = np.stack((x & 3, x >> 2 & 3, x >> 4 & 3, x >> 6), axis=1).ravel()
    return BASES[digits[: len(digits) - (4 - packed[0]) % 4]].tobytes().decode()


def packed_strand(seq) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else pack(x) for x in s], index=s.index, dtype=object)

    return run(q._col(seq))


def _distance(u: np.ndarray, v: np.ndarray) -> float | None:
    both = len(np.intersect1d(u, v, assume_unique=True))
    union = len(u) + len(v) - both
    return 1 - both / union if union else None


def distances_of(probes: dict, entries: list[tuple], k: int):
    """(probe, key, distance) of each entry (key, packed strand, probes): codes of a probe are kept while there is room."""
    kept: dict = {}
    room = KEPT
    for key, strand, asked in entries:
        own = codes_of(unpack(strand), k) if strand is not None else None
        for p in asked:
            text = probes.get(p)
            if text is None or own is None:
                yield p, key, None
                continue
            if text == strand:
                yield p, key, 0.0 if len(own) else None
                continue
            codes = kept.pop(p, None)
            if codes is None:
                codes = codes_of(unpack(text), k)
                room -= len(codes)
            kept[p] = codes
            while room < 0 and len(kept) > 1:  # the one that wasn't asked for longest goes
                room += len(kept.pop(next(iter(kept))))
            yield p, key, _distance(codes, own)


def distances(candidates: DataFrame, strands: DataFrame, k: int) -> DataFrame:
    """(probe, key, distance) of each pair (probe, key); strands: (id, seq)."""
    ship(candidates)
    n = candidates.select(F.count_distinct("probe"), F.count_distinct("key")).first()
    blocks, slices = max(1, -(-n[0] // PROBES)), max(1, -(-n[1] // ENTRIES))
    dealt = lambda x, m: F.pmod(F.xxhash64(x), F.lit(m)).cast("int")
    packed = lambda name: strands.select(F.col("id").alias(name), packed_strand("seq").alias("strand"))
    asked = candidates.groupBy("key", dealt("probe", blocks).alias("block")).agg(F.collect_list("probe").alias("probes"))
    right = asked.join(packed("key"), "key").select("block", dealt("key", slices).alias("slice"), "key", "strand", "probes")
    left = candidates.select("probe").distinct().join(packed("probe"), "probe")
    left = left.select(dealt("probe", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "probe", "strand")
    types = {c: candidates.schema[c].dataType for c in ("probe", "key")}
    schema = StructType([*(StructField(c, t) for c, t in types.items()), StructField("distance", DoubleType())])

    def run(p: pa.Table, e: pa.Table) -> pa.Table:
        texts = dict(zip(p["probe"].to_pylist(), p["strand"].to_pylist(), strict=True))
        entries = zip(e["key"].to_pylist(), e["strand"].to_pylist(), e["probes"].to_pylist(), strict=True)
        rows = list(distances_of(texts, entries, k))
        kinds = p.schema.field("probe").type, e.schema.field("key").type, pa.float64()
        return pa.table({c: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(("probe", "key", "distance"))})

    met = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(run, schema)
    return met.select("probe", "key", "distance")


def ranks_of(packed: bytes, k: int) -> np.ndarray:
    """Ranks of a packed strand's k-mers: of every fourth, from the first, second, third and fourth on."""
    x = np.frombuffer(packed, np.uint8, offset=1)
    n = 4 * len(x) - (4 - packed[0]) % 4 - k + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    wide = -(-(k + 3) // 4)
    x = np.concatenate((x, np.zeros(wide, np.uint8))).astype(np.uint32 if wide <= 4 else np.uint64)
    m = len(x) - wide
    window = x[:m].copy()
    for j in range(1, wide):
        window |= x[j : m + j] << (8 * j)
    out = np.empty(n, window.dtype)
    at = 0
    for o in range(4):
        there = (n - o + 3) // 4
        np.right_shift(window[:there], 2 * o, out=out[at : at + there])
        at += there
    out &= out.dtype.type(4**k - 1)
    return out.astype(np.uint32, copy=False)


def _distinct(ranks: np.ndarray) -> np.ndarray:
    x = np.sort(ranks)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def pack_bytes(data: bytes) -> bytes:
    """The packed strand that stands for bytes, four bases each."""
    return b"\0" + data.translate(FOUR)


class _Minima:
    """Minima of strands one after another. Hashes of the first HASHED k-mers are kept, as texts have most in common."""

    def __init__(self, lsh: minhash.Lsh):
        self.lsh, self.n = lsh, 0
        if lsh.k <= 12:
            self.table = np.full(4**lsh.k, -1, np.int32)
            self.hashes = np.empty((HASHED, lsh.r), np.uint32)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The r minima of different codes."""
        if self.lsh.k > 12:
            return minhash.least(codes, self.lsh)
        own = self.table[codes]
        new = codes[own < 0]
        if self.n + len(new) > HASHED:
            return minhash.least(codes, self.lsh)
        if len(new):
            self.table[new] = np.arange(self.n, self.n + len(new))
            self.hashes[self.n : self.n + len(new)] = minhash.hashes(new, self.lsh).T
            self.n += len(new)
            own = self.table[codes]
        best = self.hashes.take(own, axis=0)
        while len(best) > 1:  # halves of many rows at once, not row by row
            half = len(best) // 2
            best = np.concatenate((np.minimum(best[:half], best[half : 2 * half]), best[2 * half :])) if len(best) % 2 else np.minimum(best[:half], best[half:])
        return best[0]


def described(strands: DataFrame, lsh: minhash.Lsh) -> DataFrame:
    """(id, sig, size, strand) of strands (id, seq) with k-mers: the r minima as numbers of four bytes, how many k-mers
    there are, and the packed strand. seq: bases, or binary for the bytes whose bases ``encode_2bit`` writes, which costs
    a small part of writing them."""
    kind, plain = strands.schema["id"], strands.schema["seq"].dataType == BinaryType()

    def run(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = _Minima(lsh)
        for t in tables:
            for start in range(0, t.num_rows, 1 << 10):
                some = t.slice(start, 1 << 10)
                rows = []
                for s in some.column(1):
                    strand = pack_bytes(s.as_py()) if plain else pack(s.as_py())
                    codes = _distinct(ranks_of(strand, lsh.k))
                    rows.append((minima.of(codes).astype("<u4").tobytes(), len(codes), strand))
                yield pa.record_batch([some.column(0), *(pa.array(x, y) for x, y in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True))], names=["id", "sig", "size", "strand"])

    schema = StructType([kind, StructField("sig", BinaryType()), StructField("size", IntegerType()), StructField("strand", BinaryType())])
    return ship(strands).where(F.length("seq") * (4 if plain else 1) >= lsh.k).select("id", "seq").mapInArrow(run, schema)


class _Block:
    """Probes' k-mer sets for meeting many entries: the k-mers of many probes as bitmaps, the probes of each other one."""

    def __init__(self, rows: list[tuple], lsh: minhash.Lsh):
        """rows: (id, sig, size, strand). Probes with one strand are one."""
        same: dict[bytes, list] = {}
        for i, (_, _, _, strand) in enumerate(rows):
            same.setdefault(strand, []).append(i)
        first = [x[0] for x in same.values()]
        self.counts = np.array([len(x) for x in same.values()])
        self.starts = np.cumsum(self.counts) - self.counts
        self.rows = np.array([i for x in same.values() for i in x])
        self.at = {rows[i][0]: i for i in range(len(rows))}
        self.sizes = np.array([rows[i][2] for i in first], np.int64)
        self.lsh, self.width = lsh, 4 * lsh.r // lsh.b
        self.buckets: list[dict] = []
        for x in range(0, 4 * lsh.r, self.width):
            held: dict[bytes, list] = {}
            for n, i in enumerate(first):
                held.setdefault(rows[i][1][x : x + self.width], []).append(n)
            self.buckets.append({s: np.array(v) for s, v in held.items()})
        sets = [_distinct(ranks_of(rows[i][3], lsh.k)) for i in first]
        if lsh.k <= 12:
            self.table = np.zeros(4**lsh.k, np.int32)
            for x in sets:
                self.table[x] += 1
            columns = np.flatnonzero(self.table).astype(np.uint32)
            often = self.table[columns]
        else:
            columns, often = np.unique(np.concatenate(sets), return_counts=True)
        # a bitmap's column costs a bit for each pair, another one a row for each of its probes
        most = 8 * BITMAPS // len(first)
        dense = min(int((often * 32 >= len(first)).sum()), max(64, most // 64 * 64))
        order = np.argsort(-often, kind="stable")
        self.dense = -(-dense // 64) * 64
        place = np.empty(len(columns), np.int64)
        place[order] = np.concatenate((np.arange(1, dense + 1), np.arange(self.dense + 1, self.dense + 1 + len(columns) - dense)))
        self.last = self.dense + len(columns) - dense
        self.columns, self.place = columns, place
        if lsh.k <= 12:
            self.table[columns] = place
        self.bits = np.empty((len(first), self.dense // 64), np.uint64)
        rare = []
        for n, x in enumerate(sets):
            own = self._places(x)
            mark = np.zeros(self.dense + 1, bool)
            mark[own[own <= self.dense]] = True
            self.bits[n] = np.packbits(mark[1:]).view(np.uint64)
            rare.append(own[own > self.dense])
        where = np.concatenate(rare)
        order = np.argsort(where, kind="stable")
        self.owners = np.repeat(np.arange(len(rare), dtype=np.int32), [len(x) for x in rare])[order]
        self.edges = np.searchsorted(where[order], np.arange(self.dense + 1, self.last + 2))
        self.mark = np.zeros(self.last + 1, bool)

    def _places(self, ranks: np.ndarray) -> np.ndarray:
        """Of k-mers among the columns, from 1 on; 0 for one that no probe has."""
        if self.lsh.k <= 12:
            return self.table[ranks]
        at = np.minimum(np.searchsorted(self.columns, ranks), len(self.columns) - 1)
        return np.where(self.columns[at] == ranks, self.place[at], 0)

    def met(self, sig: bytes) -> np.ndarray | None:
        """The probes that share a bucket."""
        found = [y for n, x in enumerate(self.buckets) if (y := x.get(sig[n * self.width : (n + 1) * self.width])) is not None]
        if len(found) < 2:
            return found[0] if found else None
        hit = np.zeros(len(self.sizes), bool)
        for x in found:
            hit[x] = True
        return np.flatnonzero(hit)

    def distances(self, met: np.ndarray, strand: bytes, size: int) -> np.ndarray:
        """Of an entry to the probes met."""
        self.mark[:] = False
        self.mark[self._places(ranks_of(strand, self.lsh.k))] = True
        bits = np.packbits(self.mark[1 : self.dense + 1]).view(np.uint64)
        both = np.empty(len(met), np.int64)
        step = max(1, (1 << 17) // max(1, len(bits)))  # what a core's cache holds
        for i in range(0, len(met), step):
            both[i : i + step] = np.bitwise_count(self.bits[met[i : i + step]] & bits).sum(axis=1, dtype=np.uint32)
        rare = np.flatnonzero(self.mark[self.dense + 1 :])
        if len(rare):
            n = self.edges[rare + 1] - self.edges[rare]
            rows = np.repeat(self.edges[rare] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both += np.bincount(self.owners[rows], minlength=len(self.sizes))[met]
        return 1 - both / (self.sizes[met] + size - both)


def _pairs(block: list[tuple], entries: dict, lsh: minhash.Lsh) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of block, numbers of entries, distances) of the pairs that share a bucket, but for those of one id. entries:
    (sig, size, ids, their numbers) by strand, so that those with one strand are compared once."""
    probes = _Block(block, lsh)
    for strand, (sig, size, ids, numbers) in entries.items():
        met = probes.met(sig)
        if met is None:
            continue
        far = probes.distances(met, strand, size)
        n = probes.counts[met]
        rows = probes.rows[np.repeat(probes.starts[met] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        far = np.repeat(far, n)
        for key, number in zip(ids, numbers, strict=True):
            own = probes.at.get(key)
            other = slice(None) if own is None else rows != own
            yield rows[other], np.full(len(rows[other]), number), far[other]


def near(strands: DataFrame, asked: Column, lsh: minhash.Lsh) -> DataFrame:
    """(probe, key, distance) of each strand (id, seq), as for ``described``, for which asked holds, a condition on id, to
    every other one with which it shares a bucket. A slice of entries meets its probes in one task, block by block; entries travel once, probes once for
    each slice that has any of their buckets, and no pair is a row before its distance is known."""
    every = checkpoint(described(strands, lsh))
    n, size = every.agg(F.count("*"), F.coalesce(F.sum(F.length("strand")), F.lit(0))).first()
    slices = max(2 * every.sparkSession.sparkContext.defaultParallelism, -(-n // ENTRIES), -(-size // SLICE_BYTES))
    width = 4 * lsh.r // lsh.b
    bucket = F.explode(F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(lsh.b)])).alias("bucket")
    to = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice")
    probes = every.where(asked)
    wanted = probes.select("id", bucket).join(every.select(to, bucket).distinct(), "bucket").select("id", "slice").distinct()
    columns = ["slice", "kind", "id", "sig", "size", "strand"]
    dealt = every.withColumns({"slice": to, "kind": F.lit(0)}).select(*columns).unionByName(probes.join(wanted, "id").withColumn("kind", F.lit(1)).select(*columns))
    kind = strands.schema["id"].dataType

    def run(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: dict = {}
        names: list = []
        block: list[tuple] = []
        held = 0
        out: list[tuple] = []
        arrow = None

        def batch() -> pa.RecordBatch:
            p, e, far = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            of = lambda x, i: pa.array(x, arrow).take(pa.array(i))
            return pa.record_batch([of([x[0] for x in block], p), of(names, e), pa.array(far)], names=["probe", "key", "distance"])

        def meet() -> Iterator[pa.RecordBatch]:
            rows = 0
            for x in _pairs(block, entries, lsh):
                out.append(x)
                rows += len(x[0])
                if rows >= ROWS:
                    rows = 0
                    yield batch()
            if out:
                yield batch()

        for t in tables:
            arrow = t.schema.field("id").type
            for which, i, sig, n, strand in zip(*[t[c].to_pylist() for c in columns[1:]], strict=True):
                if which == 0:
                    same = entries.setdefault(strand, (sig, n, [], []))
                    same[2].append(i)
                    same[3].append(len(names))
                    names.append(i)
                    continue
                block.append((i, sig, n, strand))
                held += len(strand)
                if len(block) >= MET or held >= BLOCK_BYTES:
                    yield from meet()
                    block.clear()
                    held = 0
        if block:
            yield from meet()

    schema = StructType([StructField("probe", kind), StructField("key", kind), StructField("distance", DoubleType())])
    return dealt.repartitionById(slices, F.col("slice")).sortWithinPartitions("kind").mapInArrow(run, schema)
