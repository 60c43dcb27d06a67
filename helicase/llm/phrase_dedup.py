"""Repeated-phrase removal: recurring passages are confirmed, compiled into automata per shard, and located in all documents.

1. Every window of ``k`` words goes, as a hash, to a fragment of the hash order (see _windows), where windows that
   start in two or more documents are confirmed to recur; the smallest document of each is its owner.
2. A shard is a bounded share of the documents. It is told the recurring windows and owners of its own documents.
   Runs of such windows with one owner are passages; their word sequences are compiled into the shard's Aho-Corasick
   automaton, and all documents of the shard are streamed through it, whole, to locate every occurrence.
3. Words inside an occurrence of a passage whose owner is a smaller document are removed.

So the number of automata and what each holds follow from the shard's documents, not from the corpus; no passage is
sent to a shard where it doesn't occur. Passages that a third of all documents share cost a fragment one sort entry per
document and a shard one pattern.

Defined cases: null or empty text: no words, nothing removed, empty kept text. Texts shorter than a window stay whole.
Repeated rows: documents are compared by id, so rows with one id don't remove each other's words, and each keeps its
own result. A null id is larger than all others: it loses words to any document and owns none; such rows are dealt out
by their texts. Ids are below ``NULLS``, the highest million of a long.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c
from helicase.llm import _windows as win

#: Rows without an id get one of the highest ones, by their text; these own nothing.
SPREAD = 1 << 20
NULLS = int(np.iinfo(np.int64).max) - SPREAD
SHARD_BYTES = 16 << 20
PRIME, STEP = (1 << 31) - 1, 48271


def shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    return ids % PRIME * STEP % PRIME % shards


def shard_column(key: Column, shards: int) -> Column:
    return F.pmod(F.pmod(F.pmod(key, F.lit(PRIME)) * STEP, F.lit(PRIME)), F.lit(shards)).cast("int")


def _text_windows(words: list[list[bytes]], k: int, known: win.WordHashes) -> list[np.ndarray]:
    every = win.windows(win.of_words([w for ws in words for w in ws], known), k)
    out, at = [], 0
    for ws in words:
        out.append(every[at : at + max(0, len(ws) - k + 1)])
        at += len(ws)
    return out


def _send(k: int, fragments: int) -> Callable:
    def parts(tables):
        known = win.WordHashes()
        for b in win.batches(tables, 1):
            per = [np.unique(h) for h in _text_windows([t.split() for t in win.texts(b.column(1))], k, known)]
            yield np.concatenate(per), b.column(0).to_numpy(zero_copy_only=False), np.array([len(h) for h in per])

    first = win.levels(fragments)[0]
    return lambda tables: win.packed(parts(tables), fragments, 8, first)


#: Windows that documents of some shards share with smaller ones: runs of one shard and owner, their lengths, the windows.
TOLD = "range int, shards binary, owners binary, counts binary, hashes binary"


def _told(shard: np.ndarray, owner: np.ndarray, h: np.ndarray, size: int) -> pa.RecordBatch:
    """Rows of TOLD, one for each range of shards; windows are told to a shard once."""
    order = np.lexsort((h, owner, shard))
    shard, owner, h = shard[order], owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
    shard, owner, h = shard[new], owner[new], h[new]
    rows: list[list] = [[], [], [], [], []]
    edges = np.flatnonzero(np.concatenate([[True], shard[1:] // size != shard[:-1] // size, [True]])) if len(h) else np.zeros(1, np.int64)
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        at = np.flatnonzero(np.concatenate([[True], (owner[i + 1 : j] != owner[i : j - 1]) | (shard[i + 1 : j] != shard[i : j - 1])]))
        many = np.diff(np.append(at, j - i))
        for column, v in zip(rows, (int(shard[i]) // size, shard[i:j][at].astype("<i4").tobytes(), owner[i:j][at].astype("<i8").tobytes(), many.astype("<u4").tobytes(), h[i:j].tobytes()), strict=True):
            column.append(v)
    return pa.record_batch([pa.array(rows[0], pa.int32()), *[pa.array(x, pa.binary()) for x in rows[1:]]], names=["range", "shards", "owners", "counts", "hashes"])


def _untold(rows: Iterable[tuple[bytes, bytes, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, owner, window) of rows of TOLD."""
    shards, owners, counts, hashes = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*rows, strict=True), ("<i4", "<i8", "<u4", "<u8"), strict=True))
    return np.repeat(shards, counts), np.repeat(owners, counts), hashes


def _gathered(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], size: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[2])
        if n >= win.PACK_HASHES:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, n = [], 0
            yield _told(*whole, size)
    if n:
        yield _told(*[np.concatenate(x) for x in zip(*held, strict=True)], size)


def _recurring(shards: int, size: int) -> Callable:
    """Rows of TOLD: the windows that shards' documents share with a smaller one."""

    def parts(tables):
        for _, ids, counts, h in win.unpack(tables, 8):
            order = np.argsort(h, kind="stable")
            h, doc = h[order], np.repeat(ids, counts)[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            owner = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.append(start, len(h)))) if len(h) else doc
            lost = (doc > owner) & (owner < NULLS)
            yield shard_of(doc[lost], shards), owner[lost], h[lost]

    return lambda tables: _gathered(parts(tables), size)


def _dealt(size: int) -> Callable:
    def run(tables):
        yield from _gathered((_untold([row]) for b in tables for row in zip(*[b.column(k).to_pylist() for k in range(1, 5)], strict=True)), size)

    return run


class Passages:
    """The automaton of a shard: recurring passages as sequences of word numbers, with their owners."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.owners: dict[tuple[int, ...], int] = {}

    def sequence(self, words: list[bytes]) -> tuple[int, ...]:
        return tuple(map(self.numbers.__getitem__, words))

    def windows(self, texts: list[tuple[int, ...]], k: int) -> Iterator[np.ndarray]:
        """Window hashes of each text; each different word is hashed once."""
        of = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        for text in texts:
            yield win.windows(of[np.array(text, np.int64)], k)

    def add(self, text: tuple[int, ...], owners: np.ndarray, k: int) -> None:
        """owners: of each window of text, -1 where it doesn't recur. Runs of windows with one owner are passages."""
        edge = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1], [True]])) if len(owners) else []
        for i, j in zip(edge, edge[1:], strict=False):
            if owners[i] >= 0:
                self.owners[text[i : j - 1 + k]] = int(owners[i])

    def compile(self) -> None:
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for passage, owner in self.owners.items():
            self.automaton.add_word(passage, (len(passage), owner))
        if self.owners:
            self.automaton.make_automaton()
        self.used, self.owners = bool(self.owners), {}  # the automaton has them now

    def covered(self, text: tuple[int, ...], doc: int) -> np.ndarray:
        """Which words of document doc lie in a passage that a smaller document owns."""
        depth = np.zeros(len(text) + 1, np.int64)
        found = ((last, length) for last, (length, owner) in self.automaton.iter(text) if owner < doc) if self.used else iter(())
        while some := list(islice(found, 1 << 14)):
            last, length = np.array(some).T
            depth += np.bincount(last + 1 - length, minlength=len(depth)) - np.bincount(last + 1, minlength=len(depth))
        return np.cumsum(depth[:-1]) > 0


def _spans(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return [{"start": int(i), "end": int(j)} for i, j in zip(edge[::2], edge[1::2], strict=True)]


RESULT = "id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string"


def _locate(k: int) -> Callable:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        passages = Passages()
        rows = list(zip(*[told[x].to_pylist() for x in ("shards", "owners", "counts", "hashes")], strict=True))
        _, owner, h = _untold(rows) if rows else (None, np.empty(0, np.int64), np.empty(0, np.uint64))
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        ids = docs["id"].to_numpy()
        raw = win.texts(docs["text"].combine_chunks())
        texts = [passages.sequence(t.split()) for t in raw]  # numbers only: all words at once would take ten times the texts
        for doc, text, mine in zip(ids.tolist(), texts, passages.windows(texts, k), strict=True):
            if len(h) and len(mine):
                at = np.minimum(np.searchsorted(h, mine), len(h) - 1)
                passages.add(text, np.where((h[at] == mine) & (owner[at] < doc), owner[at], -1), k)
        passages.compile()
        out: list[list] = [[], [], [], []]
        for doc, text, t in zip(ids.tolist(), texts, raw, strict=True):
            gone, ws = passages.covered(text, doc), t.split()
            kept = b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g] if gone.any() else ws)
            for column, v in zip(out, (len(ws), int(gone.sum()), _spans(gone), kept.decode("utf-8", "replace")), strict=True):
                column.append(v)
        return pa.table(
            {"id": docs["id"], "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()),
             "spans": pa.array(out[2], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept_text": pa.array(out[3], pa.string())}
        )

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """(id, n_words, n_removed, spans of removed words, kept_text) for every row of df."""
    text = F.col(f"`{text_col}`")
    none = F.lit(NULLS) + F.pmod(F.xxhash64(text), F.lit(SPREAD))
    docs = c.ship(df).select(F.coalesce(F.col(f"`{id_col}`").cast("long"), none).alias("id"), text.alias("text"))
    size = c.scan_bytes(df)
    fragments, shards = win.at_least(-(-size // SHARD_BYTES)), win.at_least(-(-2 * size // SHARD_BYTES))
    packed = docs.mapInArrow(_send(k, fragments), win.PACKED)
    first, *finer = win.levels(shards)
    told = win.exchange(packed, fragments, 8).mapInArrow(_recurring(shards, first), TOLD).repartitionById(-(-shards // first), F.col("range"))
    for step in finer:
        told = told.mapInArrow(_dealt(step), TOLD).repartitionById(-(-shards // step), F.col("range"))
    told = told.withColumnRenamed("range", "shard")
    dealt = docs.withColumn("shard", shard_column(F.col("id"), shards)).repartitionById(shards, F.col("shard"))
    found = dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_locate(k), RESULT)
    return found.withColumn("id", F.when(F.col("id") < NULLS, F.col("id")))


def op6_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(c.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP6_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{c.WORD}') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
o AS (SELECT g, min(doc_id) AS owner FROM g GROUP BY g),
x AS (SELECT DISTINCT rid, i + j AS p FROM g JOIN o USING (g), (SELECT unnest(range(0, 13)) AS j) WHERE owner < doc_id),
p AS (SELECT rid, doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM p ANTI JOIN x USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
"""
