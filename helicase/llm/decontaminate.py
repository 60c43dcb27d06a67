"""Benchmark decontamination: an FM-index per shard of documents, test phrases by backward search, removal spans.

A shard is a slice of a partition with about BATCH_BYTES of text. Its alphabet are the words of the benchmark; a word
outside of it ends any phrase, so only runs of benchmark words as long as the shortest window enter the index, each
closed by a mark that no phrase has. All windows of a block of the benchmark are searched at once, located by sampled
suffix positions, and their spans merged per document. Documents don't move: there is no exchange.

The benchmark comes to the driver as an iterator of rows and goes to the executors in blocks of at most
``BLOCK_WORDS`` words; each block is one broadcast of that bound and one pass over the documents as they stream
through, so a large benchmark means more passes in the same stage, not a larger broadcast.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items with equal
windows are all reported; a null item id is reported as an empty id; an empty benchmark hits nothing; repeated rows
get equal results; other columns stay, except those named like the output columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c
from helicase.llm import _windows as win
from helicase.llm.fm_index import FMIndex

BLOCK_WORDS = 1 << 20
FOUND = "array<struct<start:int,end:int>>"
#: Bytes of words stay, A-Z become a-z, all others part words: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
PARTS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PARTS).split()


class Phrases:
    """Windows of a block of items as right-aligned rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], k: int) -> None:
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        self.items = [name for name, _ in items]
        for at, (_, words) in enumerate(items):
            seq = tuple(self.numbers.setdefault(w, len(self.numbers) + 2) for w in words)  # 0: end of text, 1: a break
            for i in range(max(1, len(seq) - k + 1) if seq else 0):
                found.setdefault(seq[i : i + k], set()).add(at)
        self.owners = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.rows = np.zeros((len(found), k), np.int64)
        for row, x in zip(self.rows, found, strict=True):
            row[k - len(x) :] = x
        self.shortest = int(self.lengths.min()) if len(found) else 0


def blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> Iterator[Phrases]:
    """The benchmark's phrases, so many words at a time."""
    held, n = [], 0
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`"))
    for name, text in rows.toLocalIterator():
        words = words_of((text or "").encode())
        if held and n + len(words) > BLOCK_WORDS:
            yield Phrases(held, k)
            held, n = [], 0
        held.append((name or "", words))
        n += len(words)
    if held:
        yield Phrases(held, k)


def _kept_runs(numbers: np.ndarray, ends: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The index's text and, for each of its symbols, the word's position in the shard (-1 at breaks)."""
    known = numbers > 0
    edge = np.zeros(len(numbers) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = known[1:] != known[:-1]
    edge[ends] = True
    cuts = np.flatnonzero(edge)
    start, stop = cuts[:-1], cuts[1:]
    keep = (stop - start >= shortest) & known[start] if len(start) else np.empty(0, bool)
    start, size = start[keep], (stop - start)[keep]
    total = int(size.sum()) + len(size)
    at = np.repeat(start - np.concatenate([[0], np.cumsum(size + 1)[:-1]]), size + 1) + np.arange(total) if len(size) else np.empty(0, np.int64)
    last = np.cumsum(size + 1) - 1
    at[last] = -1
    text = np.where(at >= 0, numbers[at], 1)
    return text, at


def find(texts: list[list[bytes]], p: Phrases) -> tuple[np.ndarray, list[set[int]]]:
    """Which words of the shard, its documents' words in a row, are hit; the items found in each document."""
    sizes = np.array([len(ws) for ws in texts], np.int64)
    ends = np.cumsum(sizes)
    hit, items = np.zeros(int(ends[-1]) if len(ends) else 0, bool), [set() for _ in texts]
    if not len(p.rows) or not len(hit):
        return hit, items
    get = p.numbers.get
    numbers = np.fromiter((get(w, 0) for ws in texts for w in ws), np.int64, len(hit))
    text, at = _kept_runs(numbers, ends, p.shortest)
    if not len(text):
        return hit, items
    index = FMIndex(text, len(p.numbers) + 1)
    low, high = index.search(p.rows, p.lengths)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(which))
    start = at[index.locate(rows)]
    depth = np.zeros(len(hit) + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + p.lengths[which], -1)
    hit = np.cumsum(depth[:-1]) > 0
    doc = np.searchsorted(ends, start, "right")
    for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist() if len(doc) else []:
        items[d].update(p.owners[w])
    return hit, items


RUN = re.compile(rb"[0-9a-z\x80-\xff]+")


def without(text: bytes, spans: list[dict]) -> bytes:
    """text without the words of the spans and what stands between them."""
    if not spans:
        return text
    at = [m.span() for m in RUN.finditer(text.translate(PARTS))]
    out, start = [], 0
    for s in spans:
        out.append(text[start : at[s["start"]][0]])
        start = at[s["end"] - 1][1]
    return b"".join([*out, text[start:]])


def _pass(shared, columns: int, text: int, then: str) -> Callable:
    """One block over the documents; adds to the spans and items that earlier blocks found. then: keep, drop or clean the text."""

    def run(tables):
        p = shared.value
        for b in win.batches(tables, text):
            texts = [words_of(t) for t in win.texts(b.column(text))]
            hit, items = find(texts, p)
            spans, names, at = [], [], 0
            before_s, before_i = b.column(columns + 1).to_pylist(), b.column(columns + 2).to_pylist()
            for ws, found, s, i in zip(texts, items, before_s, before_i, strict=True):
                mine = hit[at : at + len(ws)].copy()
                at += len(ws)
                for x in s:
                    mine[x["start"] : x["end"]] = True
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8))).tolist() if s or mine.any() else []
                spans.append([{"start": u, "end": v} for u, v in zip(edge[::2], edge[1::2], strict=True)])
                names.append(sorted({*i, *(p.items[x] for x in found)}) if found else i)
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            new = [pa.array([len(ws) for ws in texts], pa.int64()), pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
            old = list(b.columns[:columns])
            if then == "drop":
                old[text] = pa.nulls(b.num_rows, old[text].type)
            elif then == "clean":
                raw = old[text].cast(pa.binary()).to_pylist()
                old[text] = pa.array([t if t is None else without(t, s) for t, s in zip(raw, spans, strict=True)], pa.binary()).cast(old[text].type)
            yield pa.record_batch([*old, *new], names=b.schema.names)

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, then: str = "keep"
) -> DataFrame:
    """docs with n_words, spans (words inside occurrences, [start, end)) and items (ids, as strings, sorted).

    then: "keep" leaves the text, "clean" cuts the spans out of it, "drop" makes it null, which saves its way back.
    """
    out = ("n_words", "spans", "items")
    keep = [x for x in docs.columns if x not in out]
    if text_col not in keep:
        raise ValueError(f"{text_col!r} is no column of the documents, or named like an output column")
    inner = [f"__d{i}" for i in range(len(keep))]
    d = c.ship(docs).select(
        *[F.col(f"`{x}`").alias(y) for x, y in zip(keep, inner, strict=True)],
        F.lit(0).cast("long").alias("n_words"),
        F.array().cast(FOUND).alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    sc = docs.sparkSession.sparkContext
    passes = [sc.broadcast(p) for p in blocks(benchmark, item_col, item_text_col, k)] or [sc.broadcast(Phrases([], k))]
    for i, shared in enumerate(passes):
        last = i == len(passes) - 1
        d = d.mapInArrow(_pass(shared, len(keep), keep.index(text_col), then if last else "keep"), d.schema)
    return d.select(*[F.col(y).alias(x) for x, y in zip(keep, inner, strict=True)], *out)


def words_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = find_contamination(docs, c.table(spark, sf_dir, "benchmark"), then="drop")
    return d.select(
        "doc_id", "n_words", words_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH up AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, up),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, up),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT rid, dw.k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
n AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, i + j AS p FROM h, (SELECT unnest(range(0, 10)) AS j) WHERE j < k) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""
