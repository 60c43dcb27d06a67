"""N-gram Jaccard join by vertical partitioning: connected classes of near-duplicate documents, exact.

A document is the set of its distinct 5-word shingles; two documents link when their Jaccard similarity reaches the
threshold. Equal sets are one class and never paired. The global order of the n-grams is cut into fragments:

1. Every class sends each fragment its n-grams there. A fragment counts, by class, the n-grams that another class has
   too; summed per class, these partial counts bound any overlap, and a class whose bound is below the threshold links
   with nothing. This removes most of a corpus with one exchange of 4 bytes an n-gram.
2. The classes left go through fragments once more, which return how common each n-gram is. Ordered from rare to
   common, a class's first n // 5 + 1 n-grams (at 0.8) hold one of every partner's: the prefix index.
3. Classes with a prefix n-gram in common are candidates. A pair's overlap is counted in each fragment by itself and
   summed per pair. Instead of all pairs of an n-gram's bucket, a round pairs each class outside the bucket's largest
   component with the leader inside it, in a few of the class's buckets. Leaders are the classes of the most common
   n-grams, the centre of their kind. Links merge components, other leaders follow.
   When few pairs across components are left, or rounds no longer help, all of these are counted, each once: no link
   between components is lost, and components don't need the pairs inside them.
4. The number of a class's links does (``links=True``): a component's classes are dealt out to blocks, every two blocks
   meet once, and each meeting counts all overlaps of its classes exactly. It gives one number a class, so what grows
   with a component's square is arithmetic, and what is exchanged by that square over the size of a block.

Otherwise only step 3's last part can grow with the square of a bucket, and only by members that are alike in rare
n-grams, bear no link by any leader and lie in different components. There are no caps.

Defined cases: null or empty text: no shingles, links with nothing, component is its own id. Fewer words than five:
the whole sequence is the one shingle. Equal rows are one class. A null id takes part and gets the smallest other id
of its component, null if there is none. Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helicase.llm import _common as c
from helicase.llm import _windows as win
from helicase.llm.components import connect

#: Fragments of the n-gram order in which the overlaps of pairs are counted.
PAIR_FRAGMENTS = 8
ROUNDS = 8
#: Pairs across components are all counted once they are so many for each row of the open buckets, or fewer.
PAIRS_A_ROW = 8
#: Bytes of input for each fragment of the first exchange.
FRAGMENT_BYTES = 16 << 20
#: A block of a component's classes has about so many n-grams and so many classes at most.
BLOCK_GRAMS, BLOCK_CLASSES = 1 << 18, 1024
#: N-grams whose overlaps are counted at once, in a matrix of so many columns.
COLUMNS = 2048


def shingle_sets(texts: list[bytes], k: int, known: win.WordHashes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = [t.lower().split() for t in texts]  # bytes: A-Z and ASCII white space
    every = win.windows(win.of_words([w for ws in words for w in ws], known), k)
    out, at = [], 0
    for ws in words:
        if len(ws) >= k:
            out.append(np.unique(every[at : at + len(ws) - k + 1]))
        elif ws:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(ws), seed=k)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += len(ws)
    return out


def _sets(k: int, tables: Iterable[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = win.WordHashes()
    for b in win.batches(tables, text):
        yield b, shingle_sets(win.texts(b.column(text)), k, known)


def _key(shingles: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else None


def _describe(k: int) -> Callable:
    def run(tables):
        for b, sets in _sets(k, tables, 1):
            yield pa.record_batch([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_key(s) for s in sets], pa.int64())], names=["id", "n", "key"])

    return run


def _to_fragments(k: int, fragments: int, width: int, text: int) -> Callable:
    def parts(tables):
        for _, sets in _sets(k, tables, text):
            by_key = {key: s for s in sets if (key := _key(s)) is not None}
            if by_key:
                yield np.concatenate(list(by_key.values())), np.fromiter(by_key, np.int64, len(by_key)), np.fromiter(map(len, by_key.values()), np.int64, len(by_key))

    first = win.levels(fragments)[0]
    return lambda tables: win.packed(parts(tables), fragments, width, first)


def _classes(ids: np.ndarray, counts: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each class once: keys, the class of each hash, the hashes."""
    _, first = np.unique(ids, return_index=True)
    once = np.zeros(len(ids), bool)
    once[first] = True
    h = h[np.repeat(once, counts)]
    ids, counts = ids[once], counts[once]
    return ids, np.repeat(np.arange(len(ids)), counts), h


def _shared(width: int, shards: int) -> Callable:
    """Partial counts: of each class in a fragment, the n-grams that another class has too; packed by shard of classes,
    with the counts in the documents' place and the classes' keys in the hashes'."""

    def parts(tables):
        for _, ids, counts, h in win.unpack(tables, width):
            keys, of, h = _classes(ids, counts, h)
            order = np.argsort(h)
            same = h[order][1:] == h[order][:-1]
            both = np.zeros(len(h), bool)
            both[1:] |= same
            both[:-1] |= same
            n = np.bincount(of[order[both]], minlength=len(keys))
            there = np.flatnonzero(n)
            there = there[np.argsort(n[there], kind="stable")]
            values, many = np.unique(n[there], return_counts=True)
            yield keys[there].view(np.uint64), values, many

    first = win.levels(shards)[0]
    return lambda tables: win.packed(parts(tables), shards, 8, first)


def _summed(tables: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, shared): partial counts summed by class."""
    for _, values, many, keys in win.unpack(tables, 8):
        keys, of = np.unique(keys.view(np.int64), return_inverse=True)
        n = np.bincount(of, np.repeat(values, many), len(keys)).astype(np.int64)
        yield pa.record_batch([pa.array(keys), pa.array(n)], names=["key", "shared"])


def _commonness(width: int) -> Callable:
    """Each class's n-grams in a fragment with the logarithm of the number of classes that have them."""

    def run(tables):
        for _, ids, counts, h in win.unpack(tables, width):
            keys, of, h = _classes(ids, counts, h)
            _, where, n = np.unique(h, return_inverse=True, return_counts=True)
            common = np.log2(n).astype(np.int32)[where]
            common[n[where] > 1] += 1
            ends = np.cumsum(np.bincount(of, minlength=len(keys))).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.record_batch(
                [pa.array(keys), pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(common))],
                names=["key", "grams", "common"],
            )

    return run


def _overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """Pairs (a, b) with the n-grams they share: counted by fragment, summed per pair."""
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("grams").alias("gb"))
    part = pairs.join(left, "a").join(right, ["b", "fragment"])
    part = part.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("part"))
    return part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))


def _overlap_matrix(keys: np.ndarray, key: np.ndarray, h: np.ndarray, others: np.ndarray, other: np.ndarray, g: np.ndarray) -> np.ndarray:
    """N-grams that each of keys shares with each of others. (key, h) and (other, g): the n-grams of each, as positions and hashes."""
    both = np.zeros((len(keys), len(others)), np.int64)
    shared = np.intersect1d(h, g)  # sorted, distinct
    at, to = np.searchsorted(shared, h), np.searchsorted(shared, g)
    a, b = at < len(shared), to < len(shared)
    a[a] &= shared[at[a]] == h[a]
    b[b] &= shared[to[b]] == g[b]
    at, key, to, other = at[a], key[a], to[b], other[b]
    i, j = np.argsort(at, kind="stable"), np.argsort(to, kind="stable")
    at, key, to, other = at[i], key[i], to[j], other[j]
    for lo in range(0, len(shared), COLUMNS):
        x, y = np.zeros((len(keys), COLUMNS), np.float32), np.zeros((len(others), COLUMNS), np.float32)
        p, q = slice(*np.searchsorted(at, [lo, lo + COLUMNS])), slice(*np.searchsorted(to, [lo, lo + COLUMNS]))
        x[key[p], at[p] - lo] = 1
        y[other[q], to[q] - lo] = 1
        both += (x @ y.T).astype(np.int64)
    return both


def _block_links(percent: int) -> Callable:
    """(key, n_links) of two blocks' meeting: links between their classes, or inside the one block that meets itself."""

    def run(table: pa.Table) -> pa.Table:
        side, row_key = table["side"].to_numpy(), table["key"].to_numpy()
        grams = table["grams"].combine_chunks()
        h = grams.flatten().to_numpy(zero_copy_only=False)
        long_key = np.repeat(row_key, grams.value_lengths().to_numpy(zero_copy_only=False))
        long_side = np.repeat(side, grams.value_lengths().to_numpy(zero_copy_only=False))
        found = []
        for s in (0, 1):
            mine = long_side == s
            keys, of = np.unique(long_key[mine], return_inverse=True)
            found.append((keys, of, h[mine]))
        left, right = found
        alone = not len(right[0])
        if alone:
            right = left
        both = _overlap_matrix(*left, *right)
        n, m = np.bincount(left[1], minlength=len(left[0])), np.bincount(right[1], minlength=len(right[0]))
        linked = both * 100 >= (n[:, None] + m[None, :] - both) * percent
        if alone:
            np.fill_diagonal(linked, False)
            keys, links = left[0], linked.sum(1)
        else:
            keys, links = np.concatenate([left[0], right[0]]), np.concatenate([linked.sum(1), linked.sum(0)])
        return pa.table({"key": pa.array(keys, pa.int64()), "n_links": pa.array(links.astype(np.int64))})

    return run


def _link_counts(nodes: DataFrame, cuts: DataFrame, percent: int, parts: int) -> DataFrame:
    """(key, n_links): exact numbers of links. nodes (key, label); cuts (key, fragment, grams)."""
    sizes = cuts.groupBy("key").agg(F.sum(F.size("grams")).alias("n"))
    groups = nodes.join(sizes, "key").groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("n")).where("m > 1")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_GRAMS), F.ceil(F.col("m") / BLOCK_CLASSES)).cast("int")
    members = nodes.join(groups.select("label", blocks.alias("blocks")), "label")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    meet = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"), (F.col("block") > o).cast("int").alias("side")),
    )
    rows = members.select("key", "label", F.explode(meet).alias("x")).select("key", "label", "x.i", "x.j", "x.side")
    rows = rows.join(cuts.select("key", "grams"), "key").repartition(parts, "label", "i", "j")
    counted = rows.groupBy("label", "i", "j").applyInArrow(_block_links(percent), "key long, n_links long")
    return counted.groupBy("key").agg(F.sum("n_links").alias("n_links"))


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, class_key) for every row of df; with links also n_links: the other sets that its set links with.
    Ids are longs, or structs of longs."""
    name = F.col(f"`{id_col}`")
    name = name if isinstance(df.select(name).schema[0].dataType, StructType) else name.cast("long")
    docs = c.ship(df).select(name.alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    fragments = win.at_least(-(-c.scan_bytes(df) // FRAGMENT_BYTES))
    parts = c.fan_out(df)

    described = c.checkpoint(docs.mapInArrow(_describe(k), f"id {kind}, n long, key long"))
    classes = described.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    packed = docs.select("text").mapInArrow(_to_fragments(k, fragments, 4, 0), win.PACKED)
    shards = win.at_least(-(-c.scan_bytes(df) // FRAGMENT_BYTES))
    partial = win.exchange(packed, fragments, 4).mapInArrow(_shared(4, shards), win.PACKED)
    shared = win.exchange(partial, shards, 8).mapInArrow(_summed, "key long, shared long")
    live = classes.join(shared, "key").where(F.col("shared") * 100 >= F.col("n") * percent).select("key", "rep", "n")
    live = c.checkpoint(live)
    grams = live.agg(F.sum("n")).first()[0] or 0
    fragments = win.at_least(-(-grams * 8 // FRAGMENT_BYTES))

    again = docs.join(live.where("rep IS NOT NULL").select(F.col("rep").alias("id")).distinct().hint("shuffle_hash"), "id", "left_semi")
    again = again.unionByName(docs.where("id IS NULL"))
    packed = again.select("text").mapInArrow(_to_fragments(k, fragments, 8, 0), win.PACKED)
    segments = win.exchange(packed, fragments, 8).mapInArrow(_commonness(8), "key long, grams array<long>, common array<int>")
    ordered = F.sort_array(F.flatten(F.collect_list(F.arrays_zip("common", "grams"))))
    sets = segments.join(live.select("key"), "key", "left_semi").groupBy("key").agg(ordered.alias("grams"))
    first = F.slice("grams", 1, F.floor(F.size("grams") * (100 - percent) / 100).cast("int") + 1)
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(PAIR_FRAGMENTS - 1)), lambda f: F.struct(f.alias("fragment"), F.filter("grams", lambda g: F.pmod(F.shiftrightunsigned(g, 61), F.lit(PAIR_FRAGMENTS)) == f).alias("grams"))))
    sets = sets.select(
        "key",
        F.size("grams").cast("long").alias("n"),
        (F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + g["common"]) / F.size("grams")).alias("central"),
        F.size(F.filter("grams", lambda g: g["common"] == 0)).alias("own"),
        F.transform("grams", lambda g: g["grams"]).alias("grams"),
        F.transform(F.filter(first, lambda g: g["common"] > 0), lambda g: g["grams"]).alias("prefix"),
    )
    #: a row for each class and fragment; the first one also has the class's prefix
    cuts = sets.select("key", "n", "central", "own", "prefix", cut.alias("s")).select("key", "n", "central", "own", F.when(F.col("s.fragment") == 0, F.col("prefix")).alias("prefix"), "s.fragment", "s.grams")
    cuts = c.checkpoint(cuts)
    sets = cuts.where("fragment = 0").select("key", "n", "central", "own", "prefix")
    index = sets.select("key", "n", "central", "own", F.posexplode("prefix").alias("at", "gram"))
    index = c.checkpoint(index.select("key", "n", "central", "gram", (F.col("n") - F.col("own") - F.col("at")).alias("rest")))
    cuts = cuts.where(F.size("grams") > 0).select("key", "fragment", "grams")

    nodes = c.checkpoint(sets.select("key", F.col("key").alias("label")))
    tried: DataFrame | None = None

    def fits(n, m, n_rest, m_rest):
        """Of the n-grams from a common one on, enough for the overlap; true for the first one that a linked pair has in common."""
        return F.least(n_rest, m_rest) * (100 + percent) >= (n + m) * percent

    left_before = None
    labelled = index.withColumn("label", F.col("key"))
    for r in range(ROUNDS + 1):
        groups = labelled.groupBy("gram", "label").agg(F.count("*").alias("m"), F.max(F.struct("central", "key")).alias("top"))
        buckets = groups.groupBy("gram").agg(
            F.sum("m").alias("all"),
            F.sum(F.col("m") * F.col("m")).alias("inside"),
            F.max_by("label", F.struct("m", "top")).alias("largest"),
            F.count("*").alias("labels"),
        ).where("labels > 1")
        buckets = c.checkpoint(buckets)
        left = buckets.agg(F.sum((F.col("all") * F.col("all") - F.col("inside")) / 2).alias("pairs"), F.sum("all").alias("rows")).first()
        if not left["pairs"]:
            break
        last = left["pairs"] <= PAIRS_A_ROW * left["rows"] or r == ROUNDS or (left_before is not None and left["pairs"] > 0.98 * left_before)
        left_before = left["pairs"]
        # Written, so that nothing above the join needs an n-gram's rows together and a hot one's can be split; and labels
        # only merge, so a closed bucket stays closed.
        open_ = c.checkpoint(labelled.join(buckets.select("gram", "largest", "all"), "gram"))
        if last:
            small = open_.where("label <> largest").select("gram", F.col("key").alias("p"), F.col("label").alias("lp"), F.col("n").alias("np"), F.col("rest").alias("rp"))
            other = open_.select("gram", F.col("key").alias("q"), F.col("label").alias("lq"), F.col("n").alias("nq"), F.col("rest").alias("rq"))
            pairs = small.join(other, "gram").where((F.col("lp") != F.col("lq")) & fits(F.col("np"), F.col("nq"), F.col("rp"), F.col("rq")))
        else:
            turn = F.xxhash64("key", F.lit(r)) % (2 if r else 1) == 0
            leader = open_.where("label = largest").groupBy("gram").agg(F.max_by(F.struct("key", "n", "rest"), F.struct(turn, "central", "key")).alias("l"))
            leader = c.checkpoint(leader)  # as above: the join with a hot n-gram's classes can be split
            outside = open_.where("label <> largest").groupBy("key", "n")
            picked = outside.agg(F.array_distinct(F.array(F.max_by("gram", F.struct("all", "gram")), *[F.max_by("gram", F.struct(F.xxhash64("gram", F.lit(r * 4 + i)), "gram")) for i in range(3)])).alias("grams"))
            picked = picked.select("key", "n", F.explode("grams").alias("gram"))
            pairs = picked.join(leader, "gram").where(fits(F.col("n"), F.col("l.n"), F.col("l.rest"), F.col("l.rest")))
            pairs = pairs.select(F.col("key").alias("p"), F.col("n").alias("np"), F.col("l.key").alias("q"), F.col("l.n").alias("nq"))
        swap = F.col("p") > F.col("q")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        pairs = pairs.select(pick("p", "q").alias("a"), pick("q", "p").alias("b"), pick("np", "nq").alias("na"), pick("nq", "np").alias("nb")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = c.checkpoint(pairs)
        counted = _overlaps(pairs, cuts)
        linked = c.checkpoint(counted.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b"))
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        if not linked.isEmpty():
            nodes = connect(nodes, linked)
        if last:
            break
        labelled = c.checkpoint(open_.drop("label", "largest", "all").join(nodes, "key"))

    named = classes.join(nodes, "key", "left").select("key", "rep", F.coalesce("label", "key").alias("label"))
    smallest = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_class = named.join(smallest, "label").select("key", "component_id")
    count = []
    if links:
        by_class = by_class.join(c.checkpoint(_link_counts(nodes, cuts, percent, parts)), "key", "left")
        count = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    out = described.join(by_class, "key", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("key").alias("class_key"), *count)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row of df for each component: that of the smallest id, ids that are missing last; of several rows with it, one.
    Rows without words are linked with nothing and stay. A column ``__row`` is replaced."""
    rows = c.checkpoint(df.withColumn("__row", F.monotonically_increasing_id()))  # written, so that numbers stay as they are
    last = F.lit((1 << 63) - 1)
    named = rows.select(F.struct(F.coalesce(F.col(f"`{id_col}`").cast("long"), last).alias("id"), F.col("__row").alias("row")).alias("id"), F.col(f"`{text_col}`").alias("text"))
    gone = jaccard_classes(named, "id", "text", k, percent).where("component_id <> id").select(F.col("id.row").alias("__row"))
    return rows.join(gone, "__row", "left_anti").drop("__row")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(c.table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 with each document's class and the number of other classes that it links with."""
    return jaccard_classes(c.table(spark, sf_dir, "documents"), links=True).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_key", "n_links")


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
      UNION SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS start, doc_id AS node FROM n UNION SELECT start, b FROM r JOIN l ON node = a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(node) FROM r WHERE start = w.doc_id), w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)
"""
