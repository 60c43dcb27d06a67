"""Token counts of a byte-level BPE by finite-state transducers, without tokenizing.

Two transducers are compiled from the tokenizer's file:

* ``Boundaries``: a deterministic automaton over character classes that marks where the pre-tokenizer starts a new
  piece. The texts of a batch are laid end to end and cut into chunks; each chunk's state map (from every start state to
  the state it ends in) is computed for all chunks at once, the maps compose by a parallel prefix scan, and with its
  start state known each chunk replays once to emit its marks.
* ``Pieces``: a transducer over bytes for one piece, whose transitions carry the number of tokens they add. Its states
  are compiled when first met: a state holds the positions from which a vocabulary entry could still reach on, each
  with its vocabulary trie node, the last token before it and the count up to it. A token may follow another only if
  BPE leaves the two apart when given both, and exactly one token that ends at a position satisfies this; so the last
  token and the count of every prefix are determined, and the transitions need no second look at the piece.

A piece's sum over its transitions is remembered, so a repeated piece is one step from start to start. Both memories
are bounded and dropped when full.

Defined cases: null counts as the empty text, 0 tokens. Special strings inside texts are single tokens, as is the
library's default; no begin or end tokens are added. Repeated rows get equal counts. Other columns stay, except those
named like the output columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helicase.llm import _common as c
from helicase.llm import _windows as win

#: Characters of the automaton's alphabet.
LETTER, NUMBER, OTHER, QUOTE, SPACE, BLANK, ENDS, R_OR_V, L, E, BREAK = range(11)
CLASSES = 11
#: States: start, in letters, numbers, others; after a quote that could open a contraction; after 'r or 'v; after 'l;
#: after a contraction; one space, one other blank, more blanks ending in a space, more ending in another.
START, IN_L, IN_N, IN_O, QUOTED, WANT_E, WANT_L, DONE, ONE_S, ONE_B, MANY_S, MANY_B = range(12)
STATES = 12
#: Marks: a piece starts at this character; one starts at the character before.
HERE, BEFORE = 1, 2
CHUNK = 256


def compile_boundaries() -> tuple[np.ndarray, np.ndarray]:
    """next[class, state] and marks[class, state] of
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
    nxt, marks = np.zeros((CLASSES, STATES), np.uint8), np.zeros((CLASSES, STATES), np.uint8)
    run = {LETTER: IN_L, ENDS: IN_L, R_OR_V: IN_L, L: IN_L, E: IN_L, NUMBER: IN_N, OTHER: IN_O, QUOTE: QUOTED}
    for cls in range(CLASSES):
        for state in range(STATES):
            to, mark = run.get(cls, START), HERE
            after_space = state in (ONE_S, MANY_S)
            if cls in (SPACE, BLANK):
                to = ONE_S if cls == SPACE else ONE_B
                if state in (ONE_S, ONE_B, MANY_S, MANY_B):
                    to, mark = (MANY_S if cls == SPACE else MANY_B), 0
            elif cls == BREAK:
                to = START
            else:
                if after_space and cls == QUOTE:
                    to = IN_O
                if to == state or (state == IN_O and cls == QUOTE) or (state == QUOTED and to in (IN_O, QUOTED)):
                    to, mark = (IN_O if to == QUOTED else to), 0
                if after_space:
                    mark = 0
                if state in (MANY_S, MANY_B):
                    mark |= BEFORE
                if state == QUOTED and cls in (ENDS, R_OR_V, L):
                    to, mark = {ENDS: DONE, R_OR_V: WANT_E, L: WANT_L}[cls], 0
                if (state == WANT_E and cls == E) or (state == WANT_L and cls == L):
                    to, mark = DONE, 0
            if state in (WANT_E, WANT_L) and to != DONE:  # no contraction: the letter starts a piece of its own
                mark = BEFORE | (0 if to == IN_L else HERE)
            nxt[cls, state], marks[cls, state] = to, mark
    return nxt, marks


def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, cls in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        for m in regex.finditer(pattern, every):
            first, last = ord(m.group()[0]), ord(m.group()[-1])
            table[first : last + 1] = cls
            if first < 0xD800 and last >= 0xE000:
                table[0xD800:0xE000] = OTHER
    for chars, cls in (("'", QUOTE), (" ", SPACE), ("stmd", ENDS), ("rv", R_OR_V), ("l", L), ("e", E)):
        table[[ord(x) for x in chars]] = cls
    return table


class Boundaries:
    def __init__(self) -> None:
        self.next, self.marks = compile_boundaries()
        self.classes = class_table()

    def scan(self, classes: np.ndarray) -> np.ndarray:
        """Where pieces start, for all characters; the automaton starts in START."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, BREAK, np.uint8)
        grid[:n] = classes
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        flat = self.next.reshape(-1)
        maps = np.tile(np.arange(STATES, dtype=np.uint16), (chunks, 1))
        for row in grid:
            maps = flat[row[:, None].astype(np.uint16) * STATES + maps].astype(np.uint16)
        step = 1
        while step < chunks:  # prefix scan: maps[i] becomes the composition of all maps up to i
            later = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
            maps = np.concatenate([maps[:step], later])
            step *= 2
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.uint16)
        flat_marks = self.marks.reshape(-1)
        out = np.empty_like(grid)
        for i, row in enumerate(grid):
            at = row.astype(np.uint16) * STATES + state
            out[i] = flat_marks[at]
            state = flat[at].astype(np.uint16)
        mark = out.T.reshape(-1)[:n]
        starts = (mark & HERE).astype(bool)
        starts[:-1] |= (mark[1:] & BEFORE).astype(bool)
        return starts


class Pieces:
    """The BPE transducer over one piece's bytes."""

    MOST_STATES = 1 << 18
    MOST_PIECES = 1 << 19

    def __init__(self, vocabulary: dict[bytes, int], ranks: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.ranks, self.ids = ranks, vocabulary
        self.text = {i: b for b, i in vocabulary.items()}
        self.child: dict[tuple[int, int], int] = {}
        self.token: dict[int, int] = {}
        nodes = 1
        for word, i in vocabulary.items():
            node = 0
            for byte in word:
                if (node, byte) not in self.child:
                    self.child[node, byte] = nodes
                    nodes += 1
                node = self.child[node, byte]
            self.token[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.go: dict[int, tuple[int, int]] = {}

    def encode(self, text: bytes) -> list[int]:
        """Plain BPE: the lowest-ranked neighbours merge, the leftmost first. For pairs of tokens only."""
        seq = [self.ids[bytes([b])] for b in text]
        while len(seq) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            seq[i : i + 2] = [self.ranks[seq[i], seq[i + 1]][1]]
        return seq

    def may_follow(self, last: int, token: int) -> bool:
        if last < 0:
            return True
        known = self.apart.get((last, token))
        if known is None:
            if len(self.apart) >= self.MOST_PIECES:
                self.apart.clear()
            known = self.apart[last, token] = self.encode(self.text[last] + self.text[token]) == [last, token]
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition (next state, tokens added)."""
        reached = [(node, last, n) for at, last, n in self.states[state] if (node := self.child.get((at, byte))) is not None]
        ending = [(self.token[node], n + 1) for node, last, n in reached if node in self.token and self.may_follow(last, self.token[node])]
        (token, added), *more = ending
        if more:
            raise AssertionError(f"tokens {token} and {more} both end a prefix")
        new = tuple((node, last, n - added) for node, last, n in reached) + ((0, token, 0),)
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
        self.go[state << 8 | byte] = out = (number, added)
        return out

    def count(self, piece: str) -> int:
        state = total = 0
        go = self.go
        for byte in piece.encode():
            step = go.get(state << 8 | byte) or self.compile(state, byte)
            state = step[0]
            total += step[1]
        if len(self.states) >= self.MOST_STATES:
            self.reset()
        if len(self.pieces) >= self.MOST_PIECES:
            self.pieces.clear()
        if len(piece) <= 64:
            self.pieces[piece] = total
        return total


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Token counts for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check(spec)
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[x] for x in s)
        self.special = [x["content"] for x in spec["added_tokens"]]
        model = spec["model"]
        vocabulary = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        ranks = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            ranks[vocabulary[raw(a)], vocabulary[raw(b)]] = (rank, vocabulary[raw(a) + raw(b)])
        self.boundaries, self.pieces = Boundaries(), Pieces(vocabulary, ranks)
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        parts, doc, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            pieces = [t]
            if self.splits and any(s in t for s in self.special):
                pieces = self.splits.split(t)
                extra[i] = len(pieces) - 1
            parts += pieces
            doc += [i] * len(pieces)
        if not parts:
            return extra
        every = "\n".join(parts) + "\n"
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes = self.boundaries.classes[np.frombuffer(every.encode("utf-32-le"), np.uint32)]
        classes[ends] = BREAK
        starts = np.flatnonzero(self.boundaries.scan(classes))
        known, count = self.pieces.pieces, self.pieces.count
        cuts = starts.tolist()
        n = np.fromiter(
            (known[p] if (p := every[i:j]) in known else count(p) for i, j in zip(cuts, [*cuts[1:], len(every)], strict=True)), np.int64, len(cuts)
        )
        n[np.searchsorted(starts, ends)] = 0  # a break is a piece of its own
        owner = np.array(doc)[np.searchsorted(ends, starts)]
        return extra + np.bincount(owner, n, len(texts)).astype(np.int64)


def check(spec: dict) -> None:
    """An error where a tokenizer's file asks for what isn't compiled here: anything but byte-level pairs after the usual
    pre-tokenizer, with added tokens that match as they are."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    wanted = [
        ("normalizer", spec.get("normalizer"), None), ("pre_tokenizer", before.get("type"), "ByteLevel"), ("add_prefix_space", before.get("add_prefix_space", False), False),
        ("use_regex", before.get("use_regex", True), True), ("model", model.get("type", "BPE"), "BPE"), ("dropout", model.get("dropout"), None), ("ignore_merges", model.get("ignore_merges") or False, False),
        ("continuing_subword_prefix", model.get("continuing_subword_prefix") or None, None), ("end_of_word_suffix", model.get("end_of_word_suffix") or None, None),
        *[(f"added token's {flag}", bool(t.get(flag)), False) for t in spec["added_tokens"] for flag in ("single_word", "lstrip", "rstrip", "normalized")],
    ]
    if bad := [f"{name}: {has!r}" for name, has, want in wanted if has != want]:
        raise ValueError(f"no transducer for a tokenizer with {', '.join(bad)}")


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This process's compiled tokenizer."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _count(path: str, text: int) -> Callable:
    def run(tables):
        compiled = counter(path)
        for b in win.batches(tables, text):
            found = compiled.counts([x or "" for x in b.column(text).to_pylist()])
            rest = [x for k, x in enumerate(b.columns) if k != text]
            names = [x for k, x in enumerate(b.schema.names) if k != text]
            yield pa.record_batch([*rest, pa.array(found)], names=[*names, "n_tokens"])

    return run


def count_tokens(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """df without the text column, with n_bytes (UTF-8) and n_tokens."""
    keep = [x for x in df.columns if x not in (text_col, "n_bytes", "n_tokens")]
    inner = [f"__t{i}" for i in range(len(keep))]
    text = F.col(f"`{text_col}`")
    d = c.ship(df).select(
        *[F.col(f"`{x}`").alias(y) for x, y in zip(keep, inner, strict=True)],
        F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"),
        text.alias("__text"),
    )
    schema = d.drop("__text").withColumn("n_tokens", F.lit(0).cast("long")).schema
    d = d.mapInArrow(_count(path, len(keep) + 1), schema)
    return d.select(*[F.col(y).alias(x) for x, y in zip(keep, inner, strict=True)], "n_bytes", "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    import public_tokenizers

    docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
    d = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return d.withColumn("over_limit", F.col("n_tokens") > limit)
