"""Scalar functions over base strings (A, C, G, T), as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
#: Two bits a base: 00 A, 01 T, 10 C, 11 G.
TRANSPORT = "ATCG"
RUNS = "(A+|C+|G+|T+)"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def checked(seq) -> Column:
    """seq, or an error where it holds anything but bases."""
    s = _col(seq)
    return F.when(s.rlike("^[ACGT]*$"), s).when(s.isNotNull(), F.raise_error(F.concat(F.lit("not a base string: "), s)).cast("string"))


def is_strand(seq) -> Column:
    return _col(seq).rlike("^[ACGT]*$")


def encode_2bit(text) -> Column:
    """UTF-8 bytes at two bits a base. Nibbles are lower-case hex digits and bases upper case, so plain replacements can't meet."""
    out = F.lower(F.hex(F.encode(_col(text), "UTF-8")))
    for nibble in range(16):
        out = F.replace(out, F.lit(f"{nibble:x}"), F.lit(TRANSPORT[nibble >> 2] + TRANSPORT[nibble & 3]))
    return out


def decode_2bit(seq) -> Column:
    """Inverse of encode_2bit."""
    digits = F.translate(_col(seq), TRANSPORT, "0123")
    bytes_ = F.transform(F.regexp_extract_all(digits, F.lit(".{4}"), F.lit(0)), lambda x: F.lpad(F.conv(x, 4, 16), 2, "0"))
    return F.decode(F.unhex(F.array_join(bytes_, "")), "UTF-8")


def complement(seq) -> Column:
    return F.translate(_col(seq), "ACGT", "TGCA")


def reverse(seq) -> Column:
    return F.reverse(_col(seq))


def reverse_complement(seq) -> Column:
    return reverse(complement(seq))


def join(*seqs) -> Column:
    return F.concat(*[_col(s) for s in seqs])


def insert(seq, index, what) -> Column:
    return F.overlay(_col(seq), _lit(what), _lit(index) + 1, F.lit(0))


def set_base(seq, index, base) -> Column:
    return F.overlay(_col(seq), _lit(base), _lit(index) + 1, F.lit(1))


def base_at(seq, index) -> Column:
    return F.substring(_col(seq), _lit(index) + 1, F.lit(1))


def swap(seq, i, j) -> Column:
    return set_base(set_base(seq, i, base_at(seq, j)), j, base_at(seq, i))


def sub_sequence(seq, i, j) -> Column:
    """Bases from i to before j."""
    return F.substring(_col(seq), _lit(i) + 1, _lit(j) - _lit(i))


window = sub_sequence


def split_every(seq, n: int) -> Column:
    """Parts of n bases, the last one shorter. By a regular expression: a substring counts its characters from the start."""
    return F.regexp_extract_all(_col(seq), F.lit(f".{{1,{n}}}"), F.lit(0))


def replace_first(seq, source, target) -> Column:
    s, x = _col(seq), _lit(source)
    at = F.instr(s, x)
    return F.when(at == 0, s).otherwise(F.overlay(s, _lit(target), at, F.length(x)))


def contains(seq, what) -> Column:
    return _col(seq).contains(_lit(what))


def last_index_of(seq, what) -> Column:
    s, x = _col(seq), _lit(what)
    at = F.instr(F.reverse(s), F.reverse(x))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(s) - F.length(x) - at + 1)


def kmers(seq, k: int) -> Column:
    """All overlapping k-mers with repeats; none where the strand is shorter. Matches of a lookahead move on by one base."""
    return F.regexp_extract_all(_col(seq), F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def base4(seq) -> Column:
    """Rank of a k-mer: A 0, C 1, G 2, T 3, the first base least significant. For up to 31 bases."""
    return F.conv(F.reverse(F.translate(_col(seq), BASES, "0123")), 4, 10).cast("long")


def kmer_codes(seq, k: int) -> Column:
    return F.transform(kmers(seq, k), base4)


def ordinals(seq) -> Column:
    """Bases as digits in transport order."""
    return F.translate(_col(seq), TRANSPORT, "0123")


def count_of(seq, bases: str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.translate(s, bases, ""))


def seed(seq) -> Column:
    """Product of the counts of the bases that occur, wrapped to 32 bits; equal for all permutations."""
    product = F.lit(1).cast("decimal(38,0)")
    wrap = F.lit(1 << 32).cast("decimal(38,0)")
    for b in BASES:
        product = (product * F.greatest(count_of(seq, b), F.lit(1)) % wrap).cast("decimal(28,0)")
    v = product.cast("long")
    return F.when(v >= 1 << 31, v - (1 << 32)).otherwise(v)


def gc_count(seq) -> Column:
    return count_of(seq, "GC")


def gc_content(seq) -> Column:
    """Share of G and C; null for an empty strand."""
    n = F.length(_col(seq))
    return F.when(n > 0, gc_count(seq) / n)


def gc_windows(seq, size) -> Column:
    """GC content of every window of the size."""
    w = _lit(size)
    found = F.regexp_extract_all(_col(seq), F.concat(F.lit("(?=(.{"), w.cast("string"), F.lit("}))")), F.lit(1))
    return F.transform(found, lambda x: gc_count(x) / w)


def histogram(seq) -> Column:
    """Map of the bases that occur to their counts."""
    pairs = F.map_from_arrays(F.array(*[F.lit(b) for b in BASES]), F.array(*[count_of(seq, b) for b in BASES]))
    return F.map_filter(pairs, lambda _, n: n > 0)


def runs(seq) -> Column:
    """Maximal runs of one base, in order."""
    return F.regexp_extract_all(_col(seq), F.lit(RUNS), F.lit(1))


def runs_over(seq, threshold: int) -> Column:
    """Runs longer than the threshold, in order."""
    return F.regexp_extract_all(_col(seq), F.lit("|".join(f"{b}{{{threshold + 1},}}" for b in BASES)), F.lit(0))


def run_lengths(seq) -> Column:
    return F.transform(runs(seq), F.length)


def longest_homopolymer(seq) -> Column:
    """Length of the longest run; 1 for an empty strand."""
    return F.greatest(F.lit(1), F.coalesce(F.array_max(run_lengths(seq)), F.lit(1)))


def homopolymer_at(seq, index) -> Column:
    return F.length(F.regexp_extract(F.substring(_col(seq), _lit(index) + 1, F.length(_col(seq))), f"^{RUNS}", 1))


def long_run_starts(seq, threshold: int) -> Column:
    """Start indexes of runs longer than the threshold."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.when(n > threshold, F.concat(a["out"], F.array(a["at"]))).otherwise(a["out"]).alias("out"))
    return F.aggregate(run_lengths(seq), none, step, lambda a: a["out"])


def count_matches(seq, what: str) -> Column:
    """Greedy matches without overlap; the window at the very end is not tested."""
    s = _col(seq)
    return F.regexp_count(F.substring(s, F.lit(1), F.length(s) - 1), F.lit(what))


def count_consecutive(seq, what: str) -> Column:
    """Most matches in a row; the window at the very end is not tested."""
    s = _col(seq)
    found = F.regexp_extract_all(F.substring(s, F.lit(1), F.length(s) - 1), F.lit(f"((?:{what})+)"), F.lit(1))
    return F.floor(F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0)) / len(what)).cast("int")


def random_strand(length: int, gc: float, seed_: int) -> Column:
    """length bases, each G or C with probability gc, by a seeded generator."""
    picks = [F.when(F.rand(seed_ + 2 * i) < gc, F.when(F.rand(seed_ + 2 * i + 1) < 0.5, "G").otherwise("C")).otherwise(F.when(F.rand(seed_ + 2 * i + 1) < 0.5, "A").otherwise("T")) for i in range(length)]
    return F.concat(*picks)


def split_oligo(oligo, address_size: int) -> Column:
    """An oligo as struct (address, payload)."""
    s = _col(oligo)
    return F.struct(F.substring(s, 1, address_size).alias("address"), F.substring(s, F.lit(address_size + 1), F.length(s)).alias("payload"))
