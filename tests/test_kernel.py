"""Golden values and round trips of the sequential codecs."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helicase.functions import kernel as k

STRAND = st.text("ACGT", max_size=300)


def test_generator():
    r = k.Ranlux(3, 0)
    assert [round(r.raw(), 8) for _ in range(5)] == [0.53981817, 0.76155043, 0.0602994, 0.79600263, 0.3063122]


def test_permutation():
    assert k.strand_seed("ACGTACGTAA") == 32
    assert k.swaps(32, 10) == ((9, 2), (8, 1), (7, 3), (6, 5), (5, 5), (4, 4), (3, 3), (2, 0), (1, 1))
    assert k.permute("ACGTACGTAA", 32) == "AAATAGCTCG"


@pytest.mark.parametrize(
    ("n", "kind", "want"),
    [
        (5, "HALF_BYTE", "ACA"),
        (0, "SHORT", "TAATTCGAG"),
        (2, "SHORT", "TAATTCGAC"),
        (7, "INT_64", "GTAATTCGAGGTGCTACCAATTCGAGGTGCTATC"),
        (-1, "INT_64", "GTGCAGATCCGTTAACTGGCAGATCCGTTAACTG"),
    ],
)
def test_pack(n, kind, want):
    assert k.pack(n, kind) == want
    assert k.unpack(want, signed=n < 0)[0] == n


def test_hash_and_rotation():
    assert k.sig_hash([1, 2, 3, 4, 5]) == 816162537024425613
    assert k.sig_hash([]) == 5230414047343518
    assert k.rotate3_encode("012012") == "CTGTCA"
    assert k.rotate3_encode("000000") == "CGTACG"


@pytest.mark.parametrize("base", [2, 3, 4])
def test_huffman_is_a_prefix_code(base):
    codes = sorted(k.huffman(base))
    assert len(set(codes)) == 256
    assert not any(b.startswith(a) for a, b in zip(codes, codes[1:], strict=False))
    assert sum(base ** -len(c) for c in codes) <= 1 + 1e-9


@settings(deadline=None, max_examples=40)
@given(st.text(max_size=80), st.sampled_from(k.CODECS))
def test_text_round_trip(text, codec):
    text = text.encode("utf-8", "ignore").decode()
    assert k.text_decode(k.text_encode(text, codec), codec) == text


@settings(deadline=None, max_examples=40)
@given(STRAND)
def test_strand_round_trips(s):
    assert k.unpad(k.pad(s, 120)) == s
    assert k.undo_permutation(k.best_permutation(s, 6)) == s
    assert k.ecc_decode(k.ecc_encode(s, 4), 4) == s
    assert "".join(k.unpad(x, k.SEGMENT_DELIMITER) for x in k.segments(s, 60, 6)) == s


@settings(deadline=None, max_examples=30)
@given(st.binary(min_size=1, max_size=100), st.data())
def test_two_wrong_bytes_are_corrected(data, draw):
    code = bytearray(k.rs_encode(data, 4))
    for _ in range(2):
        code[draw.draw(st.integers(0, len(code) - 1))] ^= draw.draw(st.integers(1, 255))
    assert k.rs_decode(bytes(code), 4) == data


def test_base3_never_repeats():
    s = k.text_encode("any text at all, 123", "rotating3")
    assert k.longest_run(s) == 1


def test_fountain_strands_respect_the_run_limit():
    assert k.longest_run(k.fountain_encode(b"hello world " * 20)[20:]) <= 2 * 6


def test_unpack_all_stops():
    s = "".join(k.pack(n, k.packed_type(n)) for n in (1, 300, 70000))
    assert k.unpack_all(s + "GC") == [1, 300, 70000]


def test_error_of_runs():
    assert k.strand_error("AC" * 10) < k.strand_error("A" * 10 + "C" * 10)
    assert math.isclose(1 - 1 / (1 + math.exp(7 - 6)), 0.731058598, abs_tol=1e-7)
