"""Pure parts of the corpus operators on generated input."""

import gzip
import io

from hypothesis import given, settings
from hypothesis import strategies as st

from chronopanel.llm import decontaminate, packing, pii, repeats, simhash, warc
from tests.llm.test_text_operators import brute_fingerprint, brute_matches, brute_spans

few = settings(max_examples=300, deadline=None)


@few
@given(st.text(alphabet="a@.-+1 4(é9", max_size=60))
def test_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


@few
@given(st.text(alphabet="0123456789 -", min_size=10, max_size=40))
def test_cards_equal_plain_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


@few
@given(st.text(alphabet="aBÀ\t\n \x0b\x1f ", max_size=80))
def test_fingerprints_equal_plain_ones(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


@few
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", min_size=1, max_size=8)), min_size=2, max_size=9), st.integers(3, 8))
def test_interval_tree_finds_the_longest_match_of_each(pairs, length):
    """For each occurrence, what its repeats cover equals what comparing all pairs covers."""
    lefts, rights = [a for a, _ in pairs], [b for _, b in pairs]
    got = [set() for _ in pairs]
    for depth, n, reach in repeats.maximal_repeats(lefts, rights, length):
        assert n > 1
        for x, left in reach:
            got[x] |= set(range(-left, depth))
    want = [set() for _ in pairs]
    for x in range(len(pairs)):
        for y in range(len(pairs)):
            if x != y:
                a, b = repeats.lcp(lefts[x].encode(), lefts[y].encode()), repeats.lcp(rights[x].encode(), rights[y].encode())
                if a + b >= length:
                    want[x] |= set(range(-a, b))
    assert got == want


@few
@given(st.binary(max_size=40), st.binary(max_size=40))
def test_common_prefix(a, b):
    n = repeats.lcp(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@few
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), min_size=1, max_size=12))
def test_bins_hold_every_piece_once_and_never_overflow(histogram):
    held, placed = {}, {}
    for length, lo, hi, per_bin, first, base in packing.plan_bins(histogram, (40, 100), 5):
        for r in range(lo, hi):
            b, at = first + (r - lo) // per_bin, base + (r - lo) % per_bin * length
            held.setdefault(b, []).append((at, length))
            placed[length, r] = b
    assert len(placed) == sum(histogram.values())
    for spans in held.values():
        end = 0
        for at, n in sorted(spans):
            assert at == end
            end += n
        assert end <= 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abc .", max_size=40), min_size=1, max_size=6), st.lists(st.text("abc .", max_size=120), min_size=1, max_size=4))
def test_search_equals_plain_containment(items, docs):
    rows = list(enumerate(items))
    found = decontaminate.Index(rows).search(docs)
    for text, f in zip(docs, found, strict=True):
        assert {i for i, _ in f} <= set(brute_matches(text, rows))
        words = decontaminate.words_of(text)
        whole = [i for i, t in rows if (w := decontaminate.words_of(t)) and any(words[k : k + len(w)] == w for k in range(len(words)))]
        assert {i for i in whole if i in brute_matches(text, rows)} <= {i for i, _ in f}


@few
@given(st.lists(st.binary(max_size=50), max_size=5))
def test_records_of_any_bytes_are_read(payloads):
    data = b"".join(f"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: {len(p)}\r\n\r\n".encode() + p + b"\r\n\r\n" for p in payloads)
    assert [b for _, b in warc.parse_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))))] == payloads
