"""Pure parts of the operators against plain versions, on generated inputs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import decontaminate, html_extract, secrets, simhash, substring_dedup

few_words = st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(few_words, st.lists(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), min_size=1, max_size=9), max_size=6), st.dictionaries(st.tuples(st.sampled_from([b"a", b"b"]), st.sampled_from([b"a", b"b"])), st.integers(0, 9)))
def test_matcher(doc, items, rarity):
    window = 4
    block = [(str(i), w) for i, w in enumerate(items)]
    spans, names = decontaminate.Matcher(block, rarity, window).find(doc)
    hit, found = set(), set()
    for name, w in block:
        size = min(window, len(w))
        for s in range(len(w) - size + 1):
            for i in range(len(doc) - size + 1):
                if doc[i : i + size] == w[s : s + size]:
                    hit.update(range(i, i + size))
                    found.add(name)
    assert {p for a, b in spans for p in range(a, b)} == hit and names == found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=140))
def test_anchors_cover_every_window_and_follow_its_words(words):
    h, u, first, n = substring_dedup.anchors(words)
    of = [(f, k) for k, (f, m) in enumerate(zip(first, n, strict=True)) for f in range(f, f + m)]
    assert [f for f, _ in of] == list(range(max(0, len(words) - 34)))
    by_words = {}
    for f, k in of:
        by_words.setdefault(tuple(words[f : f + 35]), set()).add(h[k])
    assert all(len(x) == 1 for x in by_words.values())
    by_stretch = {}
    for k in range(len(h)):
        by_stretch.setdefault((h[k], u[k]), set()).add((tuple(words[first[k] : first[k] + n[k] + 34]), n[k]))
    assert all(len(x) == 1 for x in by_stretch.values())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-&;=\"' apbdivrtcles#x", max_size=120))
def test_any_page_is_read(page):
    for _, t in html_extract.blocks(page):
        assert t == " ".join(t.split()) and t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="AKIAtokenTOKEN:= \"'0123456789abcdefé_ſK", max_size=90))
def test_base_spans(text):
    want = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.base_spans(text) == sorted(want)


def test_every_half_has_its_anchors():
    """The error patterns of a syndrome are all those of up to 2 bits that end in a word of the code."""
    from itertools import combinations

    table = simhash._errors()
    for s in range(32):
        want = set()
        for k in range(3):
            for bits in combinations(range(32), k):
                syndrome = 0
                for b in bits:
                    syndrome ^= b + 1 if b < 31 else 0
                if syndrome == s:
                    want.add(sum(1 << b for b in bits))
        # two bits of which one is the free bit need the other to be the syndrome's own
        assert set(table[s]) == want and len(table[s]) == len(want)
        assert bin(table[s][0]).count("1") <= 1
