import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import textvec as tv

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\nüZ9.,漢", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_are_those_of_a_regular_expression(texts, chunk):
    old, tv.CHUNK = tv.CHUNK, chunk
    try:
        got, hashes = [], {}
        for c in tv.text_chunks(pa.array(texts, pa.string())):
            c.split(~tv.SPACE)
            low = tv.lower_ascii(c.buf)
            c.prefix_hash(low)
            h = c.word_hashes()
            words = [low[a:b].tobytes() for a, b in zip(c.start, c.end, strict=True)]
            for w, x in zip(words, h, strict=True):
                assert hashes.setdefault(w, x) == x
            got += [words[a:b] for a, b in zip(c.word_offsets[:-1], c.word_offsets[1:], strict=True)]
    finally:
        tv.CHUNK = old
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(lower)) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_sliced_and_chunked_arrays():
    whole = pa.array(["one two", None, "three", ""])
    for a in (whole.slice(1, 3), pa.chunked_array([whole.slice(1, 1), whole.slice(2, 2)])):
        counts = []
        for c in tv.text_chunks(a):
            c.split(~tv.SPACE)
            counts += c.counts.tolist()
        assert counts == [0, 1, 0]
    assert list(tv.text_chunks(pa.array([], pa.string()))) == []


def test_ngrams_stay_inside_a_text():
    words, doc = np.arange(7, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 2, 2])
    h, d = tv.ngram_hashes(words, doc, 2)
    assert d.tolist() == [0, 0, 1, 2] and len(set(h.tolist())) == 4
    assert tv.ngram_hashes(words, doc, 2, gap=1)[1].tolist() == [0]
    assert len(tv.ngram_hashes(words[:1], doc[:1], 2)[0]) == 0
