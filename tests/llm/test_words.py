import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelforge.llm import words as W

TEXT = st.text(st.sampled_from("aB z9-éß中 \t\n\x0b\x1f .,"), max_size=40)
A_TO_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split(column, separators, fold):
    out = []
    for p in W.pieces(column, separators, fold):
        data = fold[p.data].tobytes()
        for i in range(len(p)):
            out.append([data[p.starts[k] : p.ends[k]].decode() for k in range(p.offsets[i], p.offsets[i + 1])])
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.sampled_from([1, 7, 1 << 20]))
def test_words_are_those_of_the_patterns(texts, piece):
    column, old = pa.array(texts, pa.string()), W.PIECE
    W.PIECE = piece
    try:
        assert split(column, W.BLANKS, W.KEEP) == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
        low = [(t or "").translate(A_TO_Z) for t in texts]
        assert split(column, W.NOT_ALNUM, W.LOWER) == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in low]
    finally:
        W.PIECE = old


def test_hashes_depend_on_words_only():
    a = next(W.pieces(pa.array(["the cat sat", "a the  cat\nsat b"]), W.BLANKS, W.LOWER))
    h = W.ngram_hashes(a.word_hashes(), 3)
    start, text = W.windows(a.offsets, 3)
    got = list(zip(text.tolist(), h[start].tolist(), strict=True))
    assert len(got) == 4 and got[0][1] == got[2][1] and len({x for _, x in got}) == 3


def test_sliced_columns():
    column = pa.array(["zero", "one two", None, "three"]).slice(1)
    assert split(column, W.BLANKS, W.KEEP) == [["one", "two"], [], ["three"]]
    assert isinstance(W.mix(np.arange(3, dtype=np.uint64)), np.ndarray)
