"""Word hashing, grouping of batches, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import wordhash
from lectern.llm.minhash_dedup import circulant_signatures
from lectern.llm.shared import Forest, connected_components, groups

from .helpers import words

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é日\t\n\x0b\x0c\r ", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_equal_words_have_equal_hashes(texts):
    hashes, names = [], []
    for first, offsets, found in wordhash.words_of(texts):
        for i in range(len(offsets) - 1):
            own = words(texts[first + i], lower=True)
            assert offsets[i + 1] - offsets[i] == len(own)
            names += own
        hashes += found[offsets[0] : offsets[-1]].tolist()
    assert len({(n, h) for n, h in zip(names, hashes, strict=True)}) == len(set(names)) == len(set(hashes))


def test_pieces_do_not_change_hashes():
    long = " ".join(f"word{i % 5000}" for i in range(300_000))  # over two megabytes
    alone = [h for _, _, h in wordhash.words_of([long])][0]
    parts = list(wordhash.words_of(["a b", long, None, "word7 word8"]))
    assert [first for first, _, _ in parts] == [0, 1, 2]
    assert (parts[1][2] == alone).all() and parts[2][2].tolist() == alone[7:9].tolist()


def test_shingles():
    w = next(wordhash.words_of(["a b c d e a b c d e"]))[2]
    assert len(wordhash.shingles(w, 5)) == 5 and len(wordhash.shingles(w[:3], 5)) == 1 and len(wordhash.shingles(w[:0], 5)) == 0
    assert wordhash.shingles(w[:2], 5) != wordhash.shingles(w[[1, 0]], 5)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate((a[:360], rng.integers(0, 2**63, 40, dtype=np.uint64)))  # 360 of 440
    sig = circulant_signatures(np.concatenate((a, b)), np.array([0, 400]), 512)
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.06


def test_groups_span_batches():
    rows = pd.DataFrame({"k": [1, 1, 2, 2, 2, 3], "v": range(6)})
    for cut in range(7):
        got = list(groups(iter([rows.iloc[:cut], rows.iloc[cut:]]), ["k"]))
        assert [g["v"].tolist() for g in got] == [[0, 1], [2, 3, 4], [5]]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 150)] + [(7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(150)) and len(got) == 351
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest():
    f = Forest(5)
    assert f.join(0, 1) and f.join(3, 4) and f.join(1, 4) and not f.join(0, 3)
    assert [f.root(i) for i in range(5)] == [0, 0, 2, 0, 0]
