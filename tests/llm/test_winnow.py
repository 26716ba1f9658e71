import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strandix.llm.winnow import choose, fingerprints


def brute(h, w):
    kept = set()
    for i in range(max(1, len(h) - w + 1) if h else 0):
        window = h[i : i + w]
        m = min(window)
        kept.add(max(j for j in range(i, i + len(window)) if h[j] == m))
    return sorted(kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=30), max_size=5), st.integers(1, 12))
def test_rightmost_minimum_of_each_window(texts, w):
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    got = choose(np.array([x for t in texts for x in t], np.uint64), first, w)
    assert got.tolist() == [int(first[i]) + p for i, t in enumerate(texts) for p in brute(t, w)]


def test_cases_and_match_guarantee(spark):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdé日😀 ") for _ in range(149))
    rows = [(1, "x" * 40 + shared + "tail", 0), (2, "head" + shared, 0), (3, "", 0), (4, None, 0), (5, "short", 0), (None, "a" * 400, 0), (5, "short", 0), (6, "z" * 50000, 0)]
    got = fingerprints(spark.createDataFrame(rows, "doc_id long, text string, hashes int").coalesce(1)).collect()
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    h = [dict(zip(r.hashes, r.positions)) for r in got]
    common = set(h[0]) & set(h[1])
    assert common and all(rows[0][1][h[0][c] : h[0][c] + 50] == rows[1][1][h[1][c] : h[1][c] + 50] for c in common)
    assert got[2].positions == got[3].positions == [] and got[4].positions == [0] and got[4] == got[6]
    assert got[5].positions == list(range(99, 351)) and len(got[7].positions) == 50000 - 50 + 1 - 99
    assert fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
