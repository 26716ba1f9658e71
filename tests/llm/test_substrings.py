import random
from collections import defaultdict

import numpy as np

from strandix.llm.substrings import Known, anchors, repeats


def brute(docs, n=50):
    """Positions covered by windows of n words that occur in two doc_ids, by doc_id."""
    where = defaultdict(set)
    texts = {(d, t) for d, t in docs if d is not None and t}
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            where[tuple(w[i : i + n])].add(d)
    out = defaultdict(set)
    for d, t in texts:
        w = t.split()
        for i in range(len(w) - n + 1):
            if len(where[tuple(w[i : i + n])]) > 1:
                out[d].update(range(i, i + n))
    return {d: p for d, p in out.items()}


def covered(rows):
    out = defaultdict(set)
    for r in rows:
        assert r.other_doc_id != r.doc_id and r.n_words >= 50
        out[r.doc_id].update(range(r.first_word, r.first_word + r.n_words))
    return dict(out)


def test_spans_against_brute_force(spark):
    rng = random.Random(9)
    words = ["the", "of", "and", "a"] * 60 + ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(rng.choice([50, 51, 52, 55, 60, 80, 120, 300])) for _ in range(40)] + [["la"] * 90, ["x", "y"] * 60, text(49)]
    docs = []
    for i in range(150):
        w = text(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        docs.append((i, " ".join(w)))
    docs += [(200, docs[3][1]), (201, docs[4][1]), (202, docs[4][1] + " tail"), (203, " ".join(["la"] * 400)), (204, " ".join(text(30) + ["la"] * 77 + text(10)))]
    frame = spark.createDataFrame([(d, t, "s", 1) for d, t in docs], "doc_id long, text string, symbol string, first int").repartition(4)
    got, want = covered(repeats(frame).collect()), brute(docs)
    assert got == covered(repeats(frame, hot=2).collect())
    assert all(p <= want.get(d, set()) for d, p in got.items())
    assert set(want) == set(got)
    assert sum(map(len, got.values())) >= 0.98 * sum(map(len, want.values())) > 5000


def test_cases(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    p = " ".join(word() for _ in range(60))
    rows = [(1, p), (1, p), (2, None), (3, ""), (None, p), (4, "short one"), (5, "short one"), (6, " ".join(word() for _ in range(60000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert repeats(frame).count() == 0
    more = frame.unionAll(spark.createDataFrame([(7, "x\n" + p + "\t y"), (8, p)], "doc_id long, text string"))
    got = sorted(tuple(r) for r in repeats(more).collect())
    assert got == [(1, 0, 60, 8), (7, 1, 60, 1), (8, 0, 60, 1)]
    assert repeats(frame.where("false")).count() == 0


def test_a_passage_in_most_documents(spark):
    """Most rows of its anchors and windows stay out of the grouping, and all documents that have it are found."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    p = [word() for _ in range(70)]
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 60))), *(p if i % 3 else []), *(word() for _ in range(rng.randint(0, 60)))])) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = anchors(frame).collect()
    assert len([r for r in found if r.other is not None]) > 400 and len([r for r in found if r.first < 0]) <= 2 * 3 * 15
    got = covered(repeats(frame).collect())
    assert got == brute(docs) and len(got) == 266


def test_known():
    k = Known(3)
    values, docs = np.array([5, 5, 5, 5, 9, 9, 7], np.uint64), np.array([1, 2, 2, 4, 1, 2, 3])
    known, other, v, d = k.split(values, docs)
    assert known.tolist() == [True] * 4 + [False] * 3 and other[:4].tolist() == [4, 1, 1, 1] and sorted(zip(v.tolist(), d.tolist())) == [(5, 1), (5, 4)]
    known, other, v, d = k.split(np.array([5, 9], np.uint64), np.array([1, 3]))
    assert known.tolist() == [True, False] and other[0] == 4 and len(v) == 0
    assert [len(x) for x in k.split(np.zeros(0, np.uint64), np.zeros(0, np.int64))] == [0] * 4
