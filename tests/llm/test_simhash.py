import random

import numpy as np

from strandix.llm.common import Words, utf8
from strandix.llm.components import components
from strandix.llm import simhash as module
from strandix.llm.simhash import JACCARD, Graph, alike, audit, candidates, crossings, crowd_bridges, deduplicate, distance, exact, fingerprints, groups, simhash


def find(parent, x):
    while parent.get(x, x) != x:
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in edges for x in e if e[0] != e[1] or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_graph_recall_with_every_node_a_query():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, (2500, 2), dtype=np.uint64)
    flips = np.unpackbits(fp[:800].view(np.uint8), axis=1) ^ (rng.random((800, 128)) < 0.12)
    fp = np.concatenate([fp, np.packbits(flips, axis=1).view(np.uint64), np.repeat(fp[:1], 150, axis=0)])
    fp = fp[rng.permutation(len(fp))]
    got, crowded = set(), set()
    for s in range(3):
        own = np.arange(s, len(fp), 3)
        a, b, d, c = Graph(fp[own]).within(fp)
        b = own[b]
        assert (distance(fp[a], fp[b]) == d).all() and (d <= 36).all()
        got |= {(min(p), max(p)) for p in zip(a.tolist(), b.tolist()) if p[0] != p[1]}
        crowded |= set(c.tolist())
    want = set()
    for i in range(0, len(fp), 500):
        x, y = np.nonzero(distance(fp[i : i + 500, None], fp[None]) <= 36)
        want |= {(p + i, q) for p, q in zip(x.tolist(), y.tolist()) if p + i < q}
    assert want == {(int(i), int(k)) for r, c in exact(fp, fp, 36) for i, k in zip(r, c) if i < k}
    assert 150 <= len(crowded) < 160
    open_ = {p for p in want if not crowded >= set(p)}
    assert got <= want and len(got & open_) >= 0.95 * len(open_) > 500


def test_simhash_is_the_plain_majority():
    import pyarrow as pa

    texts = ["a b c a b", "", "one", "x " * 1000, "é ü ß"]
    data, offsets = utf8(pa.array(texts))
    w = Words(data, offsets)
    whole = simhash(w)
    for i, t in enumerate(texts):
        data, offsets = utf8(pa.array([t]))
        assert (simhash(Words(data, offsets))[0] == whole[i]).all()
    assert (whole[1] == 0).all() and (whole[0] != whole[4]).any()


def make(rng, n):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(900)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.4:
            w = rng.choice(docs).split()
            p = rng.choice([0, 0.01, 0.05, 0.2])
            w = [rng.choice(words) if rng.random() < p else x for x in w]
        else:
            w = [rng.choice(words) for _ in range(rng.randint(30, 300))]
        docs.append(" ".join(w))
    return docs


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} or {tuple(w)}


def test_groups_against_brute_force(spark):
    texts = make(random.Random(6), 400)
    frame = spark.createDataFrame([(i, t, "l", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int").repartition(4)
    sets = [shingles(t) for t in texts]
    parent, edges = {}, []
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or len(sets[i] & sets[j]) >= JACCARD * len(sets[i] | sets[j]):
                edges.append((j, i))
                a, b = find(parent, i), find(parent, j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    want = {i: find(parent, i) for i in range(len(texts)) if find(parent, i) != i}
    for shard in (1 << 20, 40):
        got = {r.doc_id: r.kept for r in groups(frame, shard=shard).collect()}
        right = sum(got.get(i) == k for i, k in want.items())
        assert not set(got) - set(want) and right >= 0.95 * len(want) and len(want) > 80
    kept = deduplicate(frame)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - set(groups(frame).toPandas()["doc_id"])


def test_audit(spark):
    texts = make(random.Random(8), 300)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = fingerprints(frame).selectExpr("doc_id AS id", "f0", "f1").cache()
    found, there = audit(nodes, candidates(nodes, 300, shard=30, portion=50), queries=300)
    assert there > 50 and found >= 0.95 * there
    assert audit(nodes, candidates(nodes, 300).where("false"), queries=300) == (0, there)


def test_crossings_are_all_pairs_of_other_labels(spark):
    rng = np.random.default_rng(3)
    fp = np.repeat(rng.integers(0, 2**64, (5, 2), dtype=np.uint64), 20, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (100, 2), dtype=np.uint64))
    label = [i % 3 for i in range(100)]
    frame = spark.createDataFrame([(i, int(a), int(b), label[i]) for i, (a, b) in enumerate(fp.view(np.int64))], "id long, f0 long, f1 long, label long").repartition(3)
    d = distance(fp[:, None], fp[None])
    want = {(i, j) for i in range(100) for j in range(i + 1, 100) if d[i, j] <= 36 and label[i] != label[j]}
    for block in (7, 1000):
        assert {tuple(r) for r in crossings(frame, 100, block=block).collect()} == want and len(want) > 500


def test_crowds(spark):
    """A cluster beyond the widest beam, of which the members are alike only along a chain of changes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    w = [word() for _ in range(120)]
    texts = []
    for i in range(900):
        if i % 3 == 0:
            w[i // 3 % 120] = word()
        texts.append(" ".join([*w[:60], f"n{i}", *w[60:]]))
    other = [" ".join(word() for _ in range(100)) for _ in range(50)]
    rows = list(enumerate(texts + other))
    got = {r.doc_id: r.kept for r in groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(1, 900)}


def test_cases(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until night falls on the hill"
    rows = [(1, None), (2, ""), (3, ""), (None, t), (4, t), (5, t), (5, t), (6, "w"), (7, "w"), (8, t + " w"), (9, "long text here " * 30000), (10, "  "), (11, "a b"), (12, "a c"), (13, None)]
    frame = spark.createDataFrame([(i, x, "z") for i, x in rows], "doc_id long, text string, id string")
    got = {r.doc_id: r.kept for r in groups(frame).collect()}
    assert got == {5: 4, 8: 4, 7: 6}
    assert deduplicate(frame).count() == len(rows) - 4
    assert groups(frame.where("false")).count() == 0 and deduplicate(frame.where("false")).count() == 0


def test_rows_of_one_doc_id_are_judged_by_their_text(spark):
    t, u = "the quick brown fox jumps over the lazy dog again and again until night falls", "a totally different text that nothing else in this table is like at all"
    rows = [(0, t, 1), (1, t, 2), (1, u, 3), (2, u + " x", 4), (2, t + " y", 5), (None, u, 6), (0, t, 7), (3, None, 8), (3, "unlike all the others there are", 9), (4, t, 10), (4, t + " z", 11)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    assert sorted(r.n for r in deduplicate(frame).collect()) == [1, 3, 6, 7, 8, 9]
    assert sorted(map(tuple, groups(frame).collect())) == [(1, 0), (2, 0), (2, 1), (4, 0)]


def test_columns_of_any_name_stay(spark):
    names = ["_gone", "h", "kept", "kept_h", "gone_id", "gone_h", "_0", "_1", "id", "f0"]
    frame = spark.createDataFrame([(i, "one text that is twice here", *range(10)) for i in range(2)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = deduplicate(frame)
    assert got.columns == frame.columns and [tuple(r) for r in got.collect()] == [(0, "one text that is twice here", *range(10))]


def test_a_node_that_only_a_crowd_finds_is_verified(spark, monkeypatch):
    rng = random.Random(12)
    w = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(100)]
    texts = [" ".join([*w, "w" + "x" * i]) for i in range(100)]
    found = lambda nodes, *a: nodes.sparkSession.createDataFrame([], "a long, b long, d int").unionAll(nodes.selectExpr("id AS a", "id AS b", "0 AS d"))
    monkeypatch.setattr("strandix.llm.simhash.candidates", found)
    got = {r.doc_id: r.kept for r in groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 0 for i in range(1, 100)}


def test_crowd_bridges_join_what_verified_crossings_join(spark):
    rng = np.random.default_rng(7)
    fp = np.repeat(rng.integers(0, 2**64, (3, 2), dtype=np.uint64), 50, axis=0) ^ (np.uint64(1) << rng.integers(0, 64, (150, 2), dtype=np.uint64))
    base = [rng.integers(0, 2**32, 60, dtype=np.uint32) for _ in range(6)]
    sets = [np.unique(np.concatenate([base[i % 6][: rng.integers(25, 61)], rng.integers(0, 2**32, rng.integers(5, 40), dtype=np.uint32)])) for i in range(150)]
    label = [1000 + i // 2 for i in range(150)]
    rows = [(i, int(a), int(b), label[i], bytearray(sets[i].tobytes())) for i, (a, b) in enumerate(fp.view(np.int64))]
    frame = spark.createDataFrame(rows, "id long, f0 long, f1 long, label long, set binary").repartition(3)
    d = distance(fp[:, None], fp[None])
    edges = {(label[i], label[j]) for i in range(150) for j in range(i + 1, 150) if d[i, j] <= 36 and label[i] != label[j] and alike(sets[i], sets[j], JACCARD)}
    assert len(edges) > 40

    def least(pairs):
        parent = {}
        for a, b in pairs:
            a, b = find(parent, a), find(parent, b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        return {x: find(parent, x) for x in label}

    for block, size in ((1000, 1 << 25), (40, 1 << 25), (1000, 20_000)):
        got = {tuple(r) for r in crowd_bridges(frame, block=block, block_bytes=size).collect()}
        assert least(got) == least(edges) and (block < 1000 or size < 1 << 25 or len(got) < len(set(label)))


def test_pairs_of_a_crowd_that_is_not_alike_are_not_exchanged(spark, monkeypatch):
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    w = [word() for _ in range(24)]
    texts = [" ".join([*w, *(word() for _ in range(14))]) for _ in range(600)]
    seen, plain = [], module.verify
    monkeypatch.setattr(module, "verify", lambda pairs, *a: (seen.append(pairs.count()), plain(pairs, *a))[1])
    monkeypatch.setattr(module, "candidates", lambda nodes, *a: nodes.selectExpr("id AS a", "id AS b", "0 AS d"))
    assert groups(spark.createDataFrame([*enumerate(texts), (600, texts[0] + " x")], "doc_id long, text string")).collect() == [(600, 0)]
    assert sum(seen) <= 1200
