import collections
import math
import random

import numpy as np

from strandix.llm.quality import ORDER, _fold, accept, classify, fit, quantiles


def kneser_ney(texts):
    """Interpolated modified Kneser-Ney, written plainly."""
    c = [None] * (ORDER + 1)
    c[ORDER] = collections.Counter()
    for t in texts:
        b = bytes(ORDER - 1) + t.encode()
        for i in range(len(b) - ORDER + 1):
            c[ORDER][b[i : i + ORDER]] += 1
    for n in range(ORDER - 1, 0, -1):
        c[n] = collections.Counter(g[1:] for g in c[n + 1])
    d, total, held = {}, [collections.Counter() for _ in c], [collections.Counter() for _ in c]
    for n in range(1, ORDER + 1):
        k = [0, *(sum(v == i for v in c[n].values()) for i in (1, 2, 3, 4))]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0.5
        raw = [1 - 2 * y * k[2] / k[1] if k[1] else 0.5, 2 - 3 * y * k[3] / k[2] if k[2] else 1.0, 3 - 4 * y * k[4] / k[3] if k[3] else 1.5]
        d[n] = [min(max(x, 0.01), i - 0.01 if i < 3 else 2.99) for i, x in enumerate(raw, 1)]
        for g, v in c[n].items():
            total[n][g[:-1]] += v
            held[n][g[:-1]] += d[n][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / 256
        n, h = len(g), g[:-1]
        if h not in total[n]:
            return p(g[1:])
        v = c[n][g]
        return max(v - d[n][min(v, 3) - 1], 0) / total[n][h] * (v > 0) + held[n][h] / total[n][h] * p(g[1:])

    def perplexity(t):
        b = bytes(ORDER - 1) + t.encode()
        return math.exp(-sum(math.log(p(b[i : i + ORDER])) for i in range(len(b) - ORDER + 1)) / len(t.encode()))

    return perplexity


def corpus(n=80):
    rng = random.Random(4)
    syllables = ["tha", "en", "ing", "or", "été", "st "]
    good = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 40)))
    bad = lambda: "".join(rng.choice("#$%XQZ!&| ") for _ in range(rng.randint(20, 200)))
    docs = [(i, bad() if i % 8 == 0 else good(), ("en", "fr", None)[i % 3], "s") for i in range(n)]
    labels = [(i, 0 if i % 8 == 0 else 1, 0) for i in range(n) if i % 8 in (0, 1, 2, 3, 4)]
    return docs, labels


def test_matches_plain_model_by_either_way_and_separates(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, perplexity string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    score, trusted = fit(docs, labels)
    held = {r.doc_id: r.held_out for r in trusted.collect()}
    assert set(held) == {i for i, q, _ in marks if q} and 0 < sum(held.values()) < len(held)
    plain = kneser_ney([t for i, t, *_ in rows if held.get(i) is False])
    one = {r.doc_id: r._perplexity for r in score(docs).collect()}
    two = {r.doc_id: r._perplexity for r in fit(docs, labels, most_broadcast=1000)[0](docs).collect()}
    for i, t, *_ in rows:
        assert math.isclose(one[i], plain(t), rel_tol=1e-4) and math.isclose(two[i], one[i], rel_tol=1e-6)
    out = {r.doc_id: r for r in classify(docs, labels).collect()}
    bad = [i for i, *_ in rows if i % 8 == 0]
    assert not any(out[i].keep for i in bad) and sum(r.keep for r in out.values()) >= 0.95 * (len(rows) - len(bad))


def test_cases(spark):
    rows, marks = corpus(40)
    rows += [(100, "", "en", "s"), (101, None, "en", "s"), (None, "tha en or", "en", "s"), (1, rows[1][1], "fr", "s"), (102, "thaen " * 30000, "xx", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n string")
    labels = spark.createDataFrame([*marks, (None, 1, 0), (2, 1, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert not by[100].keep and not by[101].keep and by[100].perplexity is None and by[None].perplexity > 1 and by[102].threshold is not None
    assert len([r for r in got if r.doc_id == 1]) == 2
    clash = docs.withColumnRenamed("n", "keep")
    kept = accept(clash, labels)
    assert kept.columns == clash.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    none = classify(docs, labels.where("false")).collect()
    assert {r.doc_id for r in none if not r.keep} == {100, 101} and all(r.perplexity is None for r in none)
    assert classify(docs.where("false"), labels).count() == 0


def test_one_trusted_outlier_does_not_set_the_limit(spark):
    rows, marks = corpus(640)
    odd = next(i for i, q, _ in marks if q and _fold(np.array([i]))[0] == 0)
    rows = [(i, rows[0][1] if i == odd else t, "en" if i % 9 else "fr", s) for i, t, _, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, s string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in classify(docs, labels).collect()}
    bad = [i for i, *_ in rows if i % 8 == 0]
    assert not any(out[i].keep for i in [*bad, odd]) and sum(r.keep for r in out.values()) >= 0.97 * (len(rows) - len(bad))
    assert {i: r.keep for i, r in out.items()} == {r.doc_id: r.keep for r in classify(docs, labels, most_broadcast=1000).collect()}


def test_more_trusted_documents_than_go_out_at_once_are_all_in_the_model(spark):
    rows, marks = corpus()
    docs = spark.createDataFrame([*rows, (None, rows[1][1], "en", "s")], "doc_id long, text string, lang string, s string").repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    score, trusted = fit(docs, labels, most_trusted=9)
    held = {r.doc_id: r.held_out for r in trusted.collect()}
    plain = kneser_ney([t for i, t, *_ in rows if held.get(i) is False])
    got = {r.doc_id: r._perplexity for r in score(docs).collect()}
    assert len(held) == 40 and all(math.isclose(got[i], plain(t), rel_tol=1e-4) for i, t, *_ in rows)
    whole, parts = ({r.doc_id: (r.keep, round(r.threshold, 6)) for r in classify(docs, labels, most_trusted=n).collect()} for n in (10**6, 9))
    assert whole == parts and len(whole) == 81


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(9)
    groups = {"en": np.exp(rng.normal(1.5, 1e-5, 30_000)), None: np.round(rng.random(999) + 1, 2), "fr": np.array([7.5])}
    frame = spark.createDataFrame([("own", g, float(x)) for g, xs in groups.items() for x in xs], "what string, g string, x double").repartition(3)
    got = {r.g: r.x for r in quantiles(frame, 0.99).collect()}
    assert got == {g: np.sort(xs)[math.ceil(0.99 * len(xs)) - 1] for g, xs in groups.items()}
