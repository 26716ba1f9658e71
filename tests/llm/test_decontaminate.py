import random

from strandix.llm.decontaminate import bar, contained, decontaminate


def brute(docs, items, least=0.8):
    out = []
    for i, t in items:
        w = (t or "").split()
        k = min(5, len(w))
        if not k:
            continue
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
        for d, text, *_ in docs:
            v = (text or "").split()
            have = [tuple(v[j : j + k]) for j in range(len(v) - k + 1)]
            n = len(s & set(have))
            if n / len(s) >= least:
                out.append((d, i, len(s), n, next(j for j, g in enumerate(have) if g in s)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(3, 60))) for i in range(60)] + [(90, ""), (91, None), (92, "abc"), (93, "bad dab")]
    items += [(94, items[0][1])]
    docs = []
    for d in range(120):
        parts = text(rng.randint(0, 400)).split()
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1]
            w = (w or "").split()
            if rng.random() < 0.3 and len(w) > 20:
                w[rng.randrange(len(w))] = "zzz"
            at = rng.randint(0, len(parts))
            parts[at:at] = w
        docs.append((d, " ".join(parts), 1))
    docs += [(200, None, 1), (201, "", 1), (None, "x " + items[1][1], 1), (3, docs[3][1], 1), (202, text(60000) + " " + items[2][1], 1), (203, "bad\ndab", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for portion in (100, 1_000_000):
        got = sorted(((r.doc_id, r.item_id, r.n_shingles, r.n_found, r.first_word) for r in contained(frame, bench, portion=portion).collect()), key=str)
        assert got == want
    assert len(want) > 60
    dirty = {t for t in {t for _, t, _ in docs if t} if brute([(0, t)], items)}
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t, _ in docs if t not in dirty)
    assert contained(frame.where("false"), bench).count() == 0 and contained(frame, bench.where("false")).count() == 0


def test_short_items_are_found_in_long_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(5))) for i in range(300)]
    docs = [(i, " ".join([*(word() for _ in range(40)), t, *(word() for _ in range(40))])) for i, t in items]
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(i, i) for i, _ in items]


def test_scattered_pieces_of_long_items_are_found(spark):
    """An item whose shingles lie far apart in a document, some of them gone."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(300))) for i in range(40)]
    docs = []
    for i, t in items:
        w = t.split()
        parts = [w[j : j + 60] for j in range(0, 300, 60)]
        docs.append((i, " ".join(x for p in parts for x in [*p, *(word() for _ in range(500))])))
        docs.append((100 + i, " ".join([*w[:200], *(word() for _ in range(50))])))
    got = contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_found) for r in got) == sorted((i, i, n) for i, _, _, n, _ in brute(docs, items) if i < 100) and len(got) == 40


def test_bar():
    assert bar(1.0) == 32 and 8 <= bar(0.8) <= 16 and bar(0.01) == 1


def test_rows_of_one_doc_id_are_judged_by_their_text(spark):
    item = "this very sentence is a test item that must never be trained on"
    rows = [(7, "so " + item, 1), (7, "something else that is clean and stays", 2), (None, item + " indeed", 3), (None, "clean too and without any id", 4), (8, None, 5), (9, item, 6), (9, item, 7), (10, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _dirty int").repartition(3)
    got = decontaminate(frame, spark.createDataFrame([(0, item), (None, item)], "item_id long, text string"))
    assert got.columns == frame.columns and sorted(r._dirty for r in got.collect()) == [2, 4, 5, 8]
    assert decontaminate(frame, spark.createDataFrame([], "item_id long, text string")).count() == 8
    assert decontaminate(frame.where("false"), spark.createDataFrame([(0, item)], "item_id long, text string")).count() == 0


def test_many_dirty_rows_go_without_a_broadcast(spark, monkeypatch):
    item = "this very sentence is a test item that must never be trained on"
    frame = spark.createDataFrame([(i, item if i % 2 else f"clean text number {i}") for i in range(20)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr("strandix.llm.common.MOST_GONE", 3)
    assert sorted(r.doc_id for r in decontaminate(frame, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()) == list(range(0, 20, 2))
