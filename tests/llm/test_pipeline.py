import random

import corpus_pipeline
from strandix.llm import bpe
from strandix.llm.token_files import open_documents

from .test_decontaminate import brute as leaks
from .test_quality import kneser_ney
from .test_simhash import find, shingles


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    syllables = ["tha", "en", "ing", "or", "ish", "ion", "ver", "el"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(1500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs, junk = [], set()
    for i in range(240):
        t = text(rng.randint(60, 200))
        kind = i % 12
        if kind == 0:
            t = "".join(rng.choice("#$%XQZ!&| ") for _ in range(300))
            junk.add(i)
        elif kind in (1, 2) and i > 24:
            t = docs[rng.choice([j for j in range(i) if j % 12 in (3, 4, 5)])][1]
            if kind == 2:
                w = t.split()
                w[rng.randrange(len(w))] = "changed"
                t = " ".join(w)
        elif kind == 6:
            t = t + " " + rng.choice(items)[1] + " " + text(20)
        docs.append((i, t, "en", f"s{min(i % 5, 2)}", len(t)))
    docs += [(900, None, "en", "s0", None), (901, "", None, None, 0)]
    marks = [(i, int(i not in junk), 0) for i in range(240) if i % 3]
    d = f"file://{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")

    frames, rows = [spark.read.parquet(f"{d}/documents.parquet")], [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frames[-1], d).write.parquet(f"{d}/stage{i}")
        frames.append(spark.read.parquet(f"{d}/stage{i}"))
        assert frames[-1].columns == frames[0].columns
        rows.append([tuple(r) for r in frames[-1].collect()])
        assert set(rows[-1]) <= set(rows[-2])
    # Quality: all junk goes, clean documents stay.
    kept = {r[0] for r in rows[1]}
    assert not kept & (junk | {900, 901}) and len(kept) >= 0.97 * (240 - len(junk))
    plain = kneser_ney([t for i, t, *_ in docs if i in kept])
    assert min(plain(docs[i][1]) for i in junk) > max(plain(docs[i][1]) for i in kept)
    # Near duplicates: one of each group by brute force.
    parent, sets = {}, {r[0]: shingles(r[1]) for r in rows[1]}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.55 * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    assert {r[0] for r in rows[2]} == {a for a in sets if find(parent, a) == a}
    # Leaks.
    dirty = {i for i, *_ in leaks([r[:2] for r in rows[2]], items)}
    assert dirty and {r[0] for r in rows[3]} == {r[0] for r in rows[2]} - dirty
    # Mixture: near the target, and no source beyond its budget.
    tokens = lambda rs, s: sum(len(r[1].split()) for r in rs if r[3] == s)
    names = {r[3] for r in rows[3]}
    share = {s: round(tokens(rows[3], s) ** 0.5 * 1000) for s in names}
    total = sum(tokens(rows[3], s) for s in names)
    for s in names:
        budget = total * share[s] / sum(share.values())
        assert budget - 200 <= tokens(rows[4], s) <= budget
    # Shards: every copy, exactly.
    ids, got = bpe.encoder(), []
    for shard in corpus_pipeline.run(spark, d).collect():
        got += [(i, x.tobytes()) for i, x in zip(shard.doc_ids, open_documents(shard.file, range(shard.n_docs)))]
    assert sorted(got) == sorted((r[0], ids(r[1])) for r in rows[4])


def test_repeated_ids_extra_columns_and_nothing(spark, tmp_path):
    """Rows of one doc_id with other texts are judged by their own text at each stage; columns that clash with the operators' own go along."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["tha", "en", "ing", "or", "ish"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item, twin = text(20), text(90)
    rows = [(i, text(90), "en", "s") for i in range(30)]
    rows += [(0, twin, "en", "s"), (1, twin, "en", "s"), (2, text(40) + " " + item, "en", "s"), (None, item, "en", "s"), (None, text(90), None, None), (3, None, "en", "s"), (4, "", None, "s"), (5, rows[5][1], "en", "s")]
    clash = ["_gone", "_dirty", "_mix_copies", "h", "id", "keep", "_n", "_0", "kept"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in clash)
    docs = spark.createDataFrame([(*r, len(r[1] or ""), *[i] * len(clash)) for i, r in enumerate(rows)], schema).repartition(3)
    d = f"file://{tmp_path}"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    whole = spark.read.parquet(f"{d}/documents.parquet")
    once = stages["near_duplicates"](spark, whole, d)
    # Of the twins the row of doc_id 0 stays; the other texts of 0 and 1 do, too, and so do both copies of one row.
    assert sorted(r.h for r in once.collect()) == [i for i in range(38) if i != 31]
    clean = stages["decontamination"](spark, once, d)
    assert sorted(r.h for r in clean.collect()) == [i for i in range(38) if i not in (31, 32, 33)]
    for frame in (once, clean, stages["mixture"](spark, clean, d), stages["quality"](spark, whole, d)):
        assert frame.columns == whole.columns
    docs = whole.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0, name
