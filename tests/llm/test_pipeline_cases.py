"""The pipeline over nulls, repeated rows and empty tables."""

import random

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars int, extra string"
ITEMS = "item_id long, text string"


def written(spark, folder, rows, items):
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def stages(spark, folder):
    """{stage: its rows}, each stage on what the one before it kept."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, folder)
        if name != "packing":
            assert after.schema.names == docs.schema.names
        after.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        out[name] = docs.collect()
    return out


def test_nulls_repeats_and_ties(spark, tmp_path):
    rnd = random.Random(1)
    vocabulary = {x: ["".join(rnd.choice(letters) for _ in range(rnd.randint(3, 8))) for _ in range(60)] for x, letters in (("en", "abcdefgh"), ("de", "mnopqrstü"))}
    say = lambda lang, n: " ".join(rnd.choice(vocabulary[lang]) for _ in range(n))
    rows = [(i, say(lang, 60), lang, "s", 1, "x") for i, lang in enumerate(["en", "de"] * 30)]
    passage = say("en", 25)
    rows += [(100, None, "en", "s", None, None), (101, "", None, None, 0, None), (102, "123 !!!", "en", "s", 7, "x"), (None, say("en", 40), "en", "s", 3, "x"), (None, None, None, None, None, None)]
    rows += [rows[4], rows[4], (103, rows[6][1], None, None, 5, "y"), (104, say("en", 30) + " " + passage + " " + say("en", 30), "en", "s", 3, "x")]
    folder = written(spark, tmp_path, rows, [(1, passage), (2, None), (None, say("de", 30)), (3, "")])
    got = stages(spark, folder)
    ids = {name: [r.doc_id for r in found] for name, found in got.items()}
    assert not {100, 101, 102} & set(ids["language"]) and {None, 4, 103, 104} <= set(ids["language"])
    lines = {(r.doc_id, r.text) for r in got["lines"]}
    assert (103, "") in lines and all(r.n_chars == len(r.text) for r in got["lines"] if r.doc_id == 103) and (6, rows[6][1]) in lines
    assert ids["lines"].count(4) == 3 and len(ids["lines"]) == len(ids["language"])
    assert {0, 1, 2, 3, 4, None} <= set(ids["near_duplicates"])
    assert 104 not in ids["decontamination"] and set(ids["decontamination"]) == set(ids["near_duplicates"]) - {104}
    assert set(ids["packing"]) == set(ids["decontamination"])
    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect()), key=repr)
    assert whole == sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in got["packing"]), key=repr)


def test_empty_tables(spark, tmp_path):
    assert all(not v for v in stages(spark, written(spark, tmp_path / "a", [], [])).values())
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    alone = stages(spark, written(spark, tmp_path / "b", [(1, "only one text here without a label", None, None, 1, None)], []))
    assert not alone["language"]  # nothing to learn from
