import random

import pytest

import corpus_pipeline
from brindle.llm import licenses

DOCS = "doc_id long, text string"


def brute(rows, templates, containment=80):
    out = []
    for doc, text in rows:
        words = licenses.words_of(text or "")
        for name, body in templates.items():
            t = licenses.words_of(body)
            if not t:
                continue
            size = min(licenses.SHINGLE, len(t))
            runs, have = set(licenses.shingles_of(t, size)), [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
            step = 1 << (len(runs) - 1).bit_length()
            hits = [(len(runs & set(have[b : b + 2 * step])) / len(runs), b) for b in range(0, len(have), step)]
            hits = [(s, b) for s, b in hits if round(s * len(runs)) * 100 >= containment * len(runs)]
            if hits:
                out.append((doc, name, max(hits)[0], len(hits), min(b for _, b in hits)))
    return sorted(out, key=repr)


def noisy(rnd, body):
    words = body.split(" ")
    for _ in range(rnd.randint(0, max(1, len(words) // 12))):
        k = rnd.randrange(len(words))
        words[k] = rnd.choice(["", "foo", words[k] + " bar", words[k].upper()])
    return rnd.choice([" ", "\n"]).join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    filler = lambda: " ".join(rnd.choice(["alpha", "license", "beta", "under", "version", "3"]) for _ in range(rnd.randint(0, 90)))
    rows = [(i, " ".join(x for _ in range(rnd.randint(0, 3)) for x in (filler(), noisy(rnd, rnd.choice(list(licenses.TEMPLATES.values())))))) for i in range(40)]
    rows += [(90, None), (91, ""), (92, "all rights"), (93, "ALL rights, reserved!"), (None, "Released under the MIT License"), (94, filler() * 30 + licenses.TEMPLATES["gpl-notice"])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", row int")
    got = sorted((tuple(r) for r in licenses.license_matches(frame).select("doc_id", "license", "containment", "n_windows", "first_word").collect()), key=repr)
    assert got == brute(rows, licenses.TEMPLATES)


def test_repeats_empty_and_own_templates(spark):
    rows = [(1, "one two three four five six")] * 2
    got = licenses.license_matches(spark.createDataFrame(rows, DOCS), {"x": "Two three", "none": "", "long": "one two three four five six seven"}).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "x")] * 2
    assert licenses.license_matches(spark.createDataFrame([], DOCS)).count() == 0
    assert licenses.license_matches(spark.createDataFrame(rows, DOCS), {}).count() == 0


def test_plan_is_native(spark):
    plan = licenses.license_matches(spark.createDataFrame([(1, "x")], DOCS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages(spark, tmp_path):
    rnd = random.Random(6)
    vocabulary = {"en": "the of and with thing ation house over this was".split(), "fr": "le de être où garçon maison avec leur des une".split()}
    say = lambda code, n: " ".join(rnd.choice(vocabulary[code]) + str(rnd.randint(0, 400)) for _ in range(n))
    item = say("en", 30)
    clean = [(i, "\n".join(say(c, 12) for _ in range(4)), c) for i, c in enumerate(["en", "fr"] * 30)]
    shared = say("en", 9)
    rows = clean + [(100, "### 12 !!", "en"), (101, clean[5][1], "fr"), (102, clean[7][1].replace("\n", " ", 1), "fr"), (103, say("en", 20) + " " + item + "\n" + say("en", 10), "en"), (104, shared + "\n" + say("en", 15), "en"), (105, shared + "\n" + say("en", 15), "en")]
    spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], DOCS + ", lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.schema.names == docs.schema.names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    ids = {name: {r.doc_id for r in got} for name, got in seen.items()}
    every = {r[0] for r in rows}
    assert ids["language"] == every - {100}
    text = {r.doc_id: r.text for r in seen["lines"]}
    assert ids["lines"] == every - {100} and text[101] == "" and text[104].startswith(shared) and shared not in text[105]
    assert all(text[i] == t for i, t, _ in clean)
    assert {r.doc_id: r.n_chars for r in seen["lines"]} == {i: len(t) for i, t in text.items()}
    assert ids["near_duplicates"] >= {r[0] for r in clean} | {103, 104, 105}
    assert ids["decontamination"] == ids["near_duplicates"] - {103} and ids["packing"] == ids["decontamination"]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sum(r.length for r in again.collect()) == sum(r.length for r in seen["packing"])
