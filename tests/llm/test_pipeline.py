"""Each stage against what its operator's brute-force version keeps of the stage's own input."""

import os
import random
from collections import Counter

import pytest
from test_duplicates import exact_brute, jaccard_brute

import corpus_pipeline
from quern.llm.langid import identify_language
from quern.llm.packing import pack_documents

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables whose documents hold copies, near copies, nulls and junk."""
    base = tmp_path_factory.mktemp("tables")
    # long enough that one changed word leaves a similarity of 0.95, which sketches never take for less than 0.8
    body = [" ".join(f"word{(k * 7 + j * j) % 211}" for j in range(250)).capitalize() + "." for k in range(40)]
    rows = [(k, text, "en", "s", len(text)) for k, text in enumerate(body)]
    rows += [(100 + k, body[k] + " \n", "en", "s", 1) for k in range(10)]  # equal but for white space, and longer
    rows += [(200 + k, body[k].replace("word1", "word9", 1) + " More.", "en", "s", 1) for k in range(10)]
    rows += [(300 + k, "###$$$ %%% &&& " * 30, "en", "s", 1) for k in range(6)]
    rows += [(400, None, None, None, None), (401, "", "en", "s", 0), (402, "12 34", "en", "s", 5), (403, "de " * 900, "de", "s", 1)]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(k, 1, 0) for k in range(40)] + [(300 + k, 0, 0) for k in range(6)] + [(400, 0, 0), (401, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = STAGES["quality"](spark, docs, folder)
    assert kept.columns == columns and set(rows_of(kept)) <= set(rows_of(docs))
    assert {r[0] for r in rows_of(kept)} >= set(range(40)) and not {r[0] for r in rows_of(kept)} & set(range(300, 306))

    known = STAGES["language"](spark, docs, folder)
    sure = {r.doc_id for r in identify_language(docs).collect() if not r.ambiguous}
    assert {r[0] for r in rows_of(known)} == sure and not sure & {*range(300, 306), 400, 401, 402}

    want = {key[0] for key in exact_brute(rows_of(docs)) if key[3]}  # a row of the fixture has an id of its own
    single = STAGES["exact_dedup"](spark, docs, folder)
    assert {r[0] for r in rows_of(single)} == want and {100 + k for k in range(10)} <= want

    want = {doc for doc, least in jaccard_brute(rows_of(docs))[0] if doc == least}
    apart = STAGES["near_dedup"](spark, docs, folder)
    assert {r[0] for r in rows_of(apart)} == want and not want & {100 + k for k in range(10)}

    packed = STAGES["packing"](spark, apart, folder)
    assert Counter(rows_of(packed.drop("sequence_id", "offset"))) == Counter(rows_of(pack_documents(apart).drop("sequence_id", "offset")))


def test_stages_on_nothing(spark, folder):
    docs = spark.createDataFrame([], COLUMNS)
    for stage in STAGES.values():
        assert stage(spark, docs, folder).count() == 0


def test_null_ids_and_more_columns(spark, folder):
    docs = spark.createDataFrame([(None, "A text of words.", "en", "s", 1, 5), (1, "Other words here.", "en", "s", 1, 6)], COLUMNS + ", _kept_id int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name


def test_dedup_drops_rows_and_not_ids(spark, folder):
    a, b, c = ("".join(f"{w}{k} " for k in range(60)) for w in ("one", "other", "third"))
    rows = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, None), (7, c + " "), (8, "")]
    docs = spark.createDataFrame([(k, text, "en", "s", 1) for k, text in rows], COLUMNS)
    want = Counter([(1, a), (5, b), (7, c + " "), (8, "")])
    for name in ("exact_dedup", "near_dedup"):
        assert Counter((r.doc_id, r.text) for r in STAGES[name](spark, docs, folder).collect()) == want, name


#: Texts in languages that the fixture doesn't teach, of two languages, and of one word.
FOREIGN = [
    "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 20,
    "いろはにほへと ちりぬるを わかよたれそ つねならむ " * 20,
    "Törkylempijävongahdus on suomalainen sana ja se on hyvin pitkä. " * 20,
]


def spoken(spark):
    """Documents in three languages of made-up words, some not labelled, and foreign ones."""
    r = random.Random(5)
    sounds = {"en": "the ing th er wh of and sh ly st".split(), "de": "sch ung ei der ich ß ü au zu ver".split(), "es": "ción os la ñ que ado ll es ar í".split()}

    def text(lang):
        return " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(80))

    rows = [(len(sounds) * k + j, text(lang), lang if k % 5 else None, "s", 1) for k in range(60) for j, lang in enumerate(sounds)]
    mixed = [(900 + k, text("en") + " " + text("de"), "en", "s", 1) for k in range(3)]
    foreign = [(1000 + k, t, None, "s", 1) for k, t in enumerate(FOREIGN)]
    return spark.createDataFrame(rows + mixed + foreign, COLUMNS).repartition(4), {r[0] for r in rows}, list(sounds)


def test_language_stage_decides_by_its_classifier(spark, folder, monkeypatch):
    docs, clean, sounds = spoken(spark)
    found = {r.doc_id: r for r in identify_language(docs).collect()}
    kept = {r.doc_id for r in STAGES["language"](spark, docs, folder).collect()}
    assert kept == {k for k, r in found.items() if not r.ambiguous}
    assert kept >= clean and not kept & {1000, 1001, 1002}  # all have letters
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("es", "de"))
    kept = {r.doc_id for r in STAGES["language"](spark, docs, folder).collect()}
    assert kept == {k for k, r in found.items() if not r.ambiguous and r.lang_pred in ("es", "de")}
    assert kept & clean == {k for k in clean if sounds[k % 3] in ("es", "de")}


def test_repeated_rows_leave_one(spark, folder):
    """Rows that are equal in all columns, with an id or without one, are copies of each other."""
    a, b = ("".join(f"{w}{k} " for k in range(60)) for w in ("one", "other"))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (3, None), (3, None)]
    docs = spark.createDataFrame([(k, text, "en", "s", 1) for k, text in rows], COLUMNS).repartition(3)
    for name in ("exact_dedup", "near_dedup"):
        got = STAGES[name](spark, docs, folder)
        assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter({(1, a): 1, (None, b): 1, (3, None): 1}), name
        assert got.columns == docs.columns
    # the smallest id names two texts, both near copies of a third: one row stays
    near = [(1, a), (1, a + "x "), (2, a + "x y ")]
    docs = spark.createDataFrame([(k, text, "en", "s", 1) for k, text in near], COLUMNS)
    assert [r.doc_id for r in STAGES["near_dedup"](spark, docs, folder).collect()] == [1]


def test_language_keeps_letters_where_nothing_is_learned(spark, folder):
    rows = [(1, "Some words."), (2, "12 34"), (3, None), (4, ""), (5, "é")]
    docs = spark.createDataFrame([(k, text, None, "s", 1) for k, text in rows], COLUMNS)
    assert {r.doc_id for r in STAGES["language"](spark, docs, folder).collect()} == {1, 5}


def test_run_applies_the_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = corpus_pipeline.run(spark, folder)
    assert Counter(rows_of(got.drop("sequence_id", "offset"))) == Counter(rows_of(docs.drop("sequence_id", "offset")))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = STAGES["language"](spark, STAGES["quality"](spark, docs, DATA), DATA)
    good = docs.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()
