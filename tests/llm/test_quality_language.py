from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarline.llm import langid, quality
from cellarline.llm.queries import llm_queries
from tests.conftest import DATA
from tests.llm.helpers import AWKWARD, documents, prose


def test_tree_rules_and_lasso_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.3)).astype(float)
    model = quality.fit_rules(x, y)
    total = model.intercept + quality.rule_matrix(list(model.rules), x) @ np.array(model.weights)
    assert ((total > 0) == (y > 0)).mean() > 0.98
    assert 0 < len(model.rules) < 80


def test_penalty_makes_weights_zero():
    rng = np.random.default_rng(2)
    x = (rng.random((500, 6)) > 0.5).astype(float)
    y = x[:, 0]
    weights, _ = quality.lasso_logistic(x, y, 0.02)
    assert weights[0] > 1 and np.abs(weights[1:]).max() < 0.1
    assert np.abs(quality.lasso_logistic(x, y, 10.0)[0]).max() == 0


def test_compiled_rules_agree_with_numpy(spark):
    model = quality.RuleModel((((0, True, 1.0), (4, False, 0.2)), ((5, True, 0.0),)), (1.5, -2.0), 0.25)
    rows = quality.with_statistics(documents(spark, AWKWARD)).select("stats").collect()
    x = np.array([r["stats"] for r in rows])
    want = 1 / (1 + np.exp(-(0.25 + quality.rule_matrix(list(model.rules), x) @ np.array([1.5, -2.0]))))
    got = [r["score"] for r in quality.score(documents(spark, AWKWARD), model).collect()]
    assert np.allclose(got, want)
    assert np.isfinite(x).all()


def test_without_labels_or_with_one_class(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, None), (None, 0), (4, 7)], "doc_id long, quality int")
    assert quality.fit(docs, labels.where("false")) == quality.RuleModel((), (), 0.0)
    scores = [r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()]
    assert len(scores) == len(AWKWARD) and min(scores) > 0.99
    assert quality.score(docs.where("false"), quality.RuleModel((), (), 0.0)).count() == 0


def test_sample_is_bounded_and_does_not_hang_on_order(spark):
    docs = documents(spark, [(i, prose(i, 30) + ("!!" if i % 3 else "")) for i in range(300)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    one = quality.fit(docs, labels, sample_rows=100)
    assert one == quality.fit(docs.orderBy(F.desc("doc_id")), labels, sample_rows=100)


def test_held_out_quality(spark):
    got = llm_queries()["op1_quality"](spark, DATA).toPandas()
    labels = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]).all()
    held = got.merge(labels, on="doc_id")
    held = held[held["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.85


ENGLISH = ["the cat sat on the mat and the dog was there with them", "where is the house that they have seen"]
GERMAN = ["der hund und die katze sind nicht in dem haus", "ich habe das nicht gesehen und er auch nicht"]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(t, "en") for t in ENGLISH] + [(t, "de") for t in GERMAN] + [(None, "fr"), ("text", None)]
    return langid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_counts_match_brute_force(model):
    assert model.languages == ("de", "en")
    counts = np.zeros((1 << 15, 2))
    for column, texts in enumerate((GERMAN, ENGLISH)):
        for text in texts:
            for _, buckets, _ in langid.gram_buckets([text], model.orders, 15):
                np.add.at(counts[:, column], buckets, 1)
    smooth = counts + 0.5
    assert np.allclose(model.log_prob, np.log(smooth / smooth.sum(axis=0)))
    assert np.allclose(model.log_prior, np.log([0.5, 0.5]))


def test_predictions_and_unknown(spark, model):
    rows = [(1, "the dog is there"), (2, "die katze ist nicht"), (3, None), (4, ""), (5, "12 34 --"), (2, "die katze ist nicht")]
    got = langid.identify(documents(spark, rows), model).collect()
    assert [(r["id"], r["lang_pred"]) for r in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (2, "de")]
    assert all(0 <= r["score"] <= 1 for r in got) and got[2]["score"] == 0
    alone = [langid.score_texts(model, [t])[1][0] for _, t in rows]
    assert np.allclose(alone, [r["score"] for r in got])


def test_only_letters_make_a_language(model):
    assert langid.score_texts(model, ["²", "½ 3", "Ⅳ", "_ 7", "é"])[0][:4] == ["und"] * 4
    assert langid.score_texts(model, ["é"])[0] != ["und"]


def test_long_texts_in_parts(model, monkeypatch):
    texts = ["the dog " * 40, "", "die katze " * 33 + "x", "ab", "the cat sat on"]
    whole = [np.sort(b) for _, b, _ in (next(iter(langid.gram_buckets([t], model.orders, 15))) for t in texts if t)]
    names, scores = langid.score_texts(model, texts)
    for size in (1, 7, 64):
        monkeypatch.setattr(langid, "CHUNK", size)
        parts = [np.sort(np.concatenate([b for _, b, _ in langid.gram_buckets([t], model.orders, 15)])) for t in texts if t]
        assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
        again = langid.score_texts(model, texts)
        assert again[0] == names and np.allclose(again[1], scores)


def test_clashing_names_of_scores(spark):
    docs = documents(spark, [(1, "some text here"), (2, None)]).withColumn("_statistics_of_text", F.lit("clash"))
    rules = quality.RuleModel((), (), 0.5)
    got = quality.score(docs, rules, name="_score")
    assert got.columns == [*docs.columns, "_score"] and {r["_statistics_of_text"] for r in got.collect()} == {"clash"}
    with pytest.raises(ValueError):
        quality.score(docs, rules, name="k")


def test_nothing_to_learn_from(spark):
    empty = langid.learn(documents(spark, []))
    assert {r["lang_pred"] for r in langid.identify(documents(spark, AWKWARD), empty).collect()} == {"und"}
    with pytest.raises(ValueError):
        many = spark.range(40).selectExpr("concat('l', id) AS lang", "'abc' AS text")
        langid.LARGEST_MATRIX, kept = 10, langid.LARGEST_MATRIX
        try:
            langid.learn(many)
        finally:
            langid.LARGEST_MATRIX = kept


def test_held_out_languages(spark):
    got = llm_queries()["op10_language"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got.merge(docs, on="doc_id")
    held = held[held["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.9
