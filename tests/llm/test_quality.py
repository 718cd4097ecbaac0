import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift.llm import quality
from twinsift.llm.queries import op5_bradley_terry

from .conftest import ODD_TEXTS, WORDS, plain_words


def test_features_of_odd_texts():
    rows = quality.features(pa.array(ODD_TEXTS))
    assert rows.shape == (len(ODD_TEXTS), len(quality.FEATURES)) and np.isfinite(rows).all()
    assert (rows[0] == rows[1]).all()
    again = quality.features(pa.array(["before"] + ODD_TEXTS)).tolist()
    assert again[1:] == rows.tolist()


def test_pairs_decide():
    random = np.random.default_rng(0)
    good = random.random(1500) < 0.8
    rows = random.standard_normal((1500, len(quality.FEATURES)))
    rows[:, 2] += np.where(good, 2.0, -2.0)
    model = quality.fit(rows[:1000], good[:1000])
    scores = model.score(rows[1000:])
    assert ((scores >= 0.5) == good[1000:]).mean() > 0.95 and model.weights[2] == max(model.weights)
    assert abs((model.score(rows[:1000]) >= 0.5).mean() - good[:1000].mean()) < 0.01
    for labels in (np.ones(1500, bool), np.zeros(1500, bool)):
        assert (quality.fit(rows, labels).score(rows) == 0.5).all()


def test_all_pairs_count():
    random = np.random.default_rng(1)
    good = random.random(2500) < 0.7
    rows = random.standard_normal((2500, len(quality.FEATURES))) + np.where(good, 0.4, -0.4)[:, None] * np.arange(len(quality.FEATURES)) / 10
    model = quality.fit(rows, good)
    scaled = np.clip((rows - rows.mean(axis=0)) / rows.std(axis=0), -8, 8)
    strength = scaled @ model.weights
    lost = 1 / (1 + np.exp(strength[good][:, None] - strength[~good][None]))
    slope = (lost.sum(axis=1) @ scaled[good] - lost.sum(axis=0) @ scaled[~good]) / lost.size - quality.RIDGE * model.weights
    assert np.abs(slope).max() < 1e-4
    assert (model.score(rows) >= 0.5).sum() == good.sum() and np.isclose(model.scale, strength.std())


def test_a_threshold_among_many_equal_strengths(monkeypatch):
    monkeypatch.setattr(quality, "NEAR", 50)
    random = np.random.default_rng(2)
    good = random.random(5000) < 0.6
    rows = np.round(random.standard_normal((5000, 2))) + good[:, None]
    model = quality.fit(rows, good)
    bound = np.sort(model.strength(rows))[(~good).sum()]
    assert abs(model.threshold - bound) < 1e-8 and model.threshold <= bound


def test_all_labelled_rows_are_learned_from(spark, documents):
    texts = [f"{'A' * (i % 7)} word {'x' * (i % 11)}{'.' * (i % 3)}" for i in range(7000)]
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(0, 7000)], "doc_id long, quality int")
    model = quality.train(documents(texts), labels, F.col("doc_id") % 8 != 1)
    rows = quality.features(pa.array(texts))[np.arange(7000) % 8 != 1]
    good = (np.arange(7000) % 5 > 0)[np.arange(7000) % 8 != 1]
    assert np.allclose(model.centre, rows.mean(axis=0), atol=1e-8) and np.allclose(model.width, np.maximum(1e-6, rows.std(axis=0)), atol=1e-6)
    same = quality.fit(rows, good)
    assert np.allclose(model.weights, same.weights, atol=1e-6) and np.isclose(model.threshold, same.threshold, atol=1e-6)


def table(spark):
    random = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(400):
        words = [WORDS[j] for j in random.integers(0, len(WORDS), 60)]
        bad = i % 4 == 0
        texts.append("!! ".join(w.upper() for w in words) if bad else " ".join(words) + ".")
        labels.append((i, int(not bad)))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out(spark, documents):
    texts, labels = table(spark)
    docs = documents(texts)
    model = quality.train(docs, labels, F.col("doc_id") % 3 != 1)
    rows = quality.score(docs, model).collect()
    held = [r for r in rows if r["doc_id"] % 3 == 1]
    assert np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 != 0) for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_defined_cases(spark, documents):
    texts, labels = table(spark)
    model = quality.train(documents(texts), labels.union(labels).union(spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")), F.lit(True))
    rows = quality.score(documents([*ODD_TEXTS, "same", "same"], [*range(len(ODD_TEXTS)), 70, 70]), model).collect()
    assert len(rows) == len(ODD_TEXTS) + 2 and len({r["score"] for r in rows if r["doc_id"] == 70}) == 1
    assert quality.score(documents([]), model).count() == 0
    empty = quality.train(documents([]), labels.limit(0), F.lit(True))
    assert [r["score"] for r in quality.score(documents(["a"]), empty).collect()] == [0.5]


def plain_features(text):
    """The features of one text, character by character."""
    data, words = (text or "").encode(), plain_words(text)
    size, number = max(1, len(data)), max(1, len(words))
    count = lambda test: sum(map(test, data))
    upper, lower = count(lambda b: 65 <= b < 91), count(lambda b: 97 <= b < 123)
    digit, space, line, high, end = count(lambda b: 48 <= b < 58), data.count(b" "), count(lambda b: 9 <= b < 14), count(lambda b: b > 127), data.count(b",") + data.count(b".")
    mark = len(data) - upper - lower - digit - space - line - high - end
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [tuple(words)] * bool(words)
    letters = max(1, upper + lower)
    return [
        math.log1p(len(words)), min(20, len(data) / number), math.sqrt(upper / letters), math.sqrt(digit / size), math.sqrt(mark / size), space / size, math.sqrt(line / size), high / size, math.sqrt(end / size),
        math.log(max(1, len(set(words)))) - 0.75 * math.log(number), len(set(runs)) / max(1, len(runs)), min(3, mark / number), 1 / number, abs(upper / letters - 0.05),
    ]


def test_like_a_plain_ranking(spark, documents):
    """Features one by one, a gradient ascent on all pairs' likelihood and a sorted threshold give the same decisions."""
    texts, labels = table(spark)
    texts = [*texts, *ODD_TEXTS[:6], "Mixed, Case. 12 words\there", "é ü 一二"]
    rows = np.array([plain_features(t) for t in texts])
    assert np.allclose(quality.features(pa.array(texts)), rows)
    good = np.arange(400) % 4 != 0
    learned = rows[:400]
    centre, width = learned.mean(axis=0), np.maximum(1e-6, learned.std(axis=0))
    scaled = np.clip((rows - centre) / width, -8, 8)
    gaps = (scaled[:400][good][:, None] - scaled[:400][~good][None]).reshape(-1, rows.shape[1])
    weights = np.zeros(rows.shape[1])
    for _ in range(400):
        weights += 0.5 * ((gaps / (1 + np.exp(np.clip(gaps @ weights, -30, 30)))[:, None]).mean(axis=0) - quality.RIDGE * weights)
    strength = scaled @ weights
    bound = np.quantile(strength[:400], 1 - good.mean())
    model = quality.train(documents(texts[:400]), labels, F.lit(True))
    found = {r["doc_id"]: r for r in quality.score(documents(texts), model).collect()}
    assert np.mean([found[i]["predicted"] == int(strength[i] >= bound) for i in range(len(texts))]) > 0.97
    assert np.corrcoef(strength, [np.log(found[i]["score"] / (1 - found[i]["score"])) for i in range(len(texts))])[0, 1] > 0.9
    want = 1 / (1 + np.exp(-np.clip((np.clip((rows - model.centre) / model.width, -8, 8) @ model.weights - model.threshold) / model.scale, -30, 30)))
    assert np.allclose([found[i]["score"] for i in range(len(texts))], want)


def test_contradicting_labels_and_repeated_ids(spark, documents):
    texts, labels = table(spark)
    base = quality.train(documents(texts[1:]), labels.where("doc_id > 0"), F.lit(True))
    docs = documents([*texts, "!! A B C", "!! A B C"], [*range(400), 0, 0])
    for order in (1, 0):
        both = labels.union(spark.createDataFrame([(0, order), (0, 1 - order)], "doc_id long, quality int"))
        got = quality.train(docs, both, F.lit(True))
        again = quality.train(documents(texts[1:], range(1, 400)), labels.where("doc_id > 0"), F.lit(True))
        assert np.allclose(got.weights, again.weights) and got.threshold == again.threshold
    assert base.weights.shape == again.weights.shape
    two = quality.train(documents([*texts, "words of another text."], [*range(400), 1]), labels, F.lit(True))
    assert np.isfinite(two.weights).all()


def test_query_on_the_given_tables(spark):
    path = "/root/testdata/sf0.01"
    pytest.importorskip("pathlib").Path(path).exists() or pytest.skip("needs the given tables")
    rows = op5_bradley_terry(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
