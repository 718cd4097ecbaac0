from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinsift.llm import language
from twinsift.llm.queries import op10_language_bloom

from .conftest import ODD_TEXTS

SAMPLES = {"en": "the cat and the dog were with them in this house", "de": "der hund und die katze sind nicht in einem haus", "fr": "le chien et la maison sont avec les enfants dans"}


def grams(text):
    """Plain n-grams of one text."""
    data = bytes(language._LETTERS[b] for b in (text or "").lower().encode())
    return [int.from_bytes(data[i : i + 4], "little") for i in range(len(data) - 3) if data[i : i + 2] != b"  "]


def test_grams_like_plain_ones():
    texts = [*ODD_TEXTS, "z" * 1_100_000 + "é", "Ünïcode, ok?"]
    found = {i: Counter() for i in range(len(texts))}
    for first, _, values, owner in language._grams(pa.array(texts)):
        for text in np.unique(owner):
            found[first + int(text)].update(values[owner == text].tolist())
    for i, text in enumerate(texts):
        assert found[i] == Counter(grams(text))


def small_filter():
    rows = [(name, g, n) for name, text in SAMPLES.items() for g, n in Counter(grams(text)).items()]
    return language.build_filter(pd.DataFrame(rows, columns=["lang", "gram", "n"]), dict.fromkeys(SAMPLES, 1) | {"en": 2})


def test_no_false_negatives_and_few_false_positives():
    model = small_filter()
    for bit, name in enumerate(model.languages):
        others = Counter(g for text in SAMPLES.values() for g in grams(text))
        own = [g for g in grams(SAMPLES[name]) if others[g] == grams(SAMPLES[name]).count(g)]
        assert own and ((model.masks(np.array(own, dtype=np.uint32)) >> np.uint8(bit)) & 1).all()
    random = np.random.default_rng(1).integers(0, 2**32, 100_000, dtype=np.uint64).astype(np.uint32)
    assert (model.masks(random) > 0).mean() < 0.01


def test_predictions_and_odd_texts():
    model = small_filter()
    names, scores = model.predict(pa.array([*SAMPLES.values(), None, "", "123 !?", "qqqq xxxx", "a", "一二三"]))
    assert names == [*SAMPLES, "und", "und", "und", "en", "en", "en"]
    assert (scores[:3] > 0.8).all() and (scores[3:] == 0).all()
    none = language.build_filter(pd.DataFrame({"lang": [], "gram": [], "n": []}), {})
    assert none.predict(pa.array(["abc", None]))[0] == ["und", "und"]


def test_training_and_filter_over_tables(spark, documents):
    texts = [SAMPLES[name] + f" {i}" for i in range(30) for name in SAMPLES]
    langs = list(SAMPLES) * 30
    docs = documents(texts).drop("lang").join(spark.createDataFrame(list(enumerate(langs)), "doc_id long, lang string"), "doc_id")
    docs = docs.unionByName(documents(ODD_TEXTS, [None] * len(ODD_TEXTS), None).select(*docs.columns))
    model = language.train(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 2)
    rows = language.identify(docs, model).collect()
    assert len(rows) == docs.count() and all(r["lang_pred"] == r["lang"] for r in rows if r["doc_id"] is not None)
    docs = docs.unionByName(documents(["qxq wxw zxz jxj kxk vxv yxy uxu " * 5, "zq"], [500, 501], None).select(*docs.columns))
    kept = language.only_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {*range(90), 501}
    assert language.identify(docs.limit(0), model).count() == 0
    assert language.train(docs.limit(0), F.lit(True)).languages == []


def test_query_on_the_given_tables(spark):
    path = "/root/testdata/sf0.01"
    Path(path).exists() or pytest.skip("needs the given tables")
    rows = op10_language_bloom(spark, path).join(spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.99


def plain_judgement(frame, texts_of, texts):
    """(language, score) of each text by sets of slots, counted n-gram by n-gram."""
    rates, names = {}, sorted(texts_of)
    for name in names:
        own = {int(g): int(n) for lang, g, n in frame if lang == name}
        rates[name] = {g: n / sum(own.values()) for g, n in own.items()}
    slots = lambda gram: [((gram + 1) * int(m) % (1 << 64)) >> (64 - language.SLOTS.bit_length() + 1) for m in language._HASHES[: language.HASHES]]
    held = {}
    for name in names:
        typical = [g for g, r in rates[name].items() if r * language.MAX_RATIO >= max(rates[o].get(g, 0) for o in names)]
        picked = sorted(typical, key=lambda g: (-rates[name][g], g))[: language.GRAMS_PER_LANGUAGE]
        held[name] = {at for g in picked for at in slots(g)}
    wrong = {name: (len(held[name]) / language.SLOTS) ** language.HASHES for name in names}
    out = []
    for text in texts:
        if not any(c.isalpha() for c in text or ""):
            out.append(("und", 0.0))
            continue
        seen = grams(text)
        counts = {n: max(0.0, (sum(all(at in held[n] for at in slots(g)) for g in seen) - len(seen) * wrong[n]) / (1 - wrong[n])) for n in names}
        best = sorted(names, key=lambda n: (-counts[n], n))[:2]
        top, next_one = counts[best[0]], counts[best[1]] if len(best) > 1 else 0.0
        out.append((best[0], top / (top + next_one)) if top > 0 else (max(names, key=lambda n: (texts_of[n], n)), 0.0))
    return out


def test_like_a_plain_filter(spark):
    """The filter, its corrected counts and the decisions against sets and loops over the given texts."""
    path = "/root/testdata/sf0.001/documents.parquet"
    Path(path).exists() or pytest.skip("needs the given tables")
    docs = spark.read.parquet(path)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    learned = [r for r in rows if r[0] % 4 != 2 and r[2] is not None]
    tally = Counter((lang, g) for _, text, lang in learned for g in grams(text))
    frame = [(lang, g, n) for (lang, g), n in tally.items() if n > 1]
    texts = [text for _, text, _ in rows if len(text or "") < 20_000] + [t for t in ODD_TEXTS if len(t or "") < 1000]
    want = plain_judgement(frame, Counter(lang for _, _, lang in learned), texts)
    model = language.train(docs, F.col("doc_id") % 4 != 2)
    names, scores = model.predict(pa.array(texts))
    assert names == [name for name, _ in want] and np.allclose(scores, [score for _, score in want])


def test_equal_votes_go_to_the_smaller_name():
    text = "abcdef ghijkl"
    rows = [(name, g, n) for name in ("zz", "aa", "mm") for g, n in Counter(grams(text)).items()]
    model = language.build_filter(pd.DataFrame(rows, columns=["lang", "gram", "n"]), {"zz": 3, "aa": 1, "mm": 2})
    names, scores = model.predict(pa.array([text]))
    assert names == ["aa"] and abs(scores[0] - 0.5) < 0.01


def test_more_languages_than_bits_of_a_word():
    words = {f"l{i:03}": " ".join("".join(chr(97 + (i * 7 + j * k * 5 + i // 26 * j) % 26) for j in range(6)) for k in range(1, 6)) for i in range(150)}
    rows = [(name, g, n) for name, text in words.items() for g, n in Counter(grams(text)).items()]
    model = language.build_filter(pd.DataFrame(rows, columns=["lang", "gram", "n"]), dict.fromkeys(words, 1))
    assert model.languages == sorted(words) and model.slots.shape[0] == 3
    assert model.predict(pa.array(list(words.values())))[0] == list(words)


def test_rare_languages_are_learned(spark, documents, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 10)
    monkeypatch.setattr(language, "LEAST_TEXTS", 5, raising=False)
    rare = "кошка и собака были с ними в этом доме"
    docs = documents([SAMPLES["en"] + f" {i}" for i in range(400)]).select("doc_id", "text", "lang")
    docs = docs.unionByName(documents([rare, rare + " да", rare + " нет"], [1000, 1001, 1002], "ru").select("doc_id", "text", "lang"))
    model = language.train(docs, F.lit(True))
    assert model.languages == ["en", "ru"] and model.default == "en"
    assert model.predict(pa.array([rare, SAMPLES["en"]]))[0] == ["ru", "en"]
    assert language.only_identified(docs, model).count() == 403
