import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import packing

from .conftest import ODD_TEXTS


def contract():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


CONTRACT = contract()


def reference_ids(text):
    return CONTRACT.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_contracts():
    texts = [t for t in ODD_TEXTS if t is None or len(t) < 1000] + ["<|endoftext|> don't  stop\n\n  x", "größer, señor; l'été 1234567", "a" * 2000, " " * 500 + "x"]
    for text in texts:
        assert packing.token_ids(text).tolist() == reference_ids(text)


PIECES = st.sampled_from([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u180e", "\u200b", "\u2003", "\u3000", "a", "B", "é", "ß", "ÿ", "÷", "日本", "1", "23", "²", "'", "'s", "'ll", "don't", ".", "!?", "_", "<|endoftext|>", "<|", "\U0001f600", "\u0301", "\ufeff", "\x00"])


@settings(max_examples=300)
@given(st.lists(st.lists(PIECES, max_size=14).map("".join) | st.text(max_size=30), max_size=5))
def test_cut_texts_have_the_ids_of_whole_ones(texts):
    assert [ids.tolist() for ids in packing.encoder().many(pa.array(texts, pa.string()))] == [reference_ids(text) for text in texts]


SEAMS = st.sampled_from(["a", "Bc", "é", "É", "×", "÷", "ÿ", "À", "ã", "1", "90", "'", "'s", "'LL", "'é", ".", "~", "\n", "\n\n", "\t", " ", "\x00", "\u0301", "Ā", "²", "日", "İ"])


@settings(max_examples=500)
@given(st.lists(st.lists(SEAMS, max_size=10).map("".join), max_size=4))
def test_seams_between_kinds_of_characters(texts):
    assert [ids.tolist() for ids in packing.encoder().many(pa.array(texts, pa.string()))] == [reference_ids(text) for text in texts]


def test_words_are_shared_by_texts_that_join_them(monkeypatch):
    own, words, learned = packing.Encoder("byte_bpe_50k"), [f"w{chr(97 + i)}{chr(122 - i)}" for i in range(20)], []
    monkeypatch.setattr(own, "_learn", lambda some, learn=own._learn: (learned.extend(some), learn(some)))
    texts = [f"{a}{mark}{b}" for a in words for b in words for mark in ("\n", ",", "7", ".\n")]
    assert [ids.tolist() for ids in own.many(pa.array(texts))] == [reference_ids(text) for text in texts]
    assert len(learned) == len(set(learned)) <= len(words) + 4


def test_given_texts_have_the_contracts_ids(spark):
    path = Path("/root/testdata/sf0.001/documents.parquet")
    path.exists() or pytest.skip("needs the given tables")
    texts = [r["text"] for r in spark.read.parquet(str(path)).select("text").collect()]
    assert [ids.tolist() for ids in packing.encoder().many(pa.array(texts, pa.string()))] == [reference_ids(t) for t in texts]


def test_a_full_store_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_PARTS", 3)
    monkeypatch.setattr(packing, "TEXTS_AT_ONCE", 2)
    texts = ["one two three, four five six.", "four five six. seven eight", "one two", None]
    assert [ids.tolist() for _ in range(3) for ids in packing.encoder().many(pa.array(texts, pa.string()))] == [reference_ids(t) for t in texts] * 3


def first_fit(lengths, capacity):
    free, bins, offsets = [], [], []
    for length in lengths:
        at = next((i for i, f in enumerate(free) if f >= length), len(free))
        if at == len(free):
            free.append(capacity)
        bins.append(at)
        offsets.append(capacity - free[at])
        free[at] -= length
    return bins, offsets


@given(st.lists(st.integers(1, 50), max_size=80))
def test_first_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.first_fit_decreasing(lengths, 50) == first_fit(lengths, 50)


def test_whole_texts_are_packed_once(documents):
    texts = [*ODD_TEXTS, "same text here", "same text here"] + [f"document number {i} " * (i % 40 + 1) for i in range(200)]
    ids = [*range(len(texts) - 1), None]
    frame = packing.pack(documents(texts, ids), group_pieces=64).toPandas()
    text_of = dict(zip([-1 if i is None else i for i in ids], texts, strict=True))
    for doc_id, own in frame.fillna({"doc_id": -1}).groupby("doc_id"):
        want = np.array(reference_ids(text_of[int(doc_id)]) if len(text_of[int(doc_id)] or "") < 1000 else packing.token_ids(text_of[int(doc_id)]), dtype="<u4")
        own, at = own.sort_values("start"), 0
        for row in own.itertuples():
            assert row.start == at and 0 < row.length <= packing.CAPACITY and row.doc_tokens == len(want)
            assert row.ids_crc32 == zlib.crc32(want[at : at + row.length].tobytes())
            at += row.length
        assert at == len(want)
    assert frame["doc_id"].isna().sum() >= 1
    for _, own in frame.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
        total = own["length"].sum()
        assert total <= packing.CAPACITY and (own["sequence_tokens"] == total).all()
        assert (own["padded_to"] == (total if total & (total - 1) == 0 else packing.CAPACITY)).all()


def test_repeated_rows_and_empty_tables(documents):
    assert packing.pack(documents(["x y z"] * 5, [7] * 5)).count() == 5
    assert packing.pack(documents([])).count() == 0


def test_documents_are_whole_in_a_group_and_equal_rows_spread(documents):
    long = "many words of one long text " * 3000
    texts = ["same words"] * 300 + [long] * 3
    rows = packing.pack(documents(texts, [7] * 300 + [8] * 3), group_pieces=20).toPandas()
    groups = rows["sequence_id"] // (1 << 32)
    assert groups[rows["doc_id"] == 7].value_counts().max() < 60 and groups[rows["doc_id"] == 7].nunique() >= 10
    pieces = -(-int(rows["doc_tokens"].max()) // packing.CAPACITY)
    by_group = Counter(groups[rows["doc_id"] == 8])
    assert pieces > 5 and all(n % pieces == 0 for n in by_group.values()) and sum(by_group.values()) == 3 * pieces


def test_sparing_gives_the_same_pieces(documents):
    docs = documents([*ODD_TEXTS, *(f"words, of text{i}\nand more " * i for i in range(300))])
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(packing.pack(docs, sparing=True).select(*columns).collect(), key=str) == sorted(packing.pack(docs).select(*columns).collect(), key=str)


def test_little_padding(documents):
    texts = [f"some words of a text {i} " * (1 + i * 37 % 400) for i in range(600)]
    frame = packing.pack(documents(texts)).toPandas()
    assert frame["length"].sum() / (frame["sequence_id"].nunique() * packing.CAPACITY) > 0.97


def test_added_tokens_like_the_contract(documents):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>\n\n y<|endoftext|", "no added token  here"]
    want = [CONTRACT.encode(text, add_special_tokens=False).ids + [1] for text in texts]
    assert len(want[0]) == 5 and 50256 in want[0]
    assert [packing.token_ids(text).tolist() for text in texts] == want
    rows = packing.pack(documents(texts)).collect()
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in rows} == {i: (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for i, ids in enumerate(want)}
