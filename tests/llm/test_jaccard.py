import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import jaccard, shingles
from twinsift.llm.graph import components
from twinsift.llm.queries import OP7_SQL

from .conftest import ODD_TEXTS, WORDS, plain_shingles, plain_words


def brute(texts):
    """(set sizes, smallest linked index) of each text."""
    sets = [plain_shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def check(docs, texts, **settings):
    sizes, roots = brute(texts)
    rows = {r["doc_id"]: r for r in jaccard.near_duplicates(docs, **settings).collect()}
    assert [rows[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [rows[i]["component_id"] for i in range(len(texts))] == roots


def edited(words, rate, chance):
    return [chance.choice(WORDS) + str(chance.randrange(999)) if chance.random() < rate else w for w in words]


def corpus(seed):
    """Families of near copies at many distances, a passage in many texts, exact copies, short and junk texts."""
    chance = random.Random(seed)
    fresh = lambda n: [f"{chance.choice(WORDS)}{chance.randrange(500)}" for _ in range(n)]
    passage, texts = fresh(40), []
    for _ in range(6):
        base = fresh(chance.randrange(8, 160))
        texts += [" ".join(edited(base, chance.choice([0, 0.01, 0.03, 0.06, 0.1, 0.2]), chance)) for _ in range(chance.randrange(2, 14))]
        texts += [" ".join(base[: int(len(base) * 0.8)]), "\n".join(base).upper()]
    texts += [" ".join(fresh(30) + passage + fresh(chance.randrange(60))) for _ in range(12)]
    texts += ["word " * n for n in (1, 4, 5, 6, 50)] + ["a b c", "A  b\tc", "a b c d"]
    chance.shuffle(texts)
    return texts


def test_like_brute_force(documents):
    texts = [*corpus(0), *corpus(1), *corpus(2)]
    check(documents(texts), texts)


def test_like_brute_force_without_helpful_grouping(documents, monkeypatch):
    """The result doesn't depend on minimum hashes, groups, blocks or frequent tokens."""
    monkeypatch.setattr(jaccard, "GROUP_PERCENT", 101)
    monkeypatch.setattr(jaccard, "FREQUENT_COUNT", 1)
    texts = corpus(9)
    check(documents(texts), texts)


def test_blocks(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "QUERY_BLOCK", 2)
    monkeypatch.setattr(jaccard, "MEMBER_BLOCK", 3)
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 50)
    texts = corpus(4)
    check(documents(texts), texts)


def test_odd_texts(documents):
    texts = [*ODD_TEXTS, "a b", "A B", "a\x0bb", "a b"]
    check(documents(texts), texts)


def test_keep_one(documents):
    text, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    docs = documents([text, text, other, other, text + " x", None, None, "", "lone"], [4, 3, 8, 8, 2, 10, None, None, 12])
    kept = jaccard.keep_one(docs, jaccard.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(["2", "8", "10", "12", "None", "None"])


def test_keep_one_where_ids_are_repeated_or_null(documents):
    a, b, c, d = (" ".join(f"{letter}{i}" for i in range(50)) for letter in "abcd")
    docs = documents([a, b, a + " x", c, c, d, d, d + " y", "", "", b, "lone"], [5, 5, 5, None, None, None, 9, None, 6, 6, 7, 8])
    kept = jaccard.keep_one(docs, jaccard.near_duplicates(docs))
    rows = [(r["doc_id"], r["text"].removesuffix(" x")) for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(rows, key=str) == sorted([(5, a), (5, b), (None, c), (9, d), (6, ""), (6, ""), (8, "lone")], key=str)


def test_ids_and_empty_tables(documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = jaccard.near_duplicates(documents([text, text, text, None, ""], [7, 7, None, None, 3])).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str) == sorted([(7, 7), (7, 7), (None, 7), (None, None), (3, 3)], key=str)
    assert jaccard.near_duplicates(documents([])).count() == 0


def test_like_sql(spark, documents):
    import duckdb

    texts = [*corpus(2), *(t for t in ODD_TEXTS if len(t or "") < 1000)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, t in enumerate(texts)])
    found = jaccard.near_duplicates(documents(texts)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({OP7_SQL})").fetchall())


def test_token_union():
    members = [{1, 5, 9, 2**63 + 7}, {5, 9}, {9, 11}, {100}]
    arrays = [np.array(sorted(m), dtype=np.uint64) for m in members]
    first = jaccard.token_union([(a, None) for a in arrays[:3]])
    tokens, counts = jaccard.token_union([first, (arrays[3], None)])
    assert tokens.tolist() == sorted(set().union(*members)) and counts.tolist() == [sum(t in m for m in members) for t in tokens.tolist()]
    assert [len(x) for x in jaccard.token_union([(np.zeros(0, dtype=np.uint64), None)])] == [0, 0]


@pytest.mark.parametrize("slice_tokens", [30, 10_000])
def test_matrix_and_bounds(spark, monkeypatch, slice_tokens):
    """Unions, counts, shared tokens and overlaps are those of plain sets, however a group is sliced."""
    monkeypatch.setattr(jaccard, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(jaccard, "ASKED_TOKENS", slice_tokens)
    chance = random.Random(3)
    pool = [chance.randrange(1 << 64) for _ in range(300)]
    own = {cid: set(chance.sample(pool[:120] if cid < 8 else pool[100:], 40)) for cid in range(20)}
    wide = lambda cid: cid + (1 << 62)  # noqa: E731  too wide for a floating number
    blob = lambda s: bytearray(np.array(sorted(s), dtype=np.uint64).tobytes())
    group = lambda cid: 0 if cid < 8 else 8
    sets = spark.createDataFrame([(wide(cid), blob(s)) for cid, s in own.items()] + [(wide(50), blob(pool[90:110])), (wide(51), blob(pool[280:]))], "cid long, tokens binary")
    grouped = spark.createDataFrame([(wide(cid), blob(s), group(cid), len(s)) for cid, s in own.items()], "cid long, tokens binary, group long, n long")
    unions = jaccard._matrix(grouped)
    rows = unions.collect()
    for g in (0, 8):
        mine = [s for cid, s in own.items() if group(cid) == g]
        got = {int(t): int(n) for r in rows if r["group"] == g for t, n in zip(np.frombuffer(r["tokens"], "u8"), np.frombuffer(r["counts"], "<u4"), strict=True)}
        assert got == {t: sum(t in s for s in mine) for t in set().union(*mine)}
    common = {r["cid"]: r["overlap"] for r in jaccard._overlaps(grouped, unions, shared=True).collect()}
    assert common == {wide(cid): len(s & set().union(*(o for c, o in own.items() if c != cid and group(c) == group(cid)))) for cid, s in own.items()}
    asked = spark.createDataFrame([(wide(c), g) for c in (50, 51) for g in (0, 8)], "cid long, group long").join(sets, "cid")
    union_of = {g: set().union(*(s for cid, s in own.items() if group(cid) == g)) for g in (0, 8)}
    want = {(wide(c), g): len(s & union_of[g]) for c, s in ((50, set(pool[90:110])), (51, set(pool[280:]))) for g in (0, 8)}
    assert {(r["cid"], r["group"]): r["overlap"] for r in jaccard._overlaps(asked, unions, shared=False).collect()} == want and len(set(want.values())) > 2


def test_queries_to_groups(documents, monkeypatch):
    """Classes that grouping misses are found through a group's union."""
    monkeypatch.setattr(jaccard, "KEYS", 1)
    texts = corpus(5) + corpus(6)
    check(documents(texts), texts)


def test_hot_nodes(spark, monkeypatch):
    from twinsift.llm import graph

    monkeypatch.setattr(graph, "LEAST_HOT", 3)
    pairs = [(0, i) for i in range(1, 60)] + [(99, i) for i in range(61, 98)] + [(5, 61), (200, 201), (201, 202)]
    for order in (pairs, [(b, a) for a, b in pairs], [(300 - a, 300 - b) for a, b in pairs]):
        found = dict(map(tuple, components(spark.createDataFrame(order, "u long, v long")).collect()))
        big = {x for pair in order[:-2] for x in pair}
        small = {x for pair in order[-2:] for x in pair}
        assert found == {x: min(big) for x in big} | {x: min(small) for x in small}


def test_components_by_part(spark):
    pairs = [(0, 1, 0), (1, 2, 0), (1, 2, 1), (5, 6, 1), (2, 5, 0)]
    found = {(r["part"], r["node"]): r["root"] for r in components(spark.createDataFrame(pairs, "u long, v long, part int"), "part").collect()}
    assert found == {(0, 0): 0, (0, 1): 0, (0, 2): 0, (0, 5): 0, (1, 1): 1, (1, 2): 1, (1, 5): 5, (1, 6): 5}


def test_bitmap(spark):
    from twinsift.llm.bitmap import bitmap_of, rows_that_may_hold

    values = [0, -1, 7, 1 << 62, -(1 << 63), *range(1000, 3000)]
    made = bitmap_of(spark.createDataFrame([(v,) for v in values] + [(None,)], "x long"))
    assert made.may_hold(np.array(values)).all()
    others = np.arange(10_000, 60_000)
    assert made.may_hold(others).mean() < 0.03 and not bitmap_of(spark.createDataFrame([], "x long")).may_hold(others).any()
    rows = spark.createDataFrame([(7, "a"), (None, "b"), (8_888_888, "c")], "x long, text string")
    bits = spark.sparkContext.broadcast(made)
    assert {r["text"] for r in rows_that_may_hold(rows, "x", bits, True).collect()} - {"c"} == {"a", "b"}
    assert {r["text"] for r in rows_that_may_hold(rows, "x", bits, False, null_hits=False).collect()} - {"c"} == {"b"}


sets_of_tokens = st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True)


@settings(max_examples=300)
@given(sets_of_tokens, st.data())
def test_linked_sets_share_a_prefix_key(base, data):
    drop = data.draw(st.integers(0, len(base) // 4))
    more = data.draw(st.lists(st.integers(0, 2**64 - 1), max_size=len(base) // 3, unique=True))
    one, two = set(base), set(base[drop:]) | set(more)
    if one == two or not two or 100 * len(one & two) < 75 * len(one | two):
        return
    frequent = np.array(sorted(data.draw(st.sets(st.sampled_from(base)))), dtype=np.uint64)
    keys = []
    for own in (one, two):
        own = np.array(sorted(own), dtype=np.uint64)
        found, _, index = jaccard.neighbour_keys(own, np.array([len(own)]), 75, frequent)
        keys.append({k: i for k, i in zip(found.tolist(), index.tolist(), strict=True)})
    smaller = keys[0] if len(one) <= len(two) else keys[1]
    assert any(smaller[k] for k in keys[0].keys() & keys[1].keys())


def test_word_hashes_match_words():
    texts = [*ODD_TEXTS, "A b", "a B", "x" * 1_200_000 + " y " + "z" * 10, "tail " * 300_000]
    for _ in range(2):
        values, at = {}, 0
        for first, end, words, counts in shingles.slabs(pa.array(texts)):
            assert first == at
            for text, own in zip(texts[first:end], np.split(words, np.cumsum(counts)[:-1]), strict=True):
                want = plain_words(text)
                assert len(want) == len(own)
                for word, value in zip(want, own.tolist(), strict=True):
                    assert values.setdefault(word, value) == value
            at = end
        assert at == len(texts) and len(set(values.values())) == len(values)


@pytest.mark.parametrize("size", [shingles.SLAB_BYTES - 1, shingles.SLAB_BYTES, shingles.SLAB_BYTES + 1, shingles.SLAB_BYTES + 5, 2 * shingles.SLAB_BYTES])
def test_words_as_long_as_a_slab(size):
    word = "q" * size
    found = [np.concatenate([words for _, _, words, _ in shingles.slabs(pa.array([text]))]).tolist() for text in (word, word + " ", " " + word, word + " a", "a " + word + "\n")]
    assert len({own[0] if len(own) == 1 or i == 3 else own[1] for i, own in enumerate(found)}) == 1


def test_block_links():
    chance = np.random.default_rng(3)
    rows = [(i, i % 3, np.unique(chance.integers(0, 40, 30).astype(np.uint64))) for i in range(40)]
    want = {(a, b) for a, ca, x in rows[:10] for b, cb, y in rows if ca != cb and 100 * len(np.intersect1d(x, y)) >= 40 * len(np.union1d(x, y))}
    assert set(jaccard.block_links(rows[:10], rows, 40)) == want and want


def test_components(spark):
    chance = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(chance.randrange(100, 160), chance.randrange(100, 160)) for _ in range(40)] + [(7, 7), (-5, 3)]
    root = {n: n for p in pairs for n in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert found == {n: find(n) for n in root}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
