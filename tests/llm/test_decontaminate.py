import random
import re

import numpy as np
import pytest

from twinsift.llm import decontaminate as dc

from .conftest import ODD_TEXTS, WORDS


def greedy_tiles(a, b, least):
    """Plain greedy string tiling: the length of each tile in order."""
    used_a, used_b, out = [False] * len(a), [False] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and found:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                used_a[i : i + best] = used_b[j : j + best] = [True] * best
                out.append(best)


@pytest.mark.parametrize("seed", range(60))
def test_tiles_like_plain_tiling(seed):
    chance = random.Random(seed)
    a = [chance.randrange(5) for _ in range(chance.randrange(0, 50))]
    b = [chance.randrange(5) for _ in range(chance.randrange(0, 30))]
    tiles = dc.tile(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), 3)
    for i, j, k in tiles:
        assert a[i : i + k] == b[j : j + k] and k >= 3
    covered = [x for _, j, k in tiles for x in range(j, j + k)]
    assert len(covered) == len(set(covered)) and (max((k for *_, k in tiles), default=0)) == max(greedy_tiles(a, b, 3), default=0)
    assert sorted((k for *_, k in tiles), reverse=True) == [k for *_, k in tiles]


def items(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "item_id long, text string, doc_id int")


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def fresh(chance, n):
    return " ".join(f"{chance.choice(WORDS)}{chance.randrange(300)}" for _ in range(n))


def test_like_plain_tiling_over_tables(spark, documents):
    chance = random.Random(5)
    bench = [fresh(chance, n) for n in (12, 20, 40, 40)] + ["one two three", None, "", "Dup, of dup. of dup of!"] + ["Dup, of dup. of dup of!"]
    texts = list(ODD_TEXTS)
    for item in bench[:4]:
        parts = item.split()
        half = len(parts) // 2
        texts += [f"{fresh(chance, 30)} {item.upper()}, {fresh(chance, 9)}", " ".join(parts[half:] + ["x"] * 3 + parts[:half]), f"{fresh(chance, 5)} {' '.join(parts[: half - 2])} {fresh(chance, 5)}", " ".join(parts[: half + 1]), ". ".join(parts)]
    texts += ["one two three", "dup of dup of dup of", fresh(chance, 500)]
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(bench):
            a, b = words(text), words(item)
            if len(b) >= dc.MIN_MATCH and len(a) < 2000:
                matched = sum(greedy_tiles(a, b, dc.MIN_MATCH))
                if matched >= dc.COVERAGE * len(b):
                    want[d, i] = matched
    for block_bytes in (1 << 20, 300):
        rows = dc.contamination(documents(texts), items(spark, bench), block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]): r["matched_words"] for r in rows} == want and len(want) > 12
        assert all(r["coverage"] == r["matched_words"] / r["item_words"] and r["n_tiles"] >= 1 for r in rows)


def test_filter(spark, documents):
    item = "the quick brown fox jumps over the lazy dog again and again"
    docs = documents([item, None, "", "clean text here", f"before {item} after", item], [1, 2, 3, 4, None, 1])
    kept = dc.without_contaminated(docs, items(spark, [item]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns
    assert [(r["doc_id"], r["item_id"]) for r in dc.contamination(docs.where("doc_id = 1"), items(spark, [item])).collect()] == [(1, 0)]


def test_empty_tables(spark, documents):
    assert dc.contamination(documents([]), items(spark, ["a b c d e"])).count() == 0
    assert dc.contamination(documents(["a b c d e"]), items(spark, [])).count() == 0
    assert dc.without_contaminated(documents(["a b c d e"]), items(spark, [])).count() == 1


def test_largest_coverage_of_an_id(spark, documents):
    item = " ".join(f"w{i}" for i in range(20))
    half, most = " ".join(item.split()[:12]), " ".join(item.split()[:18])
    for texts in ([half, most], [most, half]):
        rows = dc.contamination(documents(texts, [5, 5]), items(spark, [item, item, "other words of no use here"], [1, 1, 1])).collect()
        assert [(r["doc_id"], r["item_id"], r["matched_words"], r["coverage"]) for r in rows] == [(5, 1, 18, 0.9)]
    repeated = items(spark, [item] * 500, [1] * 500)
    assert len(list(dc._blocks(repeated, "item_id", "text", 4, 200))) == 1
