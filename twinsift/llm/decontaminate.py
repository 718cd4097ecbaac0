"""Benchmark decontamination by greedy string tiling.

Words (lower case, without punctuation) of the benchmark give seeds: every run of `min_match` words. Texts that share
seeds with an item are tiled against it: the longest match of words that no tile holds yet is found by running
Karp-Rabin hashes, checked word by word and marked, then the next longest, down to min_match words. The share of the
item's words that tiles cover decides; order doesn't matter, so passages with their sentences moved are caught too.

The benchmark is read in blocks of bounded size, one scan of the texts each, so what travels to the executors stays
bounded however large it is.

Defined cases: null and empty texts match nothing; an item with fewer than min_match words is never matched; equal items
are reported each; repeated rows, of texts or of items, are reported once for each (id, item), and where rows of one id
have different texts the largest coverage counts; of equally long matches the first in the text, then in the item, is
marked first; very long texts are read whole, in parts of bounded size; a null id is an id; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shingles import PUNCTUATION, slabs, windows

MIN_MATCH, COVERAGE = 4, 0.5
BLOCK_BYTES = 8 << 20
ROLL = 0x9E3779B97F4A7C15
REPORT = "doc_id long, item_id long, coverage double, matched_words long, item_words long, n_tiles long"


def texts_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return slabs(pc.utf8_lower(texts.cast(pa.large_string())), PUNCTUATION)


class Rolling:
    """Karp-Rabin hashes of any run of a sequence of word hashes, from prefix sums."""

    def __init__(self, words: np.ndarray):
        self.size = len(words)
        powers = np.full(self.size + 1, np.uint64(ROLL))
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        back = np.full(self.size + 1, np.uint64(pow(ROLL, -1, 1 << 64)))
        back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words * self.powers[: self.size])))

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.back[starts]


def _free_runs(taken: np.ndarray, length: int) -> np.ndarray:
    """Starts of runs of `length` words of which none is taken."""
    if len(taken) < length:
        return np.zeros(0, dtype=np.int64)
    held = np.concatenate(([0], np.cumsum(taken)))
    return np.flatnonzero(held[length:] == held[:-length])


def _longest(text: Rolling, item: Rolling, free_text: np.ndarray, free_item: np.ndarray, least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Length of the longest run that both have free, by bisection over running hashes, and where its hashes meet."""
    low, high, found = least, item.size, (0, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    while low <= high:
        length = (low + high) // 2
        a, b = _free_runs(free_text, length), _free_runs(free_item, length)
        ha, hb = text.of(a, length) if len(a) else np.zeros(0, np.uint64), item.of(b, length) if len(b) else np.zeros(0, np.uint64)
        meets = np.isin(ha, hb)
        if meets.any():
            found = (length, a[meets], b)
            low = length + 1
        else:
            high = length - 1
    return found


def tile(text_words: np.ndarray, item_words: np.ndarray, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in text, start in item, length) of non-overlapping matches, longest first."""
    text, item = Rolling(text_words), Rolling(item_words)
    taken_text, taken_item = np.zeros(text.size, dtype=np.int64), np.zeros(item.size, dtype=np.int64)
    tiles = []
    while True:
        length, starts, item_starts = _longest(text, item, taken_text, taken_item, min_match)
        if not length:
            return tiles
        places: dict[int, list[int]] = {}
        for start, value in zip(item_starts.tolist(), item.of(item_starts, length).tolist(), strict=True):
            places.setdefault(value, []).append(start)
        marked = False
        for start, value in zip(starts.tolist(), text.of(starts, length).tolist(), strict=True):
            if taken_text[start : start + length].any():
                continue
            for at in places.get(value, ()):
                if not taken_item[at : at + length].any() and (text_words[start : start + length] == item_words[at : at + length]).all():
                    taken_text[start : start + length] = taken_item[at : at + length] = 1
                    tiles.append((start, at, length))
                    marked = True
                    break
        if not marked:
            return tiles


def _around_seeds(words: np.ndarray, hits: np.ndarray, width: int) -> np.ndarray:
    """The words near hits, with a word that matches nothing between stretches; no match can lie elsewhere."""
    near = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(near, hits, 1)
    np.add.at(near, np.minimum(hits + width, len(words)), -1)
    near = np.cumsum(near)[:-1] > 0
    gaps = near & ~np.concatenate(([False], near[:-1]))
    at = np.flatnonzero(near)
    out = np.insert(words[at], np.flatnonzero(gaps[at]), np.uint64(0))
    return out


class Seeds:
    """The seeds of a block of items: sorted hashes with the item and place that each comes from."""

    def __init__(self, ids: list[int], texts: list[str | None], min_match: int):
        self.ids, self.words, self.min_match = ids, [], min_match
        hashes, items, places = [], [], []
        for first, end, words, counts in texts_words(pa.array(texts, pa.large_string())):
            ends = np.cumsum(counts)
            for number, (stop, count) in enumerate(zip(ends, counts, strict=True)):
                own = words[stop - count : stop]
                self.words.append(own)
                if count >= min_match:
                    found, _, at = windows(own, np.array([count]), min_match)
                    hashes.append(found)
                    items.append(np.full(len(found), first + number))
                    places.append(at)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.items = np.concatenate(items)[order] if hashes else np.zeros(0, dtype=np.int64)
        self.places = np.concatenate(places)[order] if hashes else np.zeros(0, dtype=np.int64)

    def maybe(self) -> np.ndarray:
        bits = np.zeros(1 << 24, dtype=bool)
        bits[(self.hashes >> np.uint64(40)).astype(np.int64)] = True
        return bits

    def match(self, words: np.ndarray, hashes: np.ndarray, at: np.ndarray, coverage: float) -> Iterator[tuple[int, float, int, int, int]]:
        """Items that the text covers: (id, coverage, matched words, item words, tiles). hashes, at: seeds found in it."""
        low, high = np.searchsorted(self.hashes, hashes, side="left"), np.searchsorted(self.hashes, hashes, side="right")
        count = high - low
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        items, places, hits = self.items[rows], self.places[rows], np.repeat(at, count)
        for item in np.unique(items):
            own, mine = self.words[item], items == item
            reached = np.zeros(len(own) + 1, dtype=np.int64)
            seeds = np.unique(places[mine])
            np.add.at(reached, seeds, 1)
            np.add.at(reached, seeds + self.min_match, -1)
            if (np.cumsum(reached)[:-1] > 0).sum() < coverage * len(own):
                continue  # tiles lie within seeds, so the coverage can't reach the threshold
            tiles = tile(_around_seeds(words, np.unique(hits[mine]), self.min_match), own, self.min_match)
            matched = sum(length for _, _, length in tiles)
            if matched >= coverage * len(own):
                yield self.ids[item], matched / len(own), matched, len(own), len(tiles)


def _matches(block: Seeds, maybe: np.ndarray, texts: pa.Array, coverage: float) -> Iterator[tuple]:
    """(row, item id, coverage, matched words, item words, tiles) for the texts of a batch."""
    for first, _, words, counts in texts_words(texts):
        hashes, owner, at = windows(words, counts, block.min_match)
        likely = np.flatnonzero(maybe[(hashes >> np.uint64(40)).astype(np.int64)])
        place = np.minimum(np.searchsorted(block.hashes, hashes[likely]), len(block.hashes) - 1)
        hit = likely[block.hashes[place] == hashes[likely]]
        ends = np.cumsum(counts)
        for text in np.unique(owner[hit]):
            mine = hit[owner[hit] == text]
            own = words[ends[text] - counts[text] : ends[text]]
            for found in block.match(own, hashes[mine], at[mine], coverage):
                yield first + int(text), *found


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, min_match: int, block_bytes: int) -> Iterator[Seeds]:
    """The seeds of the benchmark, a part of about block_bytes of text at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        seeds = Seeds([row["item_id"] for row in rows], [row["text"] for row in rows], min_match)
        if len(seeds.hashes):
            yield seeds


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row (see REPORT) for each text and item of which the text covers at least `coverage`."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = [part.split()[0] for part in REPORT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    out = None
    for seeds in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = spark.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            block = shared.value
            maybe = block.maybe()
            for batch in batches:
                rows = [(batch.column(0)[row].as_py(), *found) for row, *found in _matches(block, maybe, batch.column(1), coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        found = docs.mapInArrow(run, REPORT)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], REPORT)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched_words", "item_words", "n_tiles")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that cover no item of the benchmark; each row is judged by its own text."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    for seeds in _blocks(benchmark, item_col, item_text_col, min_match, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches, shared=shared):
            block = shared.value
            maybe = block.maybe()
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for row, *_ in _matches(block, maybe, batch.column(place), coverage):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
