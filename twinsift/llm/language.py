"""Language identification by bit-sliced Bloom filters over n-grams of bytes.

Slot j of the filter has one bit a language, in words of up to 64 bits (as many words as the languages need); the bits of
an n-gram's languages are set in its k slots. One AND of k slots thus returns every language that holds the n-gram. A text's n-grams are counted for each language by
popcounts of those words, corrected for the false positives that each language's fill predicts; the largest count
decides, and its share of the two largest is the score.

An n-gram belongs to a language if it is among its most frequent ones in the training sample and no other language has
it several times as often. Training takes a bounded sample of labelled rows (SAMPLE_TEXTS), and for languages that have
few rows in it a bounded number of rows each (LEAST_TEXTS), so a rare language is learned whatever the table's size. The
filter has a fixed size for each 64 languages.

Defined cases: null texts and texts without a letter are `und` with score 0; texts with letters but no known n-gram get
the most frequent learned language with score 0; ties go to the language with the smaller name; if nothing could be
learned all texts are `und`; repeated rows are scored each; very long texts are read whole, in parts of bounded size; any
number of languages is learned; empty tables give no rows; other columns are kept, but for older ones of the results' names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, tidy
from .sampling import by_hash_of_each

UNDETERMINED = "und"
WIDTH, SLOTS, HASHES = 4, 1 << 18, 2
SAMPLE_TEXTS, LEAST_TEXTS, GRAMS_PER_LANGUAGE, MAX_RATIO = 4000, 200, 6000, 2.0
WORD_BITS = 64
LEAST_SHARE, ENOUGH_GRAMS = 0.05, 32
SLAB_BYTES = 1 << 20
_HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))

#: Letters stay (bytes of other scripts too), everything else is a space.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _grams(texts: pa.Array):
    """(first, end, n-grams as numbers, text of each) a slab at a time; a long text comes in overlapping parts."""
    lowered = pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")).cast(pa.large_binary())
    count = len(lowered)
    if not count:
        return
    offsets = np.frombuffer(lowered.buffers()[1], dtype=np.int64)[lowered.offset : lowered.offset + count + 1]
    body = lowered.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < count:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLAB_BYTES, side="right")) - 1)
        for low in range(int(offsets[at]), max(int(offsets[at]) + 1, int(offsets[end])), SLAB_BYTES):
            high = min(int(offsets[end]), low + SLAB_BYTES + WIDTH - 1)
            part = _LETTERS[data[low:high]].astype(np.uint32)
            size = len(part) - WIDTH + 1
            if size <= 0:
                continue
            grams = part[:size].copy()
            for ahead in range(1, WIDTH):
                grams |= part[ahead : ahead + size] << np.uint32(8 * ahead)
            place = np.arange(low, low + size)
            owner = np.searchsorted(offsets[at : end + 1], place, side="right") - 1 if end - at > 1 else np.zeros(size, dtype=np.int64)
            inside = place + WIDTH <= offsets[at + owner + 1]
            inside &= (grams & np.uint32(0xFFFF)) != 0x2020
            yield at, end, grams[inside], owner[inside]
        at = end


@dataclass
class Filter:
    """slots: a row of words for each block of up to 64 languages, a word for each slot with a bit for each language; rates:
    false positives of each language."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    default: str

    def masks(self, grams: np.ndarray, block: int = 0) -> np.ndarray:
        """The words of the n-grams for the languages from 64 * block on."""
        found = None
        for index in _slots_of(grams):
            found = self.slots[block][index] if found is None else found & self.slots[block][index]
        return found

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(corrected count of each text and language, n-grams of each text)."""
        total, seen = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for first, end, grams, owner in _grams(texts):
            if not len(grams):
                continue
            seen[first:end] += np.bincount(owner, minlength=end - first)
            for block in range(len(self.slots)):
                masks = self.masks(grams, block)
                held = np.flatnonzero(masks)
                masks, who = masks[held], owner[held]
                for bit, row in enumerate(range(WORD_BITS * block, min(WORD_BITS * (block + 1), len(self.languages)))):
                    total[first:end, row] += np.bincount(who[(masks >> masks.dtype.type(bit)) & masks.dtype.type(1) > 0], minlength=end - first)
        return np.maximum(0.0, (total - seen[:, None] * self.rates) / (1 - self.rates)), seen

    def judge(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, share of the n-grams that the language holds, n-grams) of each text."""
        names, total = np.array(self.languages, dtype=object), len(texts)
        counts, seen = self.counts(texts)
        best = counts.argmax(axis=1) if len(names) else np.zeros(total, dtype=np.int64)
        top = np.sort(counts, axis=1)[:, ::-1] if len(names) else np.zeros((total, 1))
        first, second = top[:, 0], top[:, 1] if top.shape[1] > 1 else np.zeros(total)
        score = np.divide(first, first + second, out=np.zeros(total), where=first > 0)
        chosen = np.where(first > 0, names[best], self.default) if len(names) else np.full(total, UNDETERMINED, dtype=object)
        lettered = pc.match_substring_regex(texts.cast(pa.large_string()).fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)
        return np.where(lettered, chosen, UNDETERMINED).tolist(), np.where(lettered, score, 0.0), first / np.maximum(1, seen), seen

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        return self.judge(texts)[:2]


def _slots_of(grams: np.ndarray) -> list[np.ndarray]:
    wide = grams.astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - SLOTS.bit_length() + 1)
    return [(wide * multiplier) >> shift for multiplier in _HASHES[:HASHES]]


def build_filter(frame: pd.DataFrame, texts_of: dict[str, int]) -> Filter:
    """A filter from counts of n-grams (lang, gram, n) and how many texts each language had."""
    languages = sorted(texts_of)
    if not languages:
        return Filter([], np.zeros((0, SLOTS), dtype=np.uint8), np.zeros(0), UNDETERMINED)
    grams = np.unique(frame["gram"].to_numpy(np.int64)) if len(frame) else np.zeros(0, dtype=np.int64)
    # Of each language (place in grams, rate); only its own n-grams, so many languages need no full matrix.
    own_of, most = [], np.zeros(len(grams))
    own_frames = dict(iter(frame.groupby("lang"))) if len(frame) else {}
    for language in languages:
        own = own_frames.get(language)
        at = np.searchsorted(grams, own["gram"].to_numpy(np.int64)) if own is not None else np.zeros(0, dtype=np.int64)
        rate = own["n"].to_numpy(float) if own is not None else np.zeros(0)
        rate = rate / max(1.0, rate.sum())
        np.maximum.at(most, at, rate)
        own_of.append((at, rate))
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if min(len(languages), WORD_BITS) <= bits)
    slots = np.zeros((-(-len(languages) // WORD_BITS), SLOTS), dtype=kind)
    for row, (at, rate) in enumerate(own_of):
        typical = (rate > 0) & (rate * MAX_RATIO >= most[at])
        at, rate = at[typical], rate[typical]
        picked = at[np.lexsort((grams[at], -rate))][:GRAMS_PER_LANGUAGE]
        for index in _slots_of(grams[picked].astype(np.uint32)):
            slots[row // WORD_BITS, index] |= kind(1 << row % WORD_BITS)
    fill = np.array([((slots[row // WORD_BITS] >> kind(row % WORD_BITS)) & kind(1)).mean() for row in range(len(languages))])
    return Filter(languages, slots, np.minimum(0.99, fill**HASHES), max(languages, key=lambda name: (texts_of[name], name)))


def train(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filter:
    """A filter from a bounded sample, of each language, of the rows for which `learn` holds and the language is known."""
    ship(docs.sparkSession)
    rows = docs.where(learn & F.col(lang_col).isNotNull() & (F.col(lang_col) != UNDETERMINED)).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample, texts_of = by_hash_of_each(rows, "doc_id", "lang", SAMPLE_TEXTS, LEAST_TEXTS)

    def count(batches):
        tally: dict[str, list] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for language in np.unique(langs):
                for _, _, grams, _ in _grams(batch.column(1).filter(pa.array(langs == language))):
                    found, counts = np.unique(grams, return_counts=True)
                    tally.setdefault(language, []).append((found, counts))
        for language, parts in tally.items():
            grams = np.concatenate([p[0] for p in parts])
            found, at = np.unique(grams, return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(found))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([language] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build_filter(counted.where("n > 1").toPandas(), texts_of)


def identify(docs: DataFrame, model: Filter, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """docs with two more columns, the language and its score; older columns of these names are replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(lang_name, score_name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(place))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_name, score_name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{lang_name} string", f"{score_name} double"])
    return docs.mapInArrow(run, schema)


def only_identified(docs: DataFrame, model: Filter, text_col: str = "text", least_share: float = LEAST_SHARE, enough: int = ENOUGH_GRAMS) -> DataFrame:
    """The rows of docs, all columns, without those whose text has no letter or is in no learned language.

    A text is in none if it has `enough` n-grams and the best language holds less than least_share of them; too short a
    text to tell stays.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            names, _, share, seen = shared.value.judge(batch.column(place))
            yield batch.filter(pa.array((np.array(names, dtype=object) != UNDETERMINED) & ((share >= least_share) | (seen < enough))))
        tidy()

    return docs.mapInArrow(run, docs.schema)
