"""Bitmaps of a column of numbers: which rows may be among them, decided without a shuffle.

A bitmap says yes for every number that it was made of and for few others, so what it passes still has to be decided by a
join, and what it doesn't pass is done. Its size goes by the count of numbers, up to LARGEST bits (16 MB); with more
numbers it passes more others, which costs time and changes nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

BITS_EACH, SMALLEST, LARGEST = 16, 16, 27  # the last two as powers of 2


def _places(values: np.ndarray, power: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = mix(values.view(np.uint64) + np.uint64(1))
    return (mixed >> np.uint64(64 - power)).astype(np.int64), (mixed & np.uint64((1 << power) - 1)).astype(np.int64)


@dataclass
class Bitmap:
    power: int
    words: np.ndarray

    def may_hold(self, values: np.ndarray) -> np.ndarray:
        """Which of some 64-bit numbers may be among those that the bitmap was made of."""
        return np.logical_and(*((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0 for at in _places(values, self.power)))


def bitmap_of(values: DataFrame) -> Bitmap:
    """The bitmap of the numbers in the one column of `values`, which should be a table; nulls are left out."""
    name = values.columns[0]
    values = values.select(F.col(name).cast("long").alias("value")).where("value is not null")
    power = min(LARGEST, max(SMALLEST, (BITS_EACH * values.count()).bit_length()))

    def run(batches):
        for batch in batches:
            at = np.concatenate(_places(batch.column(0).to_numpy(zero_copy_only=False), power))
            words, where = np.unique(at >> 6, return_inverse=True)
            masks = np.zeros(len(words), dtype=np.uint64)
            np.bitwise_or.at(masks, where, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_pydict({"word": words, "mask": masks.view(np.int64)})

    made = values.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros(1 << (power - 6), dtype=np.uint64)
    words[made["word"].to_numpy(np.int64)] = made["mask"].to_numpy(np.int64).view(np.uint64)
    return Bitmap(power, words)


def rows_that_may_hold(docs: DataFrame, column: str, bits: Broadcast, hit: bool, null_hits: bool = True) -> DataFrame:
    """The rows of docs, all columns, whose number in `column` passes the bitmap, or the others; a null passes if null_hits."""
    place = docs.columns.index(column)

    def run(batches):
        for batch in batches:
            ids = batch.column(place).cast(pa.int64())
            passes = bits.value.may_hold(ids.fill_null(0).to_numpy(zero_copy_only=False))
            passes[ids.is_null().to_numpy(zero_copy_only=False)] = null_hits
            yield batch.filter(pa.array(passes == hit))

    return docs.mapInArrow(run, docs.schema)
