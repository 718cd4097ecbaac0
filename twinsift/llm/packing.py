"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities.

Documents become token ids (byte-level BPE, then the end id 1) and are cut into pieces of at most `capacity` ids. The
documents are dealt at random into groups of bounded size, and every group packs its own pieces, so no task holds more
than a group. Only lengths are shuffled, never ids. A row's group is drawn from its place in the table, so rows that are
equal, however many, spread over all groups; which sequence a piece lies in thus depends on the table's partitions, but
what the pieces are doesn't.

Ids are those of the vocabulary's .json form. A text is cut at places where that form's pattern ends a match in any case: before
spaces, and where letters, digits and marks meet; the parts are encoded each on its own, and the ids of those met lately are
remembered, up to a bound.

Defined cases: a null text counts as empty and gives one piece that holds just the end id; repeated rows are packed each
on its own; ties in length go by (doc_id, start, checksum); a document of more pieces than a group usually has makes its
group larger; an empty table gives no rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship, tidy

END_ID = 1
CAPACITY = 2048
GROUP_PIECES = 16_384
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long, sequence_tokens long, padded_to long"

KNOWN_PARTS, TEXTS_AT_ONCE, WORDS_AT_ONCE = 200_000, 4096, 128
SPARING = (20_000, 256)  # the first two where memory is short

_encoders: dict[str, "Encoder"] = {}
# Parts that may stand alone, as the pattern ends a match between them: it never goes on from another character to white
# space, nor between letters, digits and marks, but for an apostrophe before letters. At these places texts are cut all at
# once; those where a space meets other white space are cut one by one, unless they have white space that versions of
# Unicode disagree on.
_PART = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
_OTHER, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _LINE, _SPACE = range(7)  # kinds of bytes; letters are ASCII's and those that begin with C3
_KIND = np.zeros(256, dtype=np.uint8)
for _low, _high, _kind in ((33, 127, _MARK), (48, 58, _DIGIT), (65, 91, _LETTER), (97, 123, _LETTER), (39, 40, _APOSTROPHE), (10, 11, _LINE), (32, 33, _SPACE)):
    _KIND[_low:_high] = _kind
_AFTER_C3 = np.zeros(256, dtype=bool)
_AFTER_C3[0x80:0xC0] = True
_AFTER_C3[[0x97, 0xB7]] = False  # signs of multiplication and division
_ENDS = np.zeros((8, 8), dtype=bool)  # whether a match ends between two kinds
_ENDS[:, _SPACE] = True
_ENDS[_LETTER, [_DIGIT, _MARK, _APOSTROPHE, _LINE]] = True
_ENDS[_DIGIT, [_LETTER, _MARK, _APOSTROPHE, _LINE]] = True
_ENDS[_MARK, [_LETTER, _DIGIT, _LINE]] = True
_ENDS[_APOSTROPHE, [_DIGIT, _LINE]] = True
_ENDS[_LINE, [_LETTER, _DIGIT, _MARK, _APOSTROPHE]] = True  # if the line's end is the only white space there
_ENDS = _ENDS.reshape(-1)
_PLAIN = re.compile("[ ]?[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_OTHER_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ANY_SPACE = r"[\t-\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _cuts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where parts begin in the bytes of texts, with their bounds, that have no space beside other white space."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_AFTER_C3[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(len(data), dtype=bool)
    begins[bounds[:-1][np.diff(bounds) > 0]] = True
    ends = _ENDS[(kind[:-1] << 3) | kind[1:]]
    lines = np.flatnonzero(kind[:-1] == _LINE)
    before = kind[np.maximum(0, lines - 1)]
    ends[lines] &= (before >= _LETTER) & (before <= _APOSTROPHE)
    begins[1:] |= ends
    return np.flatnonzero(begins)


class Encoder:
    """Token ids by a .json file of the public tokenizers; remembers the ids of words met before.

    Texts are cut only if nothing normalises them, spaces are left to the byte-level pattern and they hold no added token.
    """

    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.made = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.plain = Tokenizer(self.made.model)  # for lines that are a match of the pattern each
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.line = self.made.token_to_id("\u010a")  # the id of a line's end
        first = json.loads(self.made.pre_tokenizer.__getstate__()) if self.made.pre_tokenizer else {}
        self.added = [token.content for token in self.made.get_added_tokens_decoder().values()]
        self.may_cut = self.made.normalizer is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
        self.keep: int | None = None  # how many, if not KNOWN_PARTS
        self.known: dict[str, bytes] = {}  # what was met lately
        self.older: dict[str, bytes] = {}  # and before that

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def _learn(self, words: list[str]) -> None:
        plain, mixed = [], []
        for word in words:
            (plain if _PLAIN(word) else mixed).append(word)
        for at in range(0, len(plain), WORDS_AT_ONCE):
            some = plain[at : at + WORDS_AT_ONCE]
            ids = np.array(self.plain.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            self._keep(some, ids, np.append(0, ends[:-1] + 1), ends)
        for at in range(0, len(mixed), WORDS_AT_ONCE):
            some = mixed[at : at + WORDS_AT_ONCE]
            found = self.made.encode(some, is_pretokenized=True, add_special_tokens=False)  # each by itself, in one call
            edges = np.searchsorted(np.array(found.word_ids, dtype=np.int64), np.arange(len(some) + 1))
            self._keep(some, np.array(found.ids, dtype="<u4"), edges[:-1], edges[1:])

    def _keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data = ids.tobytes()
        self.known.update(zip(words, map(data.__getitem__, map(slice, (4 * starts).tolist(), (4 * ends).tolist())), strict=True))

    def _ids_of(self, parts: list[str]) -> list[bytes]:
        """The ids of each of the parts, which hold no added token."""
        if len(self.known) > (self.keep or KNOWN_PARTS):
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = list(map(known.get, parts))
        lost = [at for at, ids in enumerate(found) if ids is None]
        known.update((parts[at], older[parts[at]]) for at in lost if parts[at] in older)
        self._learn(list(dict.fromkeys(parts[at] for at in lost if parts[at] not in known)))
        for at in lost:
            found[at] = known[parts[at]]
        return found

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not self.may_cut or any(token in text for token in self.added) or _OTHER_SPACE.search(text):
                out.append(np.array(self.made.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes())
            else:
                out.append(b"".join(self._ids_of(_PART.findall(text))))
        return out

    def _at_once(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each) for texts that may be cut before every space."""
        bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
        if bounds[-1] == bounds[0]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        starts = _cuts(data, bounds)
        edges = pa.py_buffer(np.append(starts, len(data)))
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        narrow = np.int32 if len(data) < 1 << 31 else np.int64  # a text has no more ids than bytes
        sizes = np.fromiter(map(len, found), dtype=narrow, count=len(found)) // 4
        pool, at = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes, dtype=narrow) - sizes
        row = coded.indices.to_numpy(zero_copy_only=False)
        many = sizes[row]
        ends = np.cumsum(many, dtype=narrow)
        ids = pool[np.repeat(at[row] - (ends - many), many) + np.arange(ends[-1], dtype=narrow)]
        return ids, np.diff(np.append(0, ends)[np.searchsorted(starts, bounds)])

    def many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text with the end id, as little-endian unsigned 32-bit numbers."""
        texts = texts.cast(pa.large_string()).fill_null("")
        alone = np.ones(len(texts), dtype=bool)
        if self.may_cut and len(texts):
            alone = pc.match_substring_regex(texts, f" {_ANY_SPACE}|{_ANY_SPACE} ").to_numpy(zero_copy_only=False).copy()
            for token in self.added:
                alone |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        ids, sizes = self._at_once(texts.filter(pa.array(~alone)))
        out: list = [None] * len(texts)
        for row, own in zip(np.flatnonzero(~alone).tolist(), np.split(ids, np.cumsum(sizes)[:-1]) if len(sizes) else [], strict=True):
            out[row] = own
        for row, own in zip(np.flatnonzero(alone).tolist(), self._one_by_one(texts.filter(pa.array(alone)).to_pylist()), strict=True):
            out[row] = np.frombuffer(own, dtype="<u4")
        return [np.append(own, np.uint32(END_ID)).astype("<u4") for own in out]


def encoder(name: str = "byte_bpe_50k") -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def token_ids(text: str | None, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of one text with the end id."""
    return encoder(name).many(pa.array([text], pa.string()))[0]


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of consecutive pieces; only the last may be shorter than capacity."""
    for start in range(0, len(ids), capacity):
        piece = ids[start : start + capacity]
        yield start, len(piece), zlib.crc32(piece.tobytes())


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths come in decreasing order.

    The leaves of the tree are bins in order of opening and each inner node has the largest free capacity below it, so
    the first bin that fits is found by one walk down and kept up to date by one walk up.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bins.append(node - leaves)
        offsets.append(capacity - free[node])
        free[node] -= length
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return bins, offsets


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k", sparing: bool = False) -> DataFrame:
    """One row for each piece of each document, without a place in a sequence yet; draw is random and the same for all pieces of a row."""
    ship(docs.sparkSession)

    def run(batches):
        random = np.random.default_rng(TaskContext.get().partitionId())
        encoder(tokenizer).keep, at_once = SPARING if sparing else (None, TEXTS_AT_ONCE)
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                rows: list[list[int]] = [[], [], [], [], [], []]
                draws = random.integers(0, 1 << 62, part.num_rows).tolist()
                every = encoder(tokenizer).many(part.column(1))
                for doc_id, draw, ids in zip(part.column(0).to_pylist(), draws, every, strict=True):
                    for start, length, checksum in cut(ids, capacity):
                        for column, value in zip(rows, (doc_id, start, length, checksum, len(ids), draw), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"])
        encoder(tokenizer).forget()
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"{PIECES}, draw long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, tokenizer: str = "byte_bpe_50k", sparing: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens; a row for each piece (see PACKED).

    If sparing, tasks take less memory and more time; the pieces are the same.
    """
    cutted = materialize(pieces(docs, id_col, text_col, capacity, tokenizer, sparing), "pieces")
    groups = max(1, -(-cutted.count() // group_pieces))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, frame["offset"] = first_fit_decreasing(frame["length"].tolist(), capacity)
        bins = np.array(bins, dtype=np.int64)
        filled = np.bincount(bins, weights=frame["length"]).astype(np.int64)[bins]
        frame["sequence_id"] = frame["pack_group"].to_numpy(np.int64) * (1 << 32) + bins
        frame["sequence_tokens"] = filled
        frame["padded_to"] = np.where(filled & (filled - 1), capacity, filled)
        return frame[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_to"]]

    dealt = cutted.withColumn("pack_group", F.pmod("draw", F.lit(groups))).drop("draw")
    return dealt.groupBy("pack_group").applyInPandas(run, PACKED)
