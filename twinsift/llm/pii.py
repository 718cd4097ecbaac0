"""Personal data in texts: rules for plain forms, and a character-level tagger for what they miss.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost first and without overlaps within
a kind. A bidirectional LSTM with CRF transitions, trained on the rules' spans in a bounded sample and on made ones in
forms that the rules don't know, reads overlapping windows. Each window is decoded by itself; their labels, weighted by
the distance from a window's edges, are votes in one decoding of the whole stretch, and of the spans found those count
that pass the kind's check and overlap no span of the rules.

A span needs a digit, an at sign or a bracketed `at`, so reading starts with the windows that have one. Where a span runs
to the edge of what was read, reading goes on from there until spans end within it, so none is cut.

Defined cases: null and empty texts have no spans; repeated rows are scanned each; a null id is kept; places are code
points, ends exclusive; of labels with equal votes the first in the order of labels counts, as in any tie of the decoding;
spans that start together are listed by kind; empty tables give no rows; other columns are ignored. Very long texts and
runs of characters take time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, tidy
from .sampling import by_hash
from .tagger import ALLOWED, KINDS, LABELS, STRIDE, WINDOW, Tagger, classes_of, labels_of, spans_of, viterbi

SAMPLE_TEXTS, WINDOWS_OF_TEXT, SAMPLE_WINDOWS, MADE_WINDOWS = 20_000, 6, 1500, 1200  # of the sample that is learned from
LEAST_VOTE = 0.9

_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# Possessive, and only at the start of a run: equal to the plain patterns, in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE)

Span = tuple[str, int, int]


def _emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _HOST.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            floor = found.end()
        at = text.find("@", max(at + 1, floor))
    return out


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def is_ip(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) < 4 and int(part or 0) <= 255 for part in parts)


def rule_spans(text: str) -> list[Span]:
    """Spans of the rules by start, then by kind."""
    if not text or not _TRIGGER.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern, check in (("ip", _IP, is_ip), ("card", _CARD, is_card), ("phone", _PHONE, is_phone)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if check(m[0])]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _plausible(kind: str, text: str) -> bool:
    """Checks for spans of the tagger, which also knows forms that the rules don't."""
    if text != text.strip() or "\n" in text:
        return False
    if kind == "card":
        return text[0].isdigit() and text[-1].isdigit() and is_card(text)
    if kind == "ip":
        return len(text.split(".")) == 4 and all(p.isascii() and p.isdigit() for p in text.split(".")) and is_ip(text)
    if kind == "phone":
        return is_phone(text) and bool(re.fullmatch(r"[+(]?[0-9][ ().0-9-]*[0-9]", text)) and not text.isdigit() and not is_ip_like(text)
    return bool(_AT.search(text)) and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text, re.IGNORECASE))


def is_ip_like(text: str) -> bool:
    return text.count(".") >= 3 and not set(text) - set("0123456789.")


def windows_of(text: str) -> list[int]:
    """Starts of the windows, every STRIDE code points, that hold a digit or an at sign."""
    cells = sorted({m.start() // STRIDE for m in _TRIGGER.finditer(text)} | {m.start() // STRIDE for m in _AT.finditer(text)})
    return [STRIDE * c for c in sorted({c for cell in cells for c in (cell - 1, cell) if c >= 0})]


_WEIGHTS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32) / STRIDE


def reconcile(text: str, starts: list[int], decoded: list[np.ndarray]) -> tuple[list[tuple[Span, float]], list[tuple[int, int]]]:
    """One labelling of each covered stretch by the votes of its windows: spans with their share of the votes, and the
    (start of a window, direction) where reading has to go on because a span reaches the edge of its stretch."""
    out, on, at = [], [], 0
    while at < len(starts):
        end = at + 1
        while end < len(starts) and starts[end] <= starts[end - 1] + WINDOW - 1:
            end += 1
        low, high = starts[at], min(len(text), starts[end - 1] + WINDOW)
        votes = np.zeros((high - low, LABELS), dtype=np.float32)
        for start, labels in zip(starts[at:end], decoded[at:end], strict=True):
            size = min(WINDOW, high - start)
            votes[np.arange(start - low, start - low + size), labels[:size]] += _WEIGHTS[:size]
        cast = votes / np.maximum(1e-6, votes.sum(axis=1, keepdims=True))
        labels = viterbi(cast[:, None, :] * 8, ALLOWED)[0]
        for kind, start, stop in spans_of(labels):
            own = 1 + 2 * KINDS.index(kind)
            out.append(((kind, low + start, low + stop), float(cast[start:stop, own : own + 2].sum(axis=1).mean())))
            if start == 0 and low > 0:
                on.append((low - STRIDE, -1))
            if low + stop == high < len(text):
                on.append((starts[end - 1] + STRIDE, 1))
        at = end
    return out, on


class Finder:
    """Rules and tagger together; keeps what equal windows decoded to within a call."""

    def __init__(self, tagger: Tagger):
        self.tagger = tagger

    def _decode(self, pieces: list[str]) -> dict[str, np.ndarray]:
        fresh, out = list(dict.fromkeys(pieces)), {}
        for at in range(0, len(fresh), 512):
            part = fresh[at : at + 512]
            seen = np.zeros((len(part), WINDOW), dtype=np.int64)
            for row, piece in enumerate(part):
                seen[row, : len(piece)] = classes_of(piece)
            out.update(zip(part, self.tagger.decode(self.tagger.emissions(seen)), strict=True))
        return out

    def _read(self, text: str, starts: list[int], decoded: dict[str, np.ndarray]) -> list[tuple[Span, float]]:
        """The spans around the given windows; reads twice as many windows more each time that a span isn't at its end."""
        reach = 1
        while True:
            found, on = reconcile(text, starts, [decoded[text[s : s + WINDOW]] for s in starts])
            more = {s for first, way in on for s in range(first, first + way * reach * STRIDE, way * STRIDE) if 0 <= s < len(text)} - set(starts)
            if not more:
                return found
            starts, reach = sorted({*starts, *more}), 2 * reach
            decoded = decoded | self._decode([piece for s in more if (piece := text[s : s + WINDOW]) not in decoded])

    def find(self, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
        """(spans of the rules, spans that the tagger adds) of each text."""
        base = [rule_spans(text) for text in texts]
        starts = [windows_of(text) if text else [] for text in texts]
        decoded = self._decode([text[s : s + WINDOW] for text, own in zip(texts, starts, strict=True) for s in own])
        out = []
        for text, own, rules in zip(texts, starts, base, strict=True):
            added: list[Span] = []
            for span, vote in self._read(text, own, decoded) if own else []:
                kind, start, end = span
                clear = all(end <= a or b <= start for _, a, b in rules)
                if vote >= LEAST_VOTE and clear and _plausible(kind, text[start:end]):
                    added.append(span)
            out.append((rules, added))
        return out


def made_windows(count: int, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Windows of invented words with labelled spans in forms that the rules know and in others, and with look-alikes."""
    random = np.random.default_rng(seed)
    pick = lambda values: values[random.integers(len(values))]
    number = lambda size: "".join(map(str, random.integers(0, 10, size)))
    word = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyzéü") for _ in range(random.integers(2, 9)))
    plain = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(random.integers(3, 9)))

    def card() -> str:
        body = pick("3456") + number(14)
        digits = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return pick([digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))])

    makers = {
        "email": lambda: pick([f"{plain()}.{plain()}@{plain()}.com", f"{plain()}{number(2)}@{plain()}.org", f"{plain()} [at] {plain()}.net", f"{plain()}(at){plain()}.com", f"{plain()}_{plain()}@{plain()}.co.uk"]),
        "ip": lambda: ".".join(str(random.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": lambda: pick([f"+{number(2)} {number(3)} {number(3)} {number(4)}", f"+1 ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"+{number(2)}-{number(3)}-{number(7)}"]),
    }
    others = [lambda: number(int(random.integers(1, 8))), lambda: f"{pick('12')}.{number(1)}", lambda: "".join(pick("0123456789abcdef") for _ in range(32)), lambda: f"20{number(2)}-{number(2)}-{number(2)}", lambda: number(9) + plain(), lambda: f"@{plain()}", lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(3)},{number(3)}"]
    out = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(random.integers(0, 5))), []
        for _ in range(random.integers(1, 3)):
            text += pick([" ", " ", ": ", "\n", "### ", ", "])
            kind = pick([*KINDS, None])
            piece = makers[kind]() if kind else pick(others)()
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        text += pick([" ", ".", ", ", "\n", "&&& "]) + " ".join(word() for _ in range(4))
        shift = int(random.integers(0, max(1, len(text) - WINDOW)))
        out.append((text[shift : shift + WINDOW], [(k, a - shift, b - shift) for k, a, b in spans if b > shift and a < shift + WINDOW]))
    return out


def training_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, list[Span]]]:
    """Windows with the rules' spans from a bounded sample: of SAMPLE_TEXTS texts WINDOWS_OF_TEXT each, drawn by their hash
    from the whole text, and of these SAMPLE_WINDOWS."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = by_hash(rows, "doc_id", SAMPLE_TEXTS).where(F.regexp_like("text", F.lit("[0-9@]"))).select("text")

    def run(batches):
        for batch in batches:
            windows, labels = [], []
            for value in batch.column(0):
                text = value.as_py()
                spans = rule_spans(text)
                drawn = sorted(windows_of(text), key=lambda at: (zlib.crc32(text[at : at + WINDOW].encode("utf-8", "surrogatepass")), at))
                for start in sorted(drawn[:WINDOWS_OF_TEXT]):
                    windows.append(text[start : start + WINDOW])
                    labels.append(listed([(k, a - start, b - start) for k, a, b in spans if b > start and a < start + WINDOW]))
            yield pa.RecordBatch.from_pydict({"window": pa.array(windows, pa.string()), "spans": pa.array(labels, pa.string())})

    found = sample.mapInArrow(run, "window string, spans string").distinct().orderBy(F.xxhash64("window"), "window").limit(SAMPLE_WINDOWS).collect()
    out = []
    for row in found:
        spans = [part.split(":") for part in row["spans"].split(",") if part]
        spans = [(k, int(a), int(b)) for k, a, b in spans]
        if all(a >= e for (_, _, e), (_, a, _) in zip(spans, spans[1:], strict=False)):
            out.append((row["window"], spans))
    return out


def train(windows: list[tuple[str, list[Span]]], epochs: int | None = None) -> Tagger:
    seen, gold = np.zeros((len(windows), WINDOW), dtype=np.int64), np.zeros((len(windows), WINDOW), dtype=np.int64)
    for row, (text, spans) in enumerate(windows):
        seen[row, : len(text)] = classes_of(text)
        gold[row, : len(text)] = labels_of(len(text), spans)
    tagger = Tagger.fresh()
    tagger.train(seen, gold, **({} if epochs is None else {"epochs": epochs}))
    return tagger


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    return train(training_windows(docs, id_col, text_col) + made_windows(MADE_WINDOWS))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find_pii(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (see FOUND) for each text: counts and digest of the rules' spans, the list of all, how many were added."""
    ship(docs.sparkSession)
    names = [part.split()[0] for part in FOUND.split(", ")]

    def run(batches):
        finder = Finder(tagger)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows: list[list] = [[] for _ in names[1:]]
                for rules, added in finder.find(part.column(1).to_pylist()):
                    every = sorted(rules + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                    counts = [sum(1 for s in rules if s[0] == kind) for kind in KINDS]
                    for column, value in zip(rows, (*counts, hashlib.sha256(listed(rules).encode()).hexdigest(), listed(every), len(added)), strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by the kind of the first one."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, tagger: Tagger, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs, all columns, with every span masked; length_col, if given, gets the new number of code points."""
    ship(docs.sparkSession)
    place = docs.columns.index(text_col)
    count = docs.columns.index(length_col) if length_col else None

    def run(batches):
        finder = Finder(tagger)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = finder.find(texts)
            texts = [text if text is None or not (rules or added) else masked(text, rules + added) for text, (rules, added) in zip(texts, found, strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            if count is not None:
                columns[count] = pa.array([None if text is None else len(text) for text in texts], pa.int64()).cast(batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
        tidy()

    return docs.mapInArrow(run, docs.schema)
