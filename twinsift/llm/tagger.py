"""A character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0 is outside; kind k has a first label 1 + 2k and an inner one 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE, HIDDEN = 64, 32, 16
EPOCHS, BATCH, RATE = 10, 64, 0.02
FORBIDDEN = -1e4

_NAMED = "@.-+ ()_%:/[]<>=\"',;"
CLASSES = len(_NAMED) + 8


def _class_table() -> np.ndarray:
    table = np.full(0x250, CLASSES - 1, dtype=np.int8)
    for code in range(0x250):
        char = chr(code)
        if char in _NAMED:
            table[code] = 1 + _NAMED.index(char)
        elif char.isdigit() and code < 128:
            table[code] = len(_NAMED) + 1
        elif "a" <= char <= "z":
            table[code] = len(_NAMED) + 2
        elif "A" <= char <= "Z":
            table[code] = len(_NAMED) + 3
        elif char in "\n\r\t":
            table[code] = len(_NAMED) + 4
        elif code < 128:
            table[code] = len(_NAMED) + 5
        elif char.isalpha():
            table[code] = len(_NAMED) + 6
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    """A class number for each code point; 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)].astype(np.int64)


def labels_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, dtype=np.int64)
    for kind, start, end in spans:
        first = 1 + 2 * KINDS.index(kind)
        if 0 <= start < length:
            out[start] = first
        out[max(0, start + 1) : max(0, min(end, length))] = first + 1
    return out


def _allowed() -> np.ndarray:
    """An inner label follows only the first or an inner label of its kind."""
    out = np.zeros((LABELS, LABELS), dtype=np.float32)
    for inner in range(2, LABELS, 2):
        out[:, inner] = FORBIDDEN
        out[[inner - 1, inner], inner] = 0
    return out


ALLOWED = _allowed()
START = np.where((np.arange(LABELS) > 0) & (np.arange(LABELS) % 2 == 0), -4.0, 0.0).astype(np.float32)


def _sigmoid(values: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-values))


def _run(table: np.ndarray, inner: np.ndarray, seen: np.ndarray, keep: bool = False):
    """Hidden states of one direction, (time, rows, HIDDEN), and what the backward pass needs."""
    steps, rows = seen.shape
    hidden, cell = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    states = np.empty((steps, rows, HIDDEN), np.float32)
    kept = []
    for step in range(steps):
        z = table[seen[step]] + hidden @ inner
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        fresh = np.tanh(z[:, 3 * HIDDEN :])
        before, cell_before = hidden, cell
        cell = gates[:, HIDDEN : 2 * HIDDEN] * cell + gates[:, :HIDDEN] * fresh
        bent = np.tanh(cell)
        hidden = gates[:, 2 * HIDDEN :] * bent
        states[step] = hidden
        if keep:
            kept.append((gates, fresh, before, cell_before, bent))
    return states, kept


def _back(table: np.ndarray, inner: np.ndarray, seen: np.ndarray, kept, slopes: np.ndarray):
    d_table, d_inner = np.zeros_like(table), np.zeros_like(inner)
    rows = seen.shape[1]
    d_hidden, d_cell = np.zeros((rows, HIDDEN), np.float32), np.zeros((rows, HIDDEN), np.float32)
    for step in range(len(kept) - 1, -1, -1):
        gates, fresh, before, cell_before, bent = kept[step]
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        dh = slopes[step] + d_hidden
        dc = d_cell + dh * o * (1 - bent * bent)
        dz = np.concatenate((dc * fresh * i * (1 - i), dc * cell_before * f * (1 - f), dh * bent * o * (1 - o), dc * i * (1 - fresh * fresh)), axis=1)
        np.add.at(d_table, seen[step], dz)
        d_inner += before.T @ dz
        d_hidden, d_cell = dz @ inner.T, dc * f
    return d_table, d_inner


def _log_sum(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """log(exp(values) @ table), row by row."""
    most = values.max(axis=1, keepdims=True)
    return np.log(np.maximum(np.exp(values - most) @ table, 1e-30)) + most


@dataclass
class Tagger:
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 5) -> Tagger:
        random = np.random.default_rng(seed)
        draw = lambda *shape: (random.standard_normal(shape) * 0.2).astype(np.float32)
        made = {"xf": draw(CLASSES, 4 * HIDDEN), "hf": draw(HIDDEN, 4 * HIDDEN), "xb": draw(CLASSES, 4 * HIDDEN), "hb": draw(HIDDEN, 4 * HIDDEN), "out": draw(2 * HIDDEN, LABELS), "bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32)}
        for name in ("xf", "xb"):
            made[name][:, HIDDEN : 2 * HIDDEN] += 1
        return cls(made)

    def emissions(self, seen: np.ndarray, keep: bool = False):
        """(rows, time) class numbers to (time, rows, LABELS) scores."""
        w, seen = self.weights, np.ascontiguousarray(seen.T)
        ahead, kept_ahead = _run(w["xf"], w["hf"], seen, keep)
        back, kept_back = _run(w["xb"], w["hb"], seen[::-1], keep)
        both = np.concatenate((ahead, back[::-1]), axis=2)
        scores = both @ w["out"] + w["bias"]
        return (scores, seen, both, kept_ahead, kept_back) if keep else scores

    def _step(self, seen: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of a batch and the gradients, by the forward-backward algorithm of the CRF."""
        w, rows = self.weights, len(seen)
        scores, seen, both, kept_ahead, kept_back = self.emissions(seen, True)
        gold, steps = gold.T, scores.shape[0]
        move = np.exp(w["move"] + ALLOWED)
        ahead, back = np.empty_like(scores), np.empty_like(scores)
        ahead[0], back[-1] = scores[0] + START, 0
        for step in range(1, steps):
            ahead[step] = _log_sum(ahead[step - 1], move) + scores[step]
            back[-step - 1] = _log_sum(back[-step] + scores[-step], move.T)
        whole = ahead[-1].max(axis=1) + np.log(np.exp(ahead[-1] - ahead[-1].max(axis=1, keepdims=True)).sum(axis=1))
        share = np.exp(ahead + back - whole[None, :, None])
        index = np.arange(rows)
        path = scores[0, index, gold[0]] + START[gold[0]]
        d_move = np.zeros_like(move)
        for step in range(1, steps):
            path = path + scores[step, index, gold[step]] + (w["move"] + ALLOWED)[gold[step - 1], gold[step]]
            left, right = ahead[step - 1], back[step] + scores[step]
            most, more = left.max(axis=1, keepdims=True), right.max(axis=1, keepdims=True)
            d_move += ((np.exp(left - most) * np.exp(most + more - whole[:, None])).T @ np.exp(right - more)) * move
            np.add.at(d_move, (gold[step - 1], gold[step]), -1)
        d_scores = share.copy()
        for step in range(steps):
            d_scores[step, index, gold[step]] -= 1
        d_scores /= rows
        flat = d_scores.reshape(-1, LABELS)
        d_both = d_scores @ w["out"].T
        xf, hf = _back(w["xf"], w["hf"], seen, kept_ahead, d_both[:, :, :HIDDEN])
        xb, hb = _back(w["xb"], w["hb"], seen[::-1], kept_back, d_both[::-1, :, HIDDEN:])
        return float((whole - path).mean()), {"xf": xf, "hf": hf, "xb": xb, "hb": hb, "out": both.reshape(-1, 2 * HIDDEN).T @ flat, "bias": flat.sum(axis=0), "move": d_move / rows}

    def train(self, seen: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> float:
        """Adam over shuffled batches; the mean loss of the last epoch."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        count, mean = 0, 0.0
        for epoch in range(epochs):
            losses = []
            rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
            order = random.permutation(len(seen))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                loss, slopes = self._step(seen[rows], gold[rows])
                losses.append(loss)
                count += 1
                size = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
                for name, slope in slopes.items():
                    slope = slope * min(1.0, 5.0 / max(size, 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * slope
                    second[name] = 0.999 * second[name] + 0.001 * slope * slope
                    self.weights[name] = (self.weights[name] - rate * (first[name] / (1 - 0.9**count)) / (np.sqrt(second[name] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Best label sequences, (rows, time), of (time, rows, LABELS) scores."""
        return viterbi(scores, self.weights["move"] + ALLOWED)


def viterbi(scores: np.ndarray, move: np.ndarray) -> np.ndarray:
    steps, rows, _ = scores.shape
    best, came = scores[0] + START, np.empty((steps, rows, LABELS), dtype=np.int8)
    for step in range(1, steps):
        routes = best[:, :, None] + move
        came[step] = routes.argmax(axis=1)
        best = np.take_along_axis(routes, came[step].astype(np.int64)[:, None, :], axis=1)[:, 0] + scores[step]
    out = np.empty((rows, steps), dtype=np.int64)
    out[:, -1] = best.argmax(axis=1)
    for step in range(steps - 1, 0, -1):
        out[:, step - 1] = came[step, np.arange(rows), out[:, step]]
    return out


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the labelled stretches; an inner label without a first one starts a stretch too."""
    out, start, kind = [], None, -1
    for at, label in enumerate([*labels.tolist(), 0]):
        same = start is not None and label and label % 2 == 0 and (label - 1) // 2 == kind
        if start is not None and not same:
            out.append((KINDS[kind], start, at))
            start = None
        if label and start is None:
            start, kind = at, (label - 1) // 2
    return out
