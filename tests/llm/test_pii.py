import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm import pii, tagger

from .conftest import ODD_TEXTS

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CHECKS = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": pii.is_card, "phone": pii.is_phone}


def brute(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if CHECKS[k](m[0])]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


EXAMPLES = [
    "a@b.c_d@e.f", "x.y+z@host.co.uk.", "a@b", "@b.c", "a@@b.c", "a@b..c", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "999.1.2.3", "1.2.3", "01.002.255.256", "1.2.3.0000000000000000000000000000255", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111111111111111 5500005555555559", "+49 (170) 123-4567.", "+1", "+12345678", "+1234567890123456", "++49 170 1234567+1", "5", "é4111111111111111é",
]


@pytest.mark.parametrize("text", EXAMPLES)
def test_rules_like_plain_patterns(text):
    assert pii.rule_spans(text) == brute(text)


@settings(max_examples=400)
@given(st.text(alphabet="ab0129@.+-_% ()\né", max_size=60))
def test_rules_like_plain_patterns_on_any_text(text):
    assert pii.rule_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+1" * 100_000, "a." * 200_000 + "@x"):
        pii.rule_spans(text)


def test_gradients():
    model = tagger.Tagger.fresh(3)
    random = np.random.default_rng(0)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    seen, gold = random.integers(0, tagger.CLASSES, (3, 9)), np.zeros((3, 9), dtype=np.int64)
    gold[0, 2], gold[0, 3], gold[1, 4] = 1, 2, 5
    loss, slopes = model._step(seen, gold)
    for name in slopes:
        flat = model.weights[name].reshape(-1)
        for at in random.integers(0, flat.size, 4):
            kept = flat[at]
            flat[at] = kept + 1e-2
            more = model._step(seen, gold)[0]
            flat[at] = kept - 1e-2
            less = model._step(seen, gold)[0]
            flat[at] = kept
            assert abs((more - less) / 2e-2 - slopes[name].reshape(-1)[at]) < 2e-2, name


def test_viterbi_like_brute_force():
    import itertools

    random = np.random.default_rng(2)
    scores, move = random.standard_normal((4, 1, tagger.LABELS)), random.standard_normal((tagger.LABELS, tagger.LABELS)) + tagger.ALLOWED
    best = max(itertools.product(range(tagger.LABELS), repeat=4), key=lambda p: tagger.START[p[0]] + sum(scores[i, 0, p[i]] for i in range(4)) + sum(move[a, b] for a, b in zip(p, p[1:], strict=False)))
    assert tuple(tagger.viterbi(scores, move)[0]) == best


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.made_windows(900))


def test_held_out_windows(model):
    finder, right, found, there = pii.Finder(model), 0, 0, 0
    windows = pii.made_windows(250, seed=77)
    decoded = finder._decode([text for text, _ in windows])
    for text, spans in windows:
        own = set(tagger.spans_of(decoded[text][: len(text)]))
        want = {(k, max(0, a), min(b, len(text))) for k, a, b in spans}
        right, found, there = right + len(own & want), found + len(own), there + len(want)
    assert right / found > 0.85 and right / there > 0.8


def test_added_spans(model):
    finder = pii.Finder(model)
    text = "word " * 40 + "call (555) 123-4567 today, " + "word " * 40
    ((rules, added),) = finder.find([text])
    assert rules == [] and [(k, text[a:b]) for k, a, b in added] == [("phone", "(555) 123-4567")]
    clean = "Version 2.0 of 1999, chapter 3. Room 12, 25 people, 1,234 things."
    assert finder.find([clean, None, ""]) == [([], []), ([], []), ([], [])]


def test_overlapping_windows_agree_on_long_texts(model):
    text = "".join(f"word{'s' * (i % 7)} a{i}@host.com and +49 170 {1234567 + i}; " for i in range(300))
    ((rules, added),) = pii.Finder(model).find([text])
    assert rules == brute(text) and not added


def test_spans_are_read_to_their_ends(model, monkeypatch):
    """A span that runs out of the windows around its digit is followed, however long it is."""
    finder = pii.Finder(model)

    def decode(pieces):
        out = {}
        for piece in dict.fromkeys(pieces):
            labels = np.zeros(tagger.WINDOW, dtype=np.int64)
            for i, char in enumerate(piece):
                inside = char not in " \n"
                labels[i] = 0 if not inside else (1 if i == 0 or piece[i - 1] in " \n" else 2)
            out[piece] = labels
        return out

    monkeypatch.setattr(finder, "_decode", decode)
    for left, right in ((0, 0), (5, 300), (300, 5), (1000, 3000)):
        text = "words of a clean text " * 20 + "x" * left + "7" + "y" * right + " and more clean words" * 20
        starts = pii.windows_of(text)
        spans = [span for span, _ in finder._read(text, starts, decode([text[s : s + tagger.WINDOW] for s in starts]))]
        low = text.index("7") - left
        assert ("email", low, low + left + 1 + right) in spans
    text = "z" * 20_000 + "7"
    starts = pii.windows_of(text)
    ((span, _),) = finder._read(text, starts, decode([text[s : s + tagger.WINDOW] for s in starts]))
    assert span == ("email", 0, 20_001)


def test_training_windows_come_from_whole_texts(documents):
    text = " ".join(f"item {i} of a long list," for i in range(400)) + " call +49 170 1234567 now"
    docs = documents([text.replace("item", f"item{k}") for k in range(60)])
    found = pii.training_windows(docs)
    assert len(found) <= 60 * pii.WINDOWS_OF_TEXT and any("39" in window for window, _ in found) and len({window[:4] for window, _ in found}) > 3


def test_queries_rows(documents, model):
    texts = [*ODD_TEXTS, *EXAMPLES, EXAMPLES[0]]
    rows = {r["doc_id"]: r for r in pii.find_pii(documents(texts), model).collect()}
    for i, text in enumerate(texts):
        want = brute(text)
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert rows[i]["base_sha256"] == hashlib.sha256(pii.listed(want).encode()).hexdigest()
        assert set(pii.listed(want).split(",")) <= set(rows[i]["spans"].split(","))
    assert pii.find_pii(documents([]), model).count() == 0


def test_training_on_a_table(documents):
    found = pii.training_windows(documents(EXAMPLES * 2 + ["clean"] + [None]))
    assert found and all(len(text) <= tagger.WINDOW for text, _ in found)
    assert pii.training_windows(documents([])) == []


def test_masking(documents, model):
    docs = documents(["mail a@b.cd now", None, "", "clean"]).withColumnRenamed("h", "n_chars")
    rows = pii.mask_pii(docs, model, length_col="n_chars").orderBy("doc_id").collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("mail [EMAIL] now", 16), (None, None), ("", 0), ("clean", 5)]
    assert rows[0].asDict().keys() == docs.first().asDict().keys()
    assert pii.masked("0123456789", [("ip", 2, 5), ("card", 4, 8)]) == "01[IP]89"
