import re

import pytest

#: Columns that operators use inside; they must not get in the way.
CLASHES = ["h", "cid", "rep", "n", "keys", "score", "lang_pred", "good", "start", "length", "offset", "sequence_id", "pack_group", "segment", "words", "media", "payload", "digest", "newest", "place", "part", "plain_ok", "spans", "held_out", "token", "bucket"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()

ODD_TEXTS = [None, "", " ", "\n\t", "a", "É", "一二三 四五", "x" * 300_000, "word " * 60_000, "é́ \U0001f600 " * 5, "\x00\x01", "a\r\nb", "<|im_end|>"]


@pytest.fixture
def documents(spark):
    """Makes a documents table of texts, with columns whose names clash."""

    def make(texts, ids=None, lang="en"):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, lang, "s") + (0,) * len(CLASHES) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES))

    return make


def plain_words(text):
    """Words of a text as bytes, with A-Z in lower case."""
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0d]+", lower)


def plain_shingles(text, width=5):
    words = plain_words(text)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())
