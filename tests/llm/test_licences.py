import re

from twinsift.llm import licences

from .conftest import ODD_TEXTS

NOTICE = "Licensed under the Apache License, Version 2.0."


def plain(texts):
    """The scan without size bounds and anchor words."""
    known = [(name, set(licences.bigrams_of(text))) for name, text in licences.TEMPLATES]
    out = {}
    for i, text in enumerate(texts):
        segments = {text, *re.split(r"\n\s*\n", text), *text.split("\n"), *re.split(r"(?<=[.!?])\s+", text)} if text is not None else ()
        for segment in segments:
            own, best = set(licences.bigrams_of(segment)) if len(segment) < 100_000 else set(), {}
            for name, grams in known:
                if own and 200 * len(own & grams) >= 75 * (len(own) + len(grams)):
                    best[name] = max(best.get(name, 0), 2 * len(own & grams) / (len(own) + len(grams)))
            for name, dice in best.items():
                top, count = out.get((i, name), (0, 0))
                out[i, name] = (max(top, round(dice, 6)), count + 1)
    return out


def variants():
    texts = []
    for _, text in licences.TEMPLATES:
        words = text.split()
        texts += [text, text.upper(), " ".join(words[: len(words) * 3 // 4 + 1]), " ".join(words + ["more"] * (len(words) // 4)), " ".join(w if i % 9 else "changed" for i, w in enumerate(words)), f"First line.\n{text}\nLast line.", f"Before\n\n{text}\n\nafter"]
    return texts


def test_like_the_plain_scan(documents):
    texts = [*ODD_TEXTS, *variants(), "license", "no such thing under the sun", NOTICE + "\n" + NOTICE.lower()]
    found = {(r["doc_id"], r["licence"]): (r["dice"], r["segments"]) for r in licences.scan(documents(texts)).collect()}
    assert found == plain(texts) and len(found) > 100


def test_anchor_words_lose_nothing():
    anchors = set(licences.anchor_words(licences.TEMPLATES, 75))
    for text in variants():
        own = set(licences.bigrams_of(text))
        for _, template in licences.TEMPLATES:
            grams = set(licences.bigrams_of(template))
            if 200 * len(own & grams) >= 75 * (len(own) + len(grams)):
                assert anchors & set(licences.words_of(text))


def test_repeated_rows_ids_and_empty_tables(documents):
    rows = licences.scan(documents([NOTICE, NOTICE, NOTICE], [1, 1, None])).collect()
    assert sorted(((r["doc_id"], r["licence"], r["dice"], r["segments"]) for r in rows), key=str) == sorted([(1, "Apache-2.0", 1.0, 2), (None, "Apache-2.0", 1.0, 1)], key=str)
    assert licences.scan(documents([])).count() == 0


def test_no_python_on_the_way(documents):
    plan = licences.scan(documents([NOTICE]))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


#: Notices as they are published, in several paragraphs of short lines.
PUBLISHED = {
    "MIT": [r"(?=The above copyright)", r"(?=THE SOFTWARE IS PROVIDED)"],
    "BSD-2-Clause": [r"(?=1\. Redist)", r"(?=2\. Redist)"],
    "Apache-2.0": [r"(?=You may obtain)", r"(?=http:)", r"(?=Unless required)", r"(?=See the License)"],
}


def published(name, text):
    parts = re.split("|".join(PUBLISHED.get(name, [r"(?!)"])), text)
    return "\n\n".join(re.sub(r"(.{50,70}?) ", r"\1\n", part.strip()) for part in parts)


def test_published_layouts_inside_long_texts(documents):
    code = "\n\n".join(f"def area_{i}(width, height):\n    scaled = width * {i}\n    return scaled + height" for i in range(40))
    texts = [layout for name, text in licences.TEMPLATES for layout in (f"{published(name, text)}\n\n{code}", f"{code}\n\n{published(name, text)}\n{code}", "/*\n * " + published(name, text).replace("\n", "\n * ") + f"\n */\n{code}")]
    found = {(r["doc_id"], r["licence"]): r for r in licences.scan(documents(texts)).collect()}
    for i in range(len(texts)):
        assert found[i, licences.TEMPLATES[i // 3][0]]["dice"] > 0.75
    full = next(i for i, (name, text) in enumerate(licences.TEMPLATES) if name == "MIT" and len(text) > 500)
    assert (found[3 * full, "MIT"]["dice"], found[3 * full, "MIT"]["segments"]) == (1.0, 1) and (3 * full, "MIT") not in plain(texts)


def test_passages_like_all_runs_and_ranges(documents):
    templates = [("A", "one two three four five six seven eight"), ("B", "one two nine three four")]
    words = "one two three four five six seven eight nine red x".split()
    marks = [" ", "\n", " ", ". ", "\n\n", " ", " "]
    texts = ["red one two red\none two three\nfour five one. six seven", "x one two three four five six seven eight x one two nine\n\nthree four red"]
    texts += ["".join(words[(i * k + i // (k % 5 + 2)) % 9] + marks[i * (k + 2) % 7] for i in range(40)) for k in range(1, 25)]
    want, whole = {}, set()
    for i, text in enumerate(texts):
        pieces = [licences.words_of(piece) for piece in re.split(r"\n|(?<=[.!?])\s+", text)]
        own = [word for piece in pieces for word in piece]
        runs = [[word for piece in pieces[a:b] for word in piece] for a in range(len(pieces)) for b in range(a + 1, len(pieces) + 1)]
        for name, template in templates:
            grams, length = set(licences.bigrams_of(template)), len(licences.words_of(template))
            dice = lambda ws: 2 * len((g := set(licences.bigrams_of(" ".join(ws)))) & grams) / (len(g) + len(grams))  # noqa: E731, B023
            best = max(map(dice, runs + [own[s : s + length] for s in range(max(1, len(own) - length + 1))]))
            if best >= 0.5:
                want[i, name] = round(best, 6)
            if max(map(dice, map(licences.words_of, {text, *re.split(r"\n\s*\n", text), *text.split("\n"), *re.split(r"(?<=[.!?])\s+", text)}))) >= 0.5:
                whole.add((i, name))
    found = {(r["doc_id"], r["licence"]): r["dice"] for r in licences.scan(documents(texts), templates=templates, percent=50).collect()}
    assert found.keys() == want.keys() and {k: v for k, v in found.items() if k not in whole} == {k: v for k, v in want.items() if k not in whole} and len(found.keys() - whole) >= 2


def test_long_segments_like_sql(spark, documents):
    """A line of very many words but few distinct bigrams counts in both."""
    import duckdb

    line = "Released under the MIT License. " * 600
    texts = [line, "Released under the MIT License.\n" * 600, "Licensed under the MIT License"]
    found = sorted((r["doc_id"], r["licence"], r["dice"], r["segments"]) for r in licences.scan(documents(texts)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    assert found == sorted(con.execute(f"SELECT doc_id, licence, dice, segments FROM ({licences.sql()})").fetchall())
    assert next(row for row in found if row[0] == 0)[3] >= 2
