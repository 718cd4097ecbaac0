import hashlib

import pytest

from twinsift.llm import warc

PAYLOADS = [None, "", "short", "short", "é" * 600, "é" * 600, "é" * 600, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "z" * 200_000]


def pages(spark, payloads, ids=None):
    ids = range(len(payloads)) if ids is None else ids
    rows = [(i, None if n % 4 == 0 else f"http://h/é {n}\r\nX: y", p, 1, 2) for n, (i, p) in enumerate(zip(ids, payloads, strict=True))]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int, digest int")


def expected(rows):
    out = []
    for i, p in rows:
        data = (p or "").encode()
        newest = max(j for j, q in rows if (q or "") == (p or ""))
        revisit = len(data) >= 1000 and newest != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", newest if revisit else None))
    return sorted(out)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 22])
def test_round_trip(spark, archive_bytes):
    df = pages(spark, PAYLOADS)
    archives = warc.write_archives(warc.plan_records(df), warc.sample_dictionary(df), archive_bytes)
    found = warc.read_archives(archives, with_payload=True).collect()
    assert sorted(tuple(r)[:5] for r in found) == expected(list(enumerate(PAYLOADS)))
    assert all(r["payload"] == (b"" if r["record_type"] == "revisit" else (PAYLOADS[r["page_id"]] or "").encode()) for r in found)


def test_trained_dictionary_and_files(spark, tmp_path):
    payloads = [f"<html><head><title>page {i}</title></head><body>" + f"<p>some common text, number {i * 7919}</p>" * 30 for i in range(300)]
    df = pages(spark, payloads)
    dictionary = warc.sample_dictionary(df)
    assert dictionary and warc.sample_dictionary(df) == dictionary
    archives = warc.write_archives(warc.plan_records(df), dictionary)
    assert warc.save_archives(archives, str(tmp_path)) == len(list(tmp_path.glob("*.warc.zst"))) > 0
    loaded = warc.load_archives(spark, f"file://{tmp_path}")
    assert warc.read_archives(loaded).count() == 300
    data = loaded.first()["data"]
    held, start = warc.load_dictionary(data)
    assert held.as_bytes() == dictionary and warc.frame_end(data, start) <= len(data)


def test_repeated_rows_and_null_ids(spark):
    df = pages(spark, ["q" * 2000] * 4, [5, 9, 9, None])
    found = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(warc.write_archives(warc.plan_records(df), b"")).collect()), key=str)
    assert found == [(5, "revisit", 9), (9, "response", None), (9, "response", None), (None, "revisit", 9)]
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages(spark, [])), warc.sample_dictionary(pages(spark, [])))).count() == 0


def test_revisits_are_shuffled_without_payloads(spark, monkeypatch):
    """Whatever the bitmaps pass, the records are the same, and no exchange carries a payload."""
    from twinsift.llm import bitmap

    texts = [f"{k} " * 700 for k in (1, 1, 2, 3, 3, 3)] + ["short"] * 3 + [None, "", f"{1} " * 700]
    df = pages(spark, texts, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 2])
    want = [(1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 6), (5, "revisit", 6), *((i, "response", None) for i in range(6, 12))]
    for power in (bitmap.SMALLEST, 1):
        monkeypatch.setattr(bitmap, "SMALLEST", 6 if power == 1 else power)
        monkeypatch.setattr(bitmap, "LARGEST", 6 if power == 1 else 27)
        planned = warc.plan_records(df)
        rows = warc.read_archives(warc.write_archives(planned, b""), with_payload=True).collect()
        assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in rows), key=str) == sorted(want, key=str)
        assert all(bytes(r["payload"]).decode() == ("" if r["record_type"] == "revisit" else texts[min(r["page_id"], 11) - 1] or "") for r in rows)


def test_validation():
    good = warc.record(1, "http://x", b"abc", 3, hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.read_record(good)[:2] == (1, 3)
    for wrong in (good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"X-Date"), good + b"x", good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Type: response", b"WARC-Type: nothing"), good.replace(b"HTTP/1.1", b"SMTP/1.1")):
        with pytest.raises(warc.ArchiveError):
            warc.read_record(wrong)
    revisit = warc.record(1, "http://x", b"", 3, hashlib.sha1(b"abc").hexdigest(), 4)
    assert warc.read_record(revisit)[3:5] == ("revisit", 4)
    with pytest.raises(warc.ArchiveError):
        warc.read_record(revisit.replace(b"WARC-Refers-To", b"X-Refers-To-It"))


def test_broken_archives():
    import zstandard

    frame = zstandard.ZstdCompressor().compress(b"record")
    assert list(warc.records(warc.dictionary_frame(b"") + frame * 3)) == [b"record"] * 3
    for wrong in (b"", frame, warc.dictionary_frame(b"") + frame[:-1], warc.dictionary_frame(b"no dictionary") + frame, warc.dictionary_frame(b"") + b"junkjunk"):
        with pytest.raises(warc.ArchiveError):
            list(warc.records(wrong))
