import hashlib
import zlib
from pathlib import Path

import pytest
from hypothesis import given
from hypothesis import strategies as st

from twinsift.llm import transport as ts
from twinsift.llm.queries import op2_transport_stream

from .conftest import ODD_TEXTS


@given(st.binary(max_size=2000))
def test_round_trip(data):
    media = ts.mux(ts.pad(data), len(data))
    found = ts.demux(media)
    assert found.payload == ts.pad(data) and found.length == len(data) and len(media) % ts.PACKET == 0


@pytest.mark.parametrize("size", [64, 128, 176, 192, 16_320, 16_384, 16_448, 70_016, 200_000 // 64 * 64])
def test_units_timestamps_and_random_access(size):
    data = bytes(i * 7 % 251 for i in range(size))
    found = ts.demux(ts.mux(data))
    units = -(-size // ts.UNIT_BYTES)
    assert found.payload == data and found.length is None
    assert found.pts == [i * ts.UNIT_TICKS for i in range(units)] and found.random_access == list(range(0, units, ts.RANDOM_ACCESS_EVERY))
    assert found.programs == {1: ts.PMT_PID} and found.streams == {ts.DATA_PID: ts.PRIVATE_DATA}


def test_known_checksum_and_timestamp():
    assert ts.section_crc(b"123456789") == 0x0376E6E7
    assert ts._parse_timestamp(ts._timestamp(2, (1 << 33) - 5)) == (1 << 33) - 5


def test_tables_over_several_packets():
    data = bytes(640)
    whole = ts.mux(data)
    pmt = ts._section(ts.PMT_TABLE, 1, (0xE000 | ts.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"".join(bytes([6]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for pid in range(ts.DATA_PID, ts.DATA_PID + 150)))
    assert len(pmt) > 3 * 184
    for pointer in (0, 20):
        body, packets = bytes([pointer]) + b"\xff" * pointer + pmt, []
        for i, start in enumerate(range(0, len(body), 184)):
            packets.append(bytes([ts.SYNC, (0x40 if i == 0 else 0) | ts.PMT_PID >> 8, ts.PMT_PID & 0xFF, 0x10 | i & 15]) + body[start : start + 184].ljust(184, b"\xff"))
        media = whole[: ts.PACKET] + b"".join(packets) + whole[2 * ts.PACKET :]
        found = ts.demux(media)
        assert len(found.streams) == 150 and found.payload == data
        with pytest.raises(ts.TransportError, match="section"):
            ts.demux(whole[: ts.PACKET] + b"".join(packets[:-1]) + whole[2 * ts.PACKET :])


def test_two_sections_in_a_packet():
    data = bytes(640)
    whole = ts.mux(data)
    pat = [bytearray(ts._section(ts.PAT_TABLE, 1, program.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big"))) for program, pid in ((1, ts.PMT_PID), (2, ts.PMT_PID))]
    pat[1][6] = pat[0][7] = pat[1][7] = 1
    both = b"".join(bytes(s[:-4]) + ts.section_crc(bytes(s[:-4])).to_bytes(4, "big") for s in pat)
    found = ts.demux(ts._table_packet(0, both) + whole[ts.PACKET :])
    assert found.programs == {1: ts.PMT_PID, 2: ts.PMT_PID} and found.payload == data


def test_lost_and_repeated_packets():
    media = ts.mux(bytes(5000 // 64 * 64))
    cut = lambda *at: b"".join(media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET) if i // ts.PACKET not in at)
    with pytest.raises(ts.TransportError, match="continuity"):
        ts.demux(cut(7))
    assert ts.demux(cut(7), strict=False).discontinuities >= 1
    twice = media[: 8 * ts.PACKET] + media[7 * ts.PACKET :]
    found = ts.demux(twice)
    assert found.repeated == 1 and found.payload == bytes(5000 // 64 * 64)


def test_broken_streams():
    media = bytearray(ts.mux(bytes(640)))
    with pytest.raises(ts.TransportError, match="size"):
        ts.demux(bytes(media[:-1]))
    with pytest.raises(ts.TransportError, match="size"):
        ts.demux(b"")
    wrong = bytearray(media)
    wrong[ts.PACKET] = 0
    with pytest.raises(ts.TransportError, match="synchronisation"):
        ts.demux(bytes(wrong))
    wrong = bytearray(media)
    wrong[10] ^= 1
    with pytest.raises(ts.TransportError, match="checksum"):
        ts.demux(bytes(wrong))


def test_columns(documents):
    texts = [*ODD_TEXTS, "same", "same"]
    rows = {r["doc_id"]: r for r in ts.read_media(ts.to_media(documents(texts))).collect()}
    for i, text in enumerate(texts):
        data = (text or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        row = rows[i]
        assert (row["n_bytes"], row["payload_bytes"], row["payload_sha256"], row["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert row["media_bytes"] > len(padded) and row["random_access"][0] == 0
    assert rows[len(texts) - 1]["media_sha256"] == rows[len(texts) - 2]["media_sha256"] and rows[len(texts) - 1]["feature"] == rows[len(texts) - 2]["feature"]
    assert ts.read_media(ts.to_media(documents([]))).count() == 0
    assert ts.read_media(ts.to_media(documents(["a", "a"], [None, None]))).count() == 2


def test_null_media_and_all_random_access_points(spark):
    found = ts.demux(ts.mux(bytes(64 * ts.UNIT_BYTES)))
    assert len(found.random_access) == 16 and f"random_access={','.join(map(str, range(0, 64, 4)))}/16" in ts.describe(found)
    rows = ts.read_media(spark.createDataFrame([(1, None, 2)], "doc_id long, media binary, feature int")).collect()
    assert rows[0]["doc_id"] == 1 and rows[0]["payload_sha256"] is None and rows[0]["pts"] is None


def test_query_reads_stored_media(spark):
    path = "/root/testdata/sf0.001"
    Path(path).exists() or pytest.skip("needs the given tables")
    rows = {r["doc_id"]: r for r in op2_transport_stream(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for doc in docs:
        data = (doc["text"] or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        row = rows[doc["doc_id"]]
        assert (row["n_bytes"], row["payload_sha256"], row["media_sha256"]) == (len(data), hashlib.sha256(padded).hexdigest(), hashlib.sha256(ts.mux(padded, len(data))).hexdigest())
        assert len(row["pts"]) == -(-len(padded) // ts.UNIT_BYTES) and row["random_access"] == list(range(0, len(row["pts"]), ts.RANDOM_ACCESS_EVERY))
