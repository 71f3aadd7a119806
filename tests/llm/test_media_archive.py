import hashlib
import zlib

import numpy as np
import pytest

from issuelens.llm import gif
from issuelens.llm.warc import new_archive, read_archive, record_index, write_archive


def test_lzw_round_trips(rng):
    for n in (0, 1, 2, 3, 255, 4000, 30_000):
        for letters in (1, 2, 7, 256):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert gif.lzw_decode(gif.lzw_encode(data), 8) == data


def test_lzw_of_a_known_stream():
    # Fixed value: the image data of the ten by ten sample picture that GIF tutorials use.
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    got = np.frombuffer(gif.lzw_decode(stream, 2), np.uint8).reshape(10, 10)
    assert (got[0] == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]).all() and (got[3] == [1, 1, 1, 0, 0, 0, 0, 2, 2, 2]).all()
    assert (got[9] == [2, 2, 2, 2, 2, 1, 1, 1, 1, 1]).all()


def frame(value, rows, columns, left=0, top=0, disposal=1, transparent=None, delay=3):
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)
    samples = np.full((rows, columns), value, np.uint8)
    return gif.Frame(left, top, samples, palette, delay, disposal, transparent)


def test_disposal_and_transparency():
    hole = frame(9, 2, 2, 1, 1, 3)
    hole.samples[0, 0] = 7
    hole.transparent = 7
    frames = [frame(5, 4, 4), hole, frame(200, 1, 4, disposal=2), frame(1, 1, 1, 3, 3)]
    width, height, got = gif.decode(gif.encode(4, 4, frames))
    pictures = [p[..., 0].copy() for p in gif.shown(width, height, got)]
    assert (pictures[0] == 5).all()
    assert pictures[1][1, 1] == 5 and pictures[1][2, 2] == 9
    assert (pictures[2][0] == 200).all() and pictures[2][2, 2] == 5
    assert (pictures[3][0] == 0).all() and pictures[3][3, 3] == 1
    assert [f.delay for f in got] == [3] * 4 and gif.histogram(np.zeros((4, 4, 3), np.uint8)).sum() == 16


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        gif.decode(b"GIF89a\x01")
    with pytest.raises(ValueError):
        gif.decode(b"PNG...")


def test_media_of_odd_rows(odd_docs, no_docs, odd_rows):
    media = gif.store_media(odd_docs)
    rows = gif.media_digests(media).collect()
    want = []
    for i, t in odd_rows:
        n, payload = gif.padded(t)
        want.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    frames = gif.frame_table(media).collect()
    long_frames = sorted((r for r in frames if r.doc_id == 5), key=lambda r: r.frame)
    assert len(long_frames) > 10 and all(a.starts_cs + a.delay_cs == b.starts_cs for a, b in zip(long_frames, long_frames[1:], strict=False))
    assert b"".join(r.samples for r in long_frames) == gif.padded(dict(odd_rows)[5])[1]
    assert gif.media_digests(gif.store_media(no_docs)).count() == 0


PAGES = [
    (5, "u5", "x" * 200), (3, "u3", "x" * 200), (9, None, "x" * 200), (1, "u\r\nX: y", "short"), (2, "u2", "short"), (4, "u4", None),
    (None, "u", "x" * 200), (3, "u3", "x" * 200), (7, "ü", "é" * 60), (8, "ü", "é" * 60), (6, "u6", ""),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "clash") for r in PAGES], "page_id long, url string, html string, digest string")


def test_archive_round_trip(spark, pages):
    folder = new_archive(spark)
    write_archive(pages, folder)
    records = read_archive(spark, folder)
    got = record_index(records).collect()
    for r in got:
        text = {p: (h or "") for p, _, h in PAGES}[r.page_id]
        payload = text.encode()
        assert r.payload_digest == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert by[3] == [("response", None)] * 2 and by[5] == by[9] == [("revisit", 3)] and by[None] == [("revisit", 3)]
    assert by[1] == by[2] == [("response", None)] and by[7] == [("response", None)] and by[8] == [("revisit", 7)]
    assert spark.read.parquet(f"{folder}/payloads").count() == len({h or "" for _, _, h in PAGES})
    for r in records.collect():
        header, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(dict(x.split(b": ", 1) for x in header.split(b"\r\n")[1:])[b"Content-Length"])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n")
        body = rest[:-4].partition(b"\r\n\r\n")[2]
        assert body == (b"" if b"WARC-Type: revisit" in header else bytes(r.payload))


def test_archive_detects_damage(spark, pages):
    folder, other = new_archive(spark), new_archive(spark)
    write_archive(pages, folder)
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{other}/headers")
    spark.read.parquet(f"{folder}/payloads").selectExpr("digest", "cast('no' as binary) payload").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        read_archive(spark, other).collect()


def test_empty_archive(spark, pages):
    folder = new_archive(spark)
    write_archive(pages.where("false"), folder)
    assert record_index(read_archive(spark, folder)).count() == 0
