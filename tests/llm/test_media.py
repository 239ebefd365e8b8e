import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from keyloom.llm import media


def slow_crc(data: bytes) -> int:
    """Ogg's checksum, bit by bit."""
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@pytest.mark.parametrize("data", [b"", b"a", b"OggS" + bytes(range(256)), b"\xff" * 600])
def test_checksum(data):
    assert media.checksum(data) == slow_crc(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 255 * 576, 60_001, 400_000])
def test_round_trip(n):
    raw = bytes(random.Random(n).randbytes(n))
    payload, length, feature = media.decode(media.write(media.padded(raw), n))
    assert length == n and payload[:n] == raw and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and len(payload) >= 576
    x = np.frombuffer(payload, np.uint8)
    assert f"packets={len(payload) // 576};seconds={len(payload) / 8000:.3f};mean={x.mean():.4f}" in feature


def test_packets_across_pages_and_interleaved_streams():
    big = bytes(range(256)) * 700  # more than 255 segments
    a = media.stream_pages(1, [(b"head", 0), (big, 8000), (b"", 8000), (b"x" * 255, 16000)])
    b = media.stream_pages(2, [(b"other", 0)])
    streams = media.read(b"".join([a[0], *b, *a[1:]]))
    assert streams[1].packets == [b"head", big, b"", b"x" * 255] and streams[2].packets == [b"other"]
    assert streams[1].times[-1] == 2.0 and streams[1].ended and len(a) > 3


def test_damage_is_found():
    good = media.write(media.padded(b"abc" * 1000), 3000)
    for at in range(0, len(good), 97):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(bad))
    pages, at = [], 0
    while at < len(good):
        n = 27 + good[at + 26] + sum(good[at + 27 : at + 27 + good[at + 26]])
        pages.append(good[at : at + n])
        at += n
    for bad in (b"", good[:-1], good + b"x", b"".join(pages[:-1]), b"".join([*pages[:2], *pages[3:]]), b"".join([pages[0], *pages]), b"RIFF" + good):
        with pytest.raises((ValueError, IndexError, struct.error)):
            media.decode(bad)


def test_rows_and_features(spark):
    texts = [(1, "é" * 300), (2, None), (3, ""), (4, "long " * 500_000), (5, "é" * 300), (5, "é" * 300)]
    df = spark.createDataFrame([(*t, "c") for t in texts], "doc_id bigint, text string, feature string")
    rows = media.media_rows(df, keep_media=True).collect()
    assert len(rows) == 6
    by = {r.doc_id: r for r in rows}
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and media.decode(bytes(r.media))[0] == payload
    assert by[1][1:] == by[5][1:] and by[2][1:] == by[3][1:]
    files = spark.createDataFrame([(1, bytes(by[1].media)), (2, b"junk"), (3, None), (4, bytes(by[1].media)[:-5])], "doc_id bigint, media binary")
    out = {r.doc_id: r for r in media.features(files).collect()}
    assert out[1].feature == by[1].feature and out[1].error is None and all(out[k].feature is None and out[k].error for k in (2, 3, 4))
    assert media.media_rows(df.limit(0)).collect() == []
