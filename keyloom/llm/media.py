"""Media columns: payloads in Ogg files, and features of Ogg files.

``write`` puts one payload, as 8-bit samples, into an Ogg file with two logical streams: ``pcm-u8`` has a header packet and a packet for
each frame of samples, ``index`` has one packet with the unpadded length. ``read`` verifies the checksum of every page, sorts pages by
their serial number into logical streams, puts packets together from lacing values (also across pages), and gives each packet the time that
follows from the granule positions of its page: samples so far by the sample rate.

A damaged file raises ValueError with the reason. In ``media_rows`` a null payload is empty; payloads are padded with bytes 255 to a
positive multiple of the frame. Equal payloads give equal files: serial numbers are fixed. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm import textops

FRAME, RATE = 576, 8000
CONTINUED, BEGIN, END = 1, 2, 4
HEAD, HEAD_SIZE = "<4sBBqIIIB", 27
PCM, INDEX = 0x50434D38, 0x494E4458
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32 (polynomial 0x04C11DB7, most significant bit first, no inversion), by way of zlib's mirrored one."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream from (packet, granule after it). The first packet has a page of its own; no granule ends in a page: -1."""
    pages, lacing, body, granule, flags = [], bytearray(), [], -1, BEGIN

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        pages.append(page(flags | (END if last else 0), granule, serial, len(pages), bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for k, (packet, at) in enumerate(packets):
        sizes = bytes([255] * (len(packet) // 255) + [len(packet) % 255])
        done = 0
        while done < len(sizes):
            if len(lacing) == 255:
                flush(False)
                flags = CONTINUED if done else 0
            take = min(len(sizes) - done, 255 - len(lacing))
            lacing += sizes[done : done + take]
            body.append(packet[done * 255 : (done + take) * 255])
            done += take
        granule = at
        if k == 0 and len(packets) > 1:
            flush(False)
    flush(True)
    return pages


def write(payload: bytes, length: int) -> bytes:
    frames = [(payload[a : a + FRAME], a + FRAME) for a in range(0, len(payload), FRAME)]
    sound = stream_pages(PCM, [(b"\x01pcm-u8" + struct.pack("<IB", RATE, 1), 0), *frames])
    index = stream_pages(INDEX, [(b"\x01index" + struct.pack("<Q", length), 0)])
    return b"".join([sound[0], *index, *sound[1:]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    times: list[float | None] = field(default_factory=list)  # at the end of each packet, where granules tell
    granule: int = 0
    pages: int = 0
    ended: bool = False
    part: list[bytes] | None = None


def read(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEAD_SIZE:
            raise ValueError("a page header is cut short")
        magic, version, flags, granule, serial, number, crc, segments = struct.unpack_from(HEAD, data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + segments]
        start = at + 27 + segments
        end = start + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise ValueError("a page is cut short")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"checksum of the page at byte {at} is wrong")
        if bool(flags & BEGIN) == (serial in streams):
            raise ValueError(f"stream {serial:08x} begins twice or not at all")
        s = streams.setdefault(serial, Stream())
        if number != s.pages or s.ended:
            raise ValueError(f"stream {serial:08x} has a gap before page {number}")
        if bool(flags & CONTINUED) != (s.part is not None):
            raise ValueError(f"stream {serial:08x} loses a part of a packet")
        first, part, pos = len(s.packets), s.part or [], start
        fresh = s.part is None
        run = 0
        for n in lacing:
            run += n
            fresh = False
            if n < 255:
                part.append(data[pos : pos + run])
                s.packets.append(b"".join(part))
                part, pos, run, fresh = [], pos + run, 0, True
        if run:
            part.append(data[pos : pos + run])
        s.part = None if fresh or not lacing else part
        done = len(s.packets) - first
        if done and granule >= 0:  # packets of a page are of equal duration where the format says so
            step = (granule - s.granule) / done
            s.times += [(s.granule + step * (k + 1)) / RATE for k in range(done)]
            s.granule = granule
        else:
            s.times += [None] * done
        s.pages += 1
        s.ended = bool(flags & END)
        at = end
    if any(s.part is not None or not s.ended for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return streams


def decode(data: bytes) -> tuple[bytes, int, str]:
    """(payload, unpadded length, features) of a file made by ``write``."""
    streams = read(data)
    sound, index = streams.get(PCM), streams.get(INDEX)
    if sound is None or index is None or not sound.packets[0].startswith(b"\x01pcm-u8"):
        raise ValueError("not a file of samples and their index")
    payload = b"".join(sound.packets[1:])
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    high = x > 127
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    energy = [int(v) for v in np.abs(x.reshape(-1, FRAME).astype(np.int16) - 128).sum(1, dtype=np.int64)[[0, -1]]]
    feature = f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};packets={len(sound.packets) - 1};seconds={sound.times[-1]:.3f};mean={total / len(x):.4f};crossings={crossings};energy={energy[0]}-{energy[1]};peak={int(x.max())}"
    return payload, struct.unpack("<Q", index.packets[0][6:])[0], feature


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def media_rows(docs: DataFrame, *, id_col="doc_id", text_col="text", keep_media=False) -> DataFrame:
    """Per row: id and what its payload gives when it is written, read back and described; the file itself with ``keep_media``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in textops.sliced(batches, "text", 4 << 20):
            rows, files = [], []
            buf, off = textops.string_buffer(batch["text"])
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                media = write(padded(buf[a:b].tobytes()), b - a)
                payload, length, feature = decode(media)
                rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
                if keep_media:
                    files.append(media)
            out = [batch["id"], *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True))]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(files, pa.binary())] if keep_media else []), ["id", *names] + (["media"] if keep_media else []))

    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + (", media binary" if keep_media else "")
    return textops.in_small_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def features(media: DataFrame, *, id_col="doc_id", media_col="media") -> DataFrame:
    """Per row of files: id, feature and error (null, or why the file can't be read)."""
    kind = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            got, bad = [], []
            for x in batch["media"].to_pylist():
                try:
                    got.append(decode(x or b"")[2])
                    bad.append(None)
                except (ValueError, IndexError, struct.error) as e:
                    got.append(None)
                    bad.append(str(e) or "unreadable")
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(got, pa.string()), pa.array(bad, pa.string())], ["id", "feature", "error"])

    return textops.in_small_batches(media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))).mapInArrow(run, f"id {kind}, feature string, error string").withColumnRenamed("id", id_col)
