"""Media columns: Ogg.

A payload of 8-bit samples goes into an Ogg column, samples dealt in packets of 576
to two logical streams, and comes back by verifying each page's checksum,
reassembling packets from lacing values, demultiplexing the streams and ordering
packets by the times that granule positions give.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common
from .shingles import batches_of

#: Fixed values of the format: page header, checksum polynomial 0x04C11DB7 (bits
#: unreflected, start 0), header flags.
PAGE = "<4sBBqIIIB"
PAGE_BYTES = 27
CONTINUED, FIRST, LAST = 1, 2, 4
#: Of this operator: samples in a packet, samples a second, packets in a page.
PACKET, RATE, PACKETS_A_PAGE, STREAMS = 576, 48_000, 64, 2
#: Of op3's contract: payload bytes that tail_crc32 is about.
TAIL = 32

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 over unreflected bits from 0: zlib's over the mirrored bytes, mirrored."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack(PAGE, b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def write(payload: bytes) -> bytes:
    """An Ogg file of the payload, a positive multiple of PACKET bytes. Packet k goes
    to stream k mod 2; its end time in samples is the granule position of the page
    it ends on. Each stream opens with a header page."""
    n = len(payload) // PACKET
    used = min(STREAMS, n)
    pages = [_page(FIRST, 0, s + 1, 0, b"\x08", struct.pack("<II", RATE, PACKET)) for s in range(used)]
    lacing_one = bytes([255] * (PACKET // 255) + [PACKET % 255])
    at = [0] * used
    for lot in range(0, -(-n // used), PACKETS_A_PAGE):
        for s in range(used):
            mine = range(lot * used + s, min(n, (lot + PACKETS_A_PAGE) * used), used)
            if not mine:
                continue
            at[s] += 1
            ends = LAST if mine[-1] + used >= n else 0
            body = b"".join(payload[k * PACKET : (k + 1) * PACKET] for k in mine)
            pages.append(_page(ends, (mine[-1] + 1) * PACKET, s + 1, at[s], lacing_one * len(mine), body))
    return b"".join(pages)


def read(media: bytes) -> tuple[bytes, dict]:
    """(payload, facts). Raises ValueError on a page that is broken, missing or out of
    order, and on a packet that doesn't end."""
    at, serials, packets, pages = 0, {}, [], 0
    while at < len(media):
        if len(media) - at < PAGE_BYTES:
            raise ValueError("a page is cut off")
        magic, version, flags, granule, serial, number, crc, n_lacing = struct.unpack_from(PAGE, media, at)
        if magic != b"OggS" or version:
            raise ValueError("no page where one should be")
        lacing = media[at + PAGE_BYTES : at + PAGE_BYTES + n_lacing]
        body_at = at + PAGE_BYTES + n_lacing
        end = body_at + sum(lacing)
        if end > len(media) or len(lacing) < n_lacing:
            raise ValueError("a page is cut off")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("a page's checksum is wrong")
        if bool(flags & FIRST) != (serial not in serials):
            raise ValueError("a stream's first page is missing or repeated")
        stream = serials.setdefault(serial, {"next": 0, "open": b"", "packets": [], "ended": False})
        if number != stream["next"] or stream["ended"] or bool(flags & CONTINUED) != bool(stream["open"]):
            raise ValueError("a page is missing")
        stream["next"] += 1
        done, open_, from_ = [], [stream["open"]], body_at
        size = 0
        for v in lacing:
            size += v
            if v < 255:
                open_.append(media[from_ : from_ + size])
                done.append(b"".join(open_))
                from_, size, open_ = from_ + size, 0, []
        open_.append(media[from_ : from_ + size])
        stream["open"] = b"".join(open_)
        stream["ended"] = bool(flags & LAST)
        if number == 0:
            stream["rate"], stream["packet"] = struct.unpack("<II", done[0])
        elif done:
            stream["packets"].append((granule, done))
        pages += 1
        at = end
    stride = len(serials)
    for serial, s in serials.items():
        if s["open"] or not s["ended"]:
            raise ValueError("a stream doesn't end")
        for granule, done in s["packets"]:  # the granule is the last packet's end
            last = granule // s["packet"] - 1
            for k, p in enumerate(done):
                packets.append((last - stride * (len(done) - 1 - k), serial, p))
    packets.sort(key=lambda x: x[:2])
    rate = next(iter(serials.values()))["rate"] if serials else RATE
    top = max((g for s in serials.values() for g, _ in s["packets"]), default=0)
    return b"".join(p for _, _, p in packets), {"streams": stride, "pages": pages, "packets": len(packets), "ms": top * 1000 // rate}


def _encode(batches):
    for b in batches:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        for lo, hi in batches_of(texts):
            out = [write(t + b"\xff" * (max(1, -(-len(t) // PACKET)) * PACKET - len(t))) for t in texts[lo:hi]]
            yield pa.record_batch([b.column(0)[lo:hi], pa.array([len(t) for t in texts[lo:hi]], pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(payload: bytes, facts: dict) -> str:
    x = np.frombuffer(payload, np.uint8)
    high = x >= 128
    crossing = int(np.count_nonzero(high[1:] != high[:-1]))
    share = np.sort(np.bincount(x, minlength=256))
    share = share[share > 0] / len(x)
    entropy = float(-(share * np.log2(share)).sum())
    # packets in lots, as their squares take eight bytes a sample
    lots = np.split(x.reshape(-1, PACKET), range(1024, len(x) // PACKET, 1024))
    loud = max(int(np.square(f, dtype=np.int64).sum(axis=1).max()) for f in lots) // PACKET
    return f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']};ms={facts['ms']};mean={int(x.sum(dtype=np.int64)) // len(x)};peak={int(x.max())};loudest={loud};crossings={crossing};entropy={entropy:.3f}"


def _decode(batches, tail: int):
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for cell in b.column(2):  # one file at a time in Python's memory
            m = cell.as_py()
            payload, facts = read(m)
            row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(m), hashlib.sha256(m).hexdigest(), _features(payload, facts))
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        yield pa.record_batch(
            [b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def ogg_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as the samples of an Ogg file, null as empty.

    The payload is the UTF-8 text with bytes 255 up to a positive multiple of 576.
    Every row stays, repeated ones and null ids too; other columns are ignored.
    """
    return common.id_text(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def ogg_features(media: DataFrame, tail: int = PACKET) -> DataFrame:
    """Of (doc_id, n_bytes, media): the payload read back, its digests, tail_crc32 being
    of its last `tail` bytes, and features (streams, pages, packets, milliseconds, mean
    and peak sample, loudest packet's mean square, crossings of the middle, entropy).
    Equal files give equal values; a broken file fails with ValueError."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(partial(_decode, tail=tail), out)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg_features(common.written(ogg_column(common.documents(spark, sf_dir))), TAIL)
