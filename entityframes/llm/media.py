"""Media columns: Ogg streams written from and read back into 8-bit samples.

Writing. A payload becomes two logical streams: one of samples (8-bit unsigned mono, packets of
``PACKET`` samples) and one of index entries (for each sample packet its first sample and the CRC-32 of its
bytes). Their pages alternate in one physical stream. The serial numbers follow from the payload, so
equal payloads give equal bytes.

Reading. ``read_ogg`` walks the pages, verifies the checksum of each, demultiplexes them by serial
number, reassembles packets from the lacing values across pages, and derives the times of every packet from granule
positions: a page's position is the end of the last packet that ends on it, and the packets before that one share
the time since the last page by their sizes. A page with a wrong checksum, or a gap in a stream's page numbers, loses the packets it
carried a part of and nothing else; the losses are counted.

The checksum of Ogg is the CRC with polynomial 0x04C11DB7, most significant bit first, without
inversion. It equals the bit-reversed zlib CRC of bit-reversed bytes, which runs at C speed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

RATE, PACKET, PAGE_PACKETS = 8000, 1024, 16
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")  # capture pattern, version, flags, granule, serial, page number, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
_SAMPLES = struct.Struct("<8sIQI")  # magic, rate, samples, bytes of padding
_ENTRY = struct.Struct("<QI")
SAMPLES_MAGIC, INDEX_MAGIC = b"\x01samples", b"\x01indexes"


def ogg_crc(data: bytes) -> int:
    reflected = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def page(body: bytes, lacing: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = ogg_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lacing_of(size: int) -> bytes:
    """A packet's lacing values: 255 for each full segment, then a smaller one that ends it."""
    return b"\xff" * (size // 255) + bytes([size % 255])


@dataclass
class LogicalStream:
    """Lays the packets of one logical stream into pages of at most 255 segments."""

    serial: int
    number: int = 0
    pages: list[bytes] = field(default_factory=list)

    def write(self, packets: list[tuple[bytes, int]], flags: int = 0) -> None:
        """(packet, granule position after it); packets run on over page ends where they must."""
        lacing = b"".join(lacing_of(len(p)) for p, _ in packets)
        body = b"".join(p for p, _ in packets)
        ends, at = [], 0
        for p, granule in packets:
            at += len(p) // 255 + 1
            ends.append((at, granule))
        start = offset = 0
        continued = 0
        while start < len(lacing):
            part = lacing[start : start + 255]
            size = sum(part)
            done = [g for at, g in ends if start < at <= start + len(part)]
            over = start + len(part) >= len(lacing)
            kind = (flags & FIRST if start == 0 else 0) | (flags & LAST if over else 0) | continued
            self.pages.append(page(body[offset : offset + size], part, kind, done[-1] if done else -1, self.serial, self.number))
            self.number += 1
            continued = CONTINUED if part[-1] == 255 else 0
            start, offset = start + len(part), offset + size


def write_ogg(payload: bytes, padding: int = 0) -> bytes:
    """``payload`` as 8-bit samples; ``padding`` tells how many of its last bytes were added."""
    seed = hashlib.sha256(payload).digest()
    serial = int.from_bytes(seed[:4], "little")
    samples, index = LogicalStream(serial), LogicalStream(serial ^ 0xFFFFFFFF)
    samples.write([(_SAMPLES.pack(SAMPLES_MAGIC, RATE, len(payload), padding), 0)], FIRST)
    index.write([(INDEX_MAGIC, 0)], FIRST)
    out = [samples.pages[0], index.pages[0]]
    step = PACKET * PAGE_PACKETS
    for at in range(0, max(1, len(payload)), step):
        last = LAST if at + step >= len(payload) else 0
        cuts = [(i, payload[i : min(i + PACKET, at + step)]) for i in range(at, min(at + step, len(payload)), PACKET)] or [(0, b"")]
        for stream, packets in ((samples, [(p, i + len(p)) for i, p in cuts]), (index, [(_ENTRY.pack(i, zlib.crc32(p)), i + len(p)) for i, p in cuts])):
            before = len(stream.pages)
            stream.write(packets, last)
            out += stream.pages[before:]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # the granule position at the end of each packet
    granule: int = 0
    in_order: bool = True  # positions never go back
    pages: int = 0
    next_number: int = 0
    part: bytes | None = None  # of a packet that runs on; None if there is none or its begin is lost
    ended: bool = False


@dataclass
class Physical:
    streams: dict[int, Stream] = field(default_factory=dict)
    pages: int = 0
    bad_pages: int = 0
    lost_packets: int = 0


def read_ogg(data: bytes) -> Physical:
    found, at, n = Physical(), 0, len(data)
    while (at := data.find(b"OggS", at)) >= 0:
        if at + _HEAD.size > n:
            found.bad_pages += 1
            break
        _, version, flags, granule, serial, number, crc, segments = _HEAD.unpack_from(data, at)
        body_at = at + _HEAD.size + segments
        lacing = data[at + _HEAD.size : body_at]
        end = body_at + sum(lacing)
        raw = data[at:end]
        if version or end > n or len(lacing) < segments or ogg_crc(raw[:22] + b"\0\0\0\0" + raw[26:]) != crc:
            found.bad_pages += 1
            at += 4  # the next capture pattern may lie inside what this header claimed
            continue
        stream = found.streams.setdefault(serial, Stream())
        found.pages += 1
        stream.pages += 1
        if number != stream.next_number or (flags & CONTINUED and stream.part is None) or (not flags & CONTINUED and stream.part is not None):
            found.lost_packets += 1
            stream.part = None
        skip_first = bool(flags & CONTINUED) and stream.part is None
        stream.next_number = number + 1
        here, part = body_at, stream.part or b""
        size, before = 0, len(stream.packets)
        for k, value in enumerate(lacing):
            size += value
            if value < 255:
                if not skip_first:
                    stream.packets.append(part + data[here : here + size])
                skip_first, part, here, size = False, b"", here + size, 0
            elif k == len(lacing) - 1:
                stream.part = None if skip_first else part + data[here : here + size]
        if not lacing or lacing[-1] < 255:
            stream.part = None
        if granule >= 0:
            stream.in_order &= granule >= stream.granule
            sizes = np.cumsum([0, *(len(p) for p in stream.packets[len(stream.ends) :])])
            share = (sizes[1:] / sizes[-1] if sizes[-1] else np.ones(len(sizes) - 1)) * (granule - stream.granule)
            stream.ends += (stream.granule + np.rint(share).astype(np.int64)).tolist()
            stream.granule = granule
        elif len(stream.packets) > before:
            stream.in_order = False  # a packet ends here, so there must be a position
        stream.ended |= bool(flags & LAST)
        at = end
    return found


def packet_times(stream: Stream, rate: int) -> list[tuple[int, int]]:
    """(begin, end) of every packet after the first one of a stream, in microseconds."""
    ends = [stream.ends[0] if stream.ends else 0, *stream.ends[1:]]
    ends += [stream.granule] * (len(stream.packets) - len(ends))
    us = [e * 1_000_000 // max(1, rate) for e in ends]
    return list(zip(us[:-1], us[1:], strict=True))


@dataclass
class Decoded:
    serial: int
    samples: bytes
    ok: bool
    rate: int
    padding: int
    pages: int
    bad_pages: int
    streams: int
    packets: int
    duration_us: int
    times: list[tuple[int, int]]


def decode_all(data: bytes | None) -> tuple[Physical, list[Decoded]]:
    """Every sample stream of a file, each checked against the index stream whose serial number is its complement, if there is one."""
    physical, out = read_ogg(data or b""), []
    for serial, s in physical.streams.items():
        if not (s.packets and s.packets[0].startswith(SAMPLES_MAGIC) and len(s.packets[0]) == _SAMPLES.size):
            continue
        other = physical.streams.get(serial ^ 0xFFFFFFFF)
        index = {}
        if other and other.packets and other.packets[0] == INDEX_MAGIC:
            index = dict(_ENTRY.unpack(p) for p in other.packets[1:] if len(p) == _ENTRY.size)
        _, rate, n, padding = _SAMPLES.unpack(s.packets[0])
        starts, at = [], 0
        for p in s.packets[1:]:
            starts.append(at)
            at += len(p)
        whole = other is None or all(index.get(i) == zlib.crc32(p) for i, p in zip(starts, s.packets[1:], strict=True))
        # one sample a byte, so the last position is the number of samples
        timed = s.in_order and s.granule == n and s.ends[1:] == [i + len(p) for i, p in zip(starts, s.packets[1:], strict=True)]
        ok = whole and timed and at == n and s.ended and not physical.bad_pages and not physical.lost_packets
        us = s.granule * 1_000_000 // max(1, rate)
        out.append(Decoded(serial, b"".join(s.packets[1:]), ok, rate, padding, physical.pages, physical.bad_pages, len(physical.streams), len(s.packets), us, packet_times(s, rate)))
    return physical, out


def decode(data: bytes | None) -> Decoded:
    """The first sample stream of a file; ``decode_all`` has all of them."""
    physical, found = decode_all(data)
    return found[0] if found else Decoded(0, b"", False, 0, 0, physical.pages, physical.bad_pages, len(physical.streams), 0, 0, [])


def feature(d: Decoded) -> str:
    """Integer features, so that equal samples give equal text: level, loudness, zero crossings, histogram."""
    x = np.frombuffer(d.samples, np.uint8).astype(np.int64) - 128
    n = max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0))) if len(x) > 1 else 0
    bands = np.bincount((x + 128) >> 5, minlength=8) if len(x) else np.zeros(8, int)
    return (
        f"us={d.duration_us};rate={d.rate};streams={d.streams};pages={d.pages};packets={d.packets};mean={int(x.sum()) * 1000 // n};"
        f"power={int((x * x).sum()) * 1000 // n};crossings={crossings};bands={'/'.join(map(str, bands.tolist()))}"
    )


def with_media(docs: DataFrame, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """``docs`` with the Ogg bytes of each text: UTF-8, filled with 0 up to a positive multiple of 64.

    A null text counts as empty (64 zero bytes). All other columns stay; a column named ``out_col`` is
    replaced.
    """

    @F.pandas_udf("binary")
    def write(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass") if text else b""
            padding = -len(raw) % 64 if raw else 64
            out.append(write_ogg(raw + bytes(padding), padding))
        return pd.Series(out, dtype=object)

    return docs.withColumn(out_col, write(F.col(text_col)))


STREAMS = "number int, serial long, ok boolean, rate int, samples binary, times array<struct<begin_us:long,end_us:long>>"


def media_streams(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per sample stream of each row of ``media``: its id, the stream's number in the file, samples and packet times.

    Bytes without a sample stream give no row; damage gives ok false and what is whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, data in zip(batch["doc_id"], batch["media"], strict=True):
                found = decode_all(bytes(data) if data is not None else b"")[1]
                if found:
                    times = [[{"begin_us": a, "end_us": b} for a, b in d.times] for d in found]
                    columns = {"number": range(len(found)), "serial": [d.serial for d in found], "ok": [d.ok for d in found], "rate": [d.rate for d in found]}
                    yield pd.DataFrame({"doc_id": [doc] * len(found)} | columns | {"samples": [d.samples for d in found], "times": times})

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(run, f"doc_id {kind}, {STREAMS}")


MEDIA = (
    "ok boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "duration_us long, pages int, bad_pages int, streams int, feature string"
)


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per row of ``media``: its id and what is read back from the stored bytes.

    Null, empty and foreign bytes give ok false and an empty payload. Damage gives ok false, and the
    samples of the packets that are whole. ``n_bytes`` is the payload without its padding.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["media"]:
                data = bytes(data) if data is not None else b""
                d = decode(data)
                s = d.samples
                rows.append((
                    d.ok, max(0, len(s) - d.padding), len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-64:]), len(data),
                    hashlib.sha256(data).hexdigest(), d.duration_us, d.pages, d.bad_pages, d.streams, feature(d),
                ))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in MEDIA.split(", ")])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield plain(out, "payload_sha256", "media_sha256", "feature")

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("doc_id"), F.col(media_col).alias("media")).mapInPandas(run, f"doc_id {kind}, {MEDIA}")
