"""Ogg media columns: page checksums, lacing, logical streams and granule timestamps.

mux() stores a payload of 8-bit samples: packets of PACKET samples are dealt in turn to STREAMS
logical streams, whose pages follow each other in one physical stream. demux() reads any Ogg bytes:
each page's CRC is verified, packets are put together from lacing values over page borders, streams
are kept apart by serial number, and a packet's time follows from its page's granule position.

Defined results: null and empty texts are 64 zero bytes; damage never raises, pages that fail are
counted and skipped, and packets that lose a part are dropped; equal texts give equal values, as
serial numbers come from the payload; repeated rows are coded one by one; an empty table gives an
empty one; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodestrand.llm import common

UNIT = 64
RATE = 8000
PACKET = 4096
STREAMS = 2
HEADER = struct.Struct("<4sBBqIIIB")
INFO = struct.Struct("<8sIBBQ")
CONTINUED, FIRST, LAST = 1, 2, 4

_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def crc(raw: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, highest bit first, from 0. zlib's runs lowest bit first,
    so it gets the bytes mirrored, and its result is mirrored back."""
    return int(f"{zlib.crc32(raw.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    check = struct.pack("<I", crc(head + body))
    return head[:22] + check + head[26:] + body


def pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream; packets: (bytes, granule position at its end). The first packet, its header, has a page of its own."""
    out: list[bytes] = []
    lacing, body, granule, open_packet = bytearray(), bytearray(), -1, False

    def flush(last: bool = False) -> None:
        nonlocal lacing, body, granule, open_packet
        flags = CONTINUED * open_packet | FIRST * (not out) | LAST * last
        out.append(page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        open_packet = bool(lacing) and lacing[-1] == 255
        lacing, body, granule = bytearray(), bytearray(), -1

    for k, (packet, end) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = 0
        while values:
            room = 255 - len(lacing)
            now, values = values[:room], values[room:]
            size = sum(now)
            lacing += now
            body += packet[at : at + size]
            at += size
            if not values:
                granule = end
            if len(lacing) == 255 and (values or k + 1 < len(packets)):
                flush()
        if k == 0 and len(packets) > 1:
            flush()
    flush(last=True)
    return out


def mux(payload: bytes) -> bytes:
    serial = zlib.crc32(payload)
    streams = []
    for s in range(STREAMS):
        own = (serial + s) & 0xFFFFFFFF
        granule, packets = 0, [(INFO.pack(b"RAWPCM8\0", RATE, s, STREAMS, len(payload)), 0)]
        for at in range(s * PACKET, len(payload), STREAMS * PACKET):
            part = payload[at : at + PACKET]
            granule += len(part)
            packets.append((part, granule))
        streams.append(pages(packets, own))
    longest = max(map(len, streams))
    return b"".join(x[k] for k in range(longest) for x in streams if k < len(x))


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: The granule position at each packet's end; -1 where no page tells.
    granules: list[int] = field(default_factory=list)
    ended: bool = False
    next_page: int | None = None
    partial: bytearray | None = None


@dataclass
class Media:
    streams: dict[int, Stream]
    n_pages: int
    n_bad: int


def demux(raw: bytes) -> Media:
    """All logical streams of a physical stream, in order of their first pages."""
    streams: dict[int, Stream] = {}
    at = n_pages = n_bad = 0
    while (at := raw.find(b"OggS", at)) >= 0 and at + HEADER.size <= len(raw):
        _, version, flags, granule, serial, number, check, n = HEADER.unpack_from(raw, at)
        first = at + HEADER.size + n
        lacing = raw[at + HEADER.size : first]
        end = first + sum(lacing)
        whole = raw[at:end]
        if version or len(lacing) < n or end > len(raw) or crc(whole[:22] + b"\0\0\0\0" + whole[26:]) != check:
            n_bad += 1
            at += 4
            continue
        n_pages += 1
        stream = streams.setdefault(serial, Stream(serial))
        if stream.next_page is not None and number != stream.next_page:
            stream.partial = None
        stream.next_page = number + 1 & 0xFFFFFFFF
        _take(stream, raw, first, lacing, flags, granule)
        at = end
    return Media(streams, n_pages, n_bad)


def _take(stream: Stream, raw: bytes, place: int, lacing: bytes, flags: int, granule: int) -> None:
    """Put a page's segments to the stream's packets."""
    packet = stream.partial if flags & CONTINUED else bytearray()
    done = len(stream.packets)
    size = 0
    for value in lacing:
        size += value
        if value < 255:
            if packet is not None:
                stream.packets.append(bytes(packet) + raw[place : place + size])
                stream.granules.append(-1)
            packet = bytearray()
            place, size = place + size, 0
    if lacing and lacing[-1] == 255:
        stream.partial = None if packet is None else packet + raw[place : place + size]
    else:
        stream.partial = None
    # The granule position belongs to the last packet that ends here; those before it end earlier by its samples.
    for k in range(len(stream.packets) - 1, done - 1, -1):
        if granule < 0:
            break
        stream.granules[k] = granule
        granule -= len(stream.packets[k]) if k else 0
    stream.ended |= bool(flags & LAST)


def payload_of(media: Media) -> bytes:
    """The samples that mux() has stored."""
    order = sorted(media.streams.values(), key=lambda x: INFO.unpack(x.packets[0])[2])
    parts = [x.packets[1:] for x in order]
    return b"".join(x[k] for k in range(max(map(len, parts))) for x in parts if k < len(x))


def feature(media: Media, payload: bytes) -> str:
    """What the streams tell: their number, pages, packets, seconds and the samples' mean and power."""
    samples = np.frombuffer(payload, np.uint8).astype(np.int64)
    ends = [max(x.granules, default=0) for x in media.streams.values()]
    packets = sum(len(x.packets) for x in media.streams.values())
    mean, power = int(samples.sum()) / len(samples), int(samples @ samples) / len(samples)
    return f"ogg streams={len(ends)} pages={media.n_pages} bad={media.n_bad} packets={packets} seconds={sum(ends) / RATE:.6f} mean={mean:.6f} power={power:.6f}"


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


DIGEST = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def _coder() -> Callable[[list], Iterable[tuple]]:
    def work(texts: list) -> Iterable[tuple]:
        for raw in texts:
            media = mux(padded(raw or b""))
            read = demux(media)
            payload = payload_of(read)
            yield (
                len(raw or b""),
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-UNIT:]),
                len(media),
                hashlib.sha256(media).hexdigest(),
                feature(read, payload),
            )

    return work


STORED = T.StructType([T.StructField("media", T.BinaryType())])
STREAM = T.StructType([T.StructField("serial", T.LongType()), T.StructField("ended", T.BooleanType()), T.StructField("packets", T.ArrayType(T.BinaryType())), T.StructField("seconds", T.ArrayType(T.DoubleType()))])
READ = T.StructType([T.StructField("n_pages", T.LongType()), T.StructField("n_bad_pages", T.LongType()), T.StructField("streams", T.ArrayType(STREAM))])


def encode_column(df: DataFrame, column: str) -> DataFrame:
    """df with media: the bytes of a text or binary column, padded, as an Ogg stream."""
    common.prepare(df.sparkSession)
    return common.append_columns(df, column, lambda: lambda rows: [(mux(padded(x or b"")),) for x in rows], STORED)


def decode_column(df: DataFrame, column: str, rate: int = RATE) -> DataFrame:
    """df with n_pages, n_bad_pages and the logical streams of a column of Ogg bytes, each packet
    with the time at its end (null where no granule position tells)."""
    common.prepare(df.sparkSession)

    def work(rows: list) -> Iterable[tuple]:
        for raw in rows:
            media = demux(raw or b"")
            streams = [
                {"serial": x.serial, "ended": x.ended, "packets": x.packets, "seconds": [None if g < 0 else g / rate for g in x.granules]} for x in media.streams.values()
            ]
            yield media.n_pages, media.n_bad, streams

    return common.append_columns(df, column, lambda: work, READ)


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    docs = common.documents(spark, sf_dir).select("doc_id", common.utf8("text").alias("text"))
    return common.append_columns(docs, "text", _coder, DIGEST, ["text"])
