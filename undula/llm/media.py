"""ISO base media columns: walk boxes, decode sample tables, list codec, duration and keyframe byte ranges; payload bytes are never decoded.

`read_tracks` takes any bytes. Boxes nest to any depth that the file's own sizes allow; 64-bit sizes, a last box of size 0, stz2, co64 and fragments (moof,
trun) are read. A keyframe entry is a sample, its offset and size, and how many samples of that size stand one behind the other from there (1 unless all samples
have one size and all are keyframes). Damaged files give what could be read and an error text. `write_audio` stores a payload losslessly as unsigned 8-bit samples.

Null text counts as empty (one unit of zero bytes). Repeated rows give repeated results; columns other than doc_id and text are ignored.

Texts of any length are read whole (a text of over a megabyte is a batch of its own); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undula.llm.common import map_arrow, texts_of

UNIT = 64
RATE = 8000
#: Samples of a chunk, and samples from one sync sample to the next, that write_audio lays out.
CHUNK, SYNC = 65536, 4096
#: Boxes that hold boxes (fixed values).
CONTAINERS = {b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta", b"mfra"}


@dataclass
class Track:
    """What the tables of a track say. samples: (offset, size, duration, sync) in decoding order, kept as runs of equal neighbours."""

    track_id: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    n_samples: int = 0
    runs: list[tuple[int, int]] = field(default_factory=list)  # byte ranges of all samples, neighbours merged
    keyframes: list[tuple[int, int, int, int]] = field(default_factory=list)  # sample (0-based), offset, size, and how many samples of that size follow one another from it on
    n_keyframes: int = 0


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 0xFFFFFFF0 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def walk(data: memoryview, at: int, end: int, path: tuple[bytes, ...] = ()):
    """(path, start of body, end of body) of every box in data[at:end], containers before what they hold."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                raise ValueError(f"box {kind!r} is cut off")
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            raise ValueError(f"box {kind!r} at {at} has a size of {size}")
        yield (*path, kind), at + head, at + size
        if kind in CONTAINERS:
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


def _table(data, at: int, end: int, fmt: str) -> list[tuple]:
    """The entries of a full box that starts with their number."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    size = struct.calcsize(">" + fmt)
    if at + 8 + n * size > end:
        raise ValueError("a sample table is cut off")
    return list(struct.iter_unpack(">" + fmt, data[at + 8 : at + 8 + n * size]))


class _Tables:
    """The tables of one stbl, and the samples that follow from them."""

    def __init__(self):
        self.stts, self.stsc, self.offsets, self.sync = [], [], [], None
        self.size, self.sizes, self.n = 0, None, 0

    def fill(self, track: Track) -> None:
        """Runs through the chunks; samples of one fixed size are never listed one by one. Without a table of sync samples every sample is a keyframe."""
        per = {}
        for (first, count, _), (until, *_) in zip(self.stsc, [*self.stsc[1:], (len(self.offsets) + 1, 0, 0)], strict=True):
            per[first] = (until, count)
        sync = None if self.sync is None else [s - 1 for s in self.sync]
        next_sync, sample = 0, 0
        for first in sorted(per):
            until, count = per[first]
            for chunk in range(first - 1, min(until - 1, len(self.offsets))):
                count_here = min(count, self.n - sample)
                if count_here <= 0:
                    break
                start = self.offsets[chunk]
                starts = None
                if self.sizes is not None:
                    starts = [0]
                    for s in self.sizes[sample : sample + count_here]:
                        starts.append(starts[-1] + s)
                length = starts[-1] if starts else count_here * self.size
                if track.runs and sum(track.runs[-1]) == start:
                    track.runs[-1] = (track.runs[-1][0], track.runs[-1][1] + length)
                else:
                    track.runs.append((start, length))
                if sync is None:
                    if starts:
                        track.keyframes += [(sample + i, start + starts[i], starts[i + 1] - starts[i], 1) for i in range(count_here)]
                    else:
                        track.keyframes.append((sample, start, self.size, count_here))
                    track.n_keyframes += count_here
                else:
                    while next_sync < len(sync) and sync[next_sync] < sample + count_here:
                        i = sync[next_sync] - sample
                        track.keyframes.append((sync[next_sync], start + (starts[i] if starts else i * self.size), (starts[i + 1] - starts[i]) if starts else self.size, 1))
                        track.n_keyframes += 1
                        next_sync += 1
                sample += count_here
        track.n_samples = sample
        if not track.duration:
            track.duration = sum(n * d for n, d in self.stts)


def read_tracks(content: bytes) -> tuple[list[Track], str | None]:
    """The tracks of a file and what is wrong with it, if anything."""
    data, tracks, tables, error = memoryview(content), [], [], None
    base = 0
    try:
        for path, at, end in walk(data, 0, len(data)):
            kind = path[-1]
            if kind == b"trak":
                tracks.append(Track())
                tables.append(_Tables())
            elif kind == b"tkhd" and tracks:
                tracks[-1].track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif kind == b"mdhd" and tracks:
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
            elif kind == b"hdlr" and tracks and path[-2] == b"mdia":
                tracks[-1].handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd" and tracks:
                tracks[-1].codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
            elif kind == b"stts" and tracks:
                tables[-1].stts = _table(data, at, end, "II")
            elif kind == b"stsc" and tracks:
                tables[-1].stsc = _table(data, at, end, "III")
            elif kind in (b"stco", b"co64") and tracks:
                tables[-1].offsets = [x for (x,) in _table(data, at, end, "I" if kind == b"stco" else "Q")]
            elif kind == b"stss" and tracks:
                tables[-1].sync = [x for (x,) in _table(data, at, end, "I")]
            elif kind == b"stsz" and tracks:
                t = tables[-1]
                t.size, t.n = struct.unpack_from(">II", data, at + 4)
                if not t.size:
                    t.sizes = [x for (x,) in _table(data, at + 4, end, "I")]
            elif kind == b"stz2" and tracks:
                t, bits = tables[-1], data[at + 7]
                t.n = struct.unpack_from(">I", data, at + 8)[0]
                raw = bytes(data[at + 12 : end])
                t.sizes = [b >> s & 15 for b in raw for s in (4, 0)][: t.n] if bits == 4 else list(raw[: t.n]) if bits == 8 else [x for (x,) in struct.iter_unpack(">H", raw[: 2 * t.n])]
            elif kind == b"moof":
                base = at - 8
            elif kind == b"tfhd":
                flags, owner = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
                here, fragment = at + 8, {"base": base, "size": 0, "duration": 0, "flags": 0}
                for bit, name, fmt in ((1, "base", ">Q"), (2, "", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
                    if flags & bit:
                        fragment[name] = struct.unpack_from(fmt, data, here)[0]
                        here += struct.calcsize(fmt)
                fragment["track"] = next((t for t in tracks if t.track_id == owner), None)
            elif kind == b"trun" and fragment["track"]:
                _run(data, at, fragment)
    except (ValueError, struct.error, IndexError, UnboundLocalError) as e:
        error = str(e)
    for track, t in zip(tracks, tables, strict=True):
        if t.offsets:
            t.fill(track)
    return tracks, error


def _run(data, at: int, fragment: dict) -> None:
    """The samples of a fragment's run are added to its track."""
    flags, n = struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, struct.unpack_from(">I", data, at + 4)[0]
    here, track = at + 8, fragment["track"]
    offset, first = fragment["base"], fragment["flags"]
    if flags & 1:
        offset += struct.unpack_from(">i", data, here)[0]
        here += 4
    if flags & 4:
        first = struct.unpack_from(">I", data, here)[0]
        here += 4
    for i in range(n):
        x = {"duration": fragment["duration"], "size": fragment["size"], "flags": first if i == 0 else fragment["flags"]}
        for bit, name in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")):
            if flags & bit:
                x[name] = struct.unpack_from(">I", data, here)[0]
                here += 4
        if track.runs and sum(track.runs[-1]) == offset:
            track.runs[-1] = (track.runs[-1][0], track.runs[-1][1] + x["size"])
        else:
            track.runs.append((offset, x["size"]))
        if not x["flags"] & 0x10000:
            track.keyframes.append((track.n_samples, offset, x["size"], 1))
            track.n_keyframes += 1
        track.n_samples += 1
        track.duration += x["duration"]
        offset += x["size"]


def read_payload(content: bytes, track: Track) -> bytes:
    """The bytes of all samples of a track, by its tables."""
    return b"".join([content[at : at + n] for at, n in track.runs])


def write_audio(payload: bytes, rate: int = RATE, chunk: int = CHUNK, sync: int = SYNC) -> bytes:
    """An audio file of one track whose samples are the payload's bytes, unsigned 8-bit, one channel."""
    n = len(payload)
    identity = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ", b"isom")
    chunks = range(0, n, chunk)
    full, rest = divmod(n, chunk)
    stsc = [(1, chunk, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    wide = n > 0xFFF00000

    def moov(first: int) -> bytes:
        entry = struct.pack(">I4s6xH8xHHHHI", 36, b"raw ", 1, 1, 8, 0, 0, rate << 16)
        stbl = box(
            b"stbl",
            box(b"stsd", struct.pack(">II", 0, 1), entry),
            box(b"stts", struct.pack(">IIII", 0, 1, n, 1)),
            box(b"stsc", struct.pack(">II", 0, len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            box(b"stsz", struct.pack(">III", 0, 1, n)),
            box(b"co64" if wide else b"stco", struct.pack(">II", 0, len(chunks)), *(struct.pack(">Q" if wide else ">I", first + c) for c in chunks)),
            box(b"stss", struct.pack(">II", 0, -(-n // sync)), *(struct.pack(">I", 1 + s) for s in range(0, n, sync))),
        )
        minf = box(b"minf", box(b"smhd", bytes(8)), box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1)))), stbl)
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, rate, n, 0x55C4, 0)), box(b"hdlr", struct.pack(">II4s12x", 0, 0, b"soun"), b"\0"), minf)
        tkhd = box(b"tkhd", struct.pack(">IIIIII8xHHHH", 7, 0, 0, 1, 0, n, 0, 0, 0x100, 0), identity, bytes(8))
        mvhd = box(b"mvhd", struct.pack(">IIIIIIH10x", 0, 0, 0, rate, n, 0x10000, 0x100), identity, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + (16 if n >= 0xFFFFFFF0 else 8)
    return ftyp + moov(head) + box(b"mdat", payload)


TRACK_SCHEMA = "track_id: long, codec: string, handler: string, timescale: long, duration: long, seconds: double, n_samples: long, n_keyframes: long, keyframes: array<struct<sample: long, offset: long, size: long, count: long>>"


def probe(media: DataFrame, column: str = "content") -> DataFrame:
    """media with tracks (array of structs) and media_error columns in place of the content, whose payload is not decoded."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.schema if f.name not in (column, "tracks", "media_error"))
    keep = [f.name for f in media.schema if f.name not in (column, "tracks", "media_error")]
    track_type = pa.struct([("track_id", pa.int64()), ("codec", pa.string()), ("handler", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("sample", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("count", pa.int64())])))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tracks, errors = [], []
        for content in batch.column(column).to_pylist():
            found, error = read_tracks(content) if content is not None else ([], None)
            tracks.append([{"track_id": t.track_id, "codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "seconds": t.duration / t.timescale if t.timescale else None, "n_samples": t.n_samples, "n_keyframes": t.n_keyframes, "keyframes": [dict(zip(("sample", "offset", "size", "count"), k, strict=True)) for k in t.keyframes]} for t in found])
            errors.append(error)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(tracks, pa.list_(track_type)), pa.array(errors, pa.string())], names=[*keep, "tracks", "media_error"])

    return map_arrow(media.select(*keep, F.col(column).cast("binary").alias(column)), run, f"{kinds}{', ' if kinds else ''}tracks array<struct<{TRACK_SCHEMA}>>, media_error string", column)


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """data with zero bytes behind it, up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit if data else unit)


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a media file, read back by its tables: digests of both, and a feature string."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            data = text or b""
            media = write_audio(padded(data))
            (track,), error = read_tracks(media)
            if error:
                raise ValueError(error)
            back = read_payload(media, track)
            last = track.keyframes[-1]
            feature = f"codec={track.codec.strip()};handler={track.handler};seconds={track.duration / track.timescale:.6f};samples={track.n_samples};keyframes={track.n_keyframes};last={last[1]}+{last[2]}"
            rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(texts_of(docs), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
