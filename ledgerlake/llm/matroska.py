"""Media columns: Matroska files in a binary column, written and parsed element by element.

The parser reads variable-length EBML ids and sizes, descends into the master elements, and turns
SimpleBlocks and Blocks (without lacing, or with Xiph, EBML or fixed-size lacing) into a packet
table: track, timestamp (each frame of a lace has its own), key flag (a block in a group is a key frame unless
it refers to another), the cluster and the byte range of every frame. Cues are read beside it. The writer stores bytes losslessly as 8-bit PCM frames and uses each kind of lacing.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0xA0, 0x1C53BB6B, 0xBB, 0xB7
DOC_TYPE, SCALE, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, RATE, CHANNELS, DEPTH = 0x4282, 0x2AD7B1, 0xD7, 0x73C5, 0x83, 0x86, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK, CUE_TIME, CUE_TRACK, CUE_CLUSTER, REFERENCE, DURATION = 0xE7, 0xA3, 0xA1, 0xB3, 0xF7, 0xF1, 0xFB, 0x23E383
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Elements that stand directly in a segment: they end a cluster of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000  # nanoseconds of a timestamp's unit
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp, key, cluster, start, length
    clusters: list[int] = field(default_factory=list)  # byte offset of each
    cues: list[tuple] = field(default_factory=list)  # time, track, byte offset of the cluster


def read_vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """(value, bytes used); a size whose value bits are all ones (unknown) is -1."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError("broken variable-length integer")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, width
    value -= 1 << (7 * width)
    return (-1 if value == (1 << (7 * width)) - 1 else value), width


def write_vint(value: int) -> bytes:
    width = next(w for w in range(1, 9) if value < (1 << (7 * w)) - 1)
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(ident: int, body: bytes | int | str) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    elif isinstance(body, str):
        body = body.encode()
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + write_vint(len(body)) + body


def _lace(frames: list[bytes], kind: int) -> tuple[int, bytes]:
    """(lacing flag, what stands before the frames); kind 0 none, 1 Xiph, 2 EBML, 3 fixed size."""
    sizes = [len(x) for x in frames]
    if len(frames) == 1:
        return 0, b""
    if kind == 1:
        return 0x02, bytes([len(frames) - 1]) + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == 3 and len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1])
    steps = b""
    for before, n in zip(sizes, sizes[1:-1], strict=False):
        width = next(w for w in range(1, 9) if abs(n - before) < (1 << (7 * w - 1)) - 1)
        steps += (n - before + (1 << (7 * width - 1)) - 1 | 1 << (7 * width)).to_bytes(width, "big")
    return 0x06, bytes([len(frames) - 1]) + write_vint(sizes[0]) + steps


def write_matroska(payload: bytes, frame: int = 1024, lace: int = 8, blocks: int = 16, rate: int = 8000) -> bytes:
    """One audio track of 8-bit PCM; the kinds of lacing take turns; a cue for every cluster."""
    head = element(EBML, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(DOC_TYPE, "matroska") + element(0x4287, 4) + element(0x4285, 2))
    info = element(INFO, element(SCALE, 1_000_000) + element(0x4D80, "packets") + element(0x5741, "packets"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", rate)) + element(CHANNELS, 1) + element(DEPTH, 8))
    body = info + element(TRACKS, element(TRACK, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(0x9C, 1) + element(DURATION, frame * 1_000_000_000 // rate) + element(CODEC, "A_PCM/INT/LIT") + audio))
    parts, cues, size = [body], b"", len(body)
    for k, at in enumerate(range(0, len(payload), frame * lace * blocks)):
        base = at * 1000 // rate
        inner = [element(TIMESTAMP, base)]
        for j, start in enumerate(range(at, min(at + frame * lace * blocks, len(payload)), frame * lace)):
            frames = [payload[x : x + frame] for x in range(start, min(start + frame * lace, len(payload)), frame)]
            flag, sizes = _lace(frames, (k * blocks + j) % 3 + 1)
            inner.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start * 1000 // rate - base, 0x80 | flag) + sizes + b"".join(frames)))
        cluster = element(CLUSTER, b"".join(inner))
        cues += element(CUE_POINT, element(CUE_TIME, base) + element(CUE_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER, size)))
        parts.append(cluster)
        size += len(cluster)
    parts.append(element(CUES, cues))
    return head + element(SEGMENT, b"".join(parts))


def _frames(data: bytes, at: int, end: int, flags: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each frame of a block whose header ends at ``at``."""
    kind = flags & 0x06
    if not kind:
        yield at, end - at
        return
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 0x04:
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if kind == 0x02:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            elif not k:
                n, width = read_vint(data, at)
                at += width
            else:
                raw, width = read_vint(data, at, keep_marker=True)
                n = sizes[-1] + raw - (1 << (7 * width)) - (1 << (7 * width - 1)) + 1
                at += width
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    for n in sizes:
        if n < 0 or at + n > end:
            raise ValueError("lace runs over its block")
        yield at, n
        at += n


def _unsigned(body: bytes) -> int:
    """An unsigned element; the table holds signed 64-bit numbers, so nothing of 2^63 or more is read."""
    if len(body) > 8 or (value := int.from_bytes(body, "big")) >= 1 << 63:
        raise ValueError("number out of range")
    return value


def _nanoseconds(track: dict, length: int) -> int:
    """How long a frame lasts: the track's default, or else what its bytes of plain samples take; 0 where neither is known."""
    if "duration" in track:
        return track["duration"]
    bits, rate = track.get("depth", 0) * track.get("channels", 1), track.get("rate", 0)
    if not track.get("codec", "").startswith("A_PCM") or not bits or not 0 < rate < float("inf"):
        return 0
    return int(length * 8 * 1_000_000_000 / (bits * rate))


#: Master elements lie this deep at most; a file that nests deeper is broken.
DEEPEST = 16


def parse_matroska(data: bytes) -> Media:
    """Raises ValueError where the structure is broken, whatever the bytes are."""
    try:
        return _parse(data)
    except (IndexError, struct.error) as e:
        raise ValueError(str(e) or "truncated") from e


def _parse(data: bytes) -> Media:
    out = Media()
    now = {"cluster": 0, "time": 0, "segment": 0, "cue": [0, 0, 0], "reference": False}
    numbered: dict[int, dict] = {}

    def block(at: int, end: int, key: bool | None) -> None:
        track, width = read_vint(data, at)
        relative, flags = struct.unpack_from(">hB", data, at + width)
        told, before = numbered.get(track, {}), 0
        for start, n in _frames(data, at + width + 3, end, flags):
            out.packets.append((track, now["time"] + relative + before // max(1, out.scale), bool(flags & 0x80) if key is None else key, now["cluster"], start, n))
            before += _nanoseconds(told, n)

    def walk(at: int, end: int, parent: int, deep: int = 0) -> int:
        if deep > DEEPEST:
            raise ValueError("elements nest too deeply")
        while at < end:
            ident, a = read_vint(data, at, keep_marker=True)
            if parent == CLUSTER and ident in TOP_LEVEL:
                return at
            size, b = read_vint(data, at + a)
            start, stop = at + a + b, end if size < 0 else at + a + b + size
            if stop > end:
                raise ValueError("element runs over its parent")
            body = lambda s=start, e=stop: data[s:e]
            if ident == SEGMENT:
                now["segment"] = start
            elif ident == CLUSTER:
                now["cluster"], now["time"] = at, 0
                out.clusters.append(at)
            elif ident == TRACK:
                out.tracks.append({})
            elif ident == CUE_POINT:
                now["cue"] = [0, 0, 0]
            elif ident == BLOCK_GROUP:
                now["reference"] = False
            if ident in MASTERS:
                first = len(out.packets)
                stop = walk(start, stop, ident, deep + 1)
                if ident == BLOCK_GROUP and now["reference"]:  # wherever in the group it stands
                    out.packets[first:] = [(*p[:2], False, *p[3:]) for p in out.packets[first:]]
                if ident == CUE_POSITIONS:
                    out.cues.append((now["cue"][0], now["cue"][1], now["segment"] + now["cue"][2]))
            elif ident in (SIMPLE_BLOCK, BLOCK):
                block(start, stop, None if ident == SIMPLE_BLOCK else True)
            elif ident == REFERENCE:
                now["reference"] = True
            elif ident == TIMESTAMP:
                now["time"] = _unsigned(body())
            elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
                now["cue"][(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = _unsigned(body())
            elif ident == SCALE:
                out.scale = _unsigned(body())
            elif ident == DOC_TYPE:
                out.doc_type = body().rstrip(b"\0").decode("ascii", "replace")
            elif parent in (TRACK, AUDIO) and out.tracks:
                name = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CODEC: "codec", RATE: "rate", CHANNELS: "channels", DEPTH: "depth", DURATION: "duration"}.get(ident)
                if name:
                    out.tracks[-1][name] = body().decode("ascii", "replace") if ident == CODEC else struct.unpack(">d" if stop - start == 8 else ">f", body())[0] if ident == RATE else _unsigned(body())
                    if name == "number":
                        numbered[out.tracks[-1]["number"]] = out.tracks[-1]
            at = stop
        return at

    walk(0, len(data), 0)
    return out


PACKETS = "track long, timestamp long, key boolean, cluster long, start long, length long"
_KINDS = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())


def packets_of(m: Media) -> list[tuple]:
    """The rows of a file's packet table: track, timestamp (ms), key, cluster, start, length."""
    rows = [(track, time * m.scale // 1_000_000, *rest) for track, time, *rest in m.packets]
    if any(not -(1 << 63) <= x < 1 << 63 for track, time, *_ in rows for x in (track, time)):
        raise ValueError("number out of range")
    return rows


def _slices(batch: pa.RecordBatch, sizes: list[int], most: int) -> Iterator[pa.RecordBatch]:
    """Slices of one row or more whose ``sizes`` sum to about ``most`` at the largest."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def store_texts(docs: DataFrame, batch_bytes: int = 32_000_000) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as UTF-8, zero-filled to a positive multiple of 64, in a Matroska file.

    One row per document, repeated rows repeatedly; other columns play no part; an empty table gives
    an empty result. Files leave in batches of about ``batch_bytes``, a larger one alone.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, [x or 0 for x in batch.column("n_bytes").to_pylist()], batch_bytes):
                media = []
                for text in part.column("text").to_pylist():
                    raw = (text or "").encode("utf-8")
                    media.append(write_matroska(raw + bytes(-len(raw) % 64 if raw else 64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return sized.mapInArrow(write, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def packet_table(files: DataFrame, ident: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet: id, error, track, timestamp (ms), key, cluster, start, length.

    A null or broken file gives one row with null packet columns and the reason in ``error``; a file
    without packets gives none. Equal files give equal rows, other columns play no part.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident_, data in zip(batch.column(0), batch.column(1), strict=True):
                data, error = data.as_py(), None
                try:
                    if data is None:
                        raise ValueError("null")
                    rows = packets_of(parse_matroska(data))
                except ValueError as e:
                    rows, error = [(None,) * 6], str(e)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([ident_.as_py()] * len(rows), batch.column(0).type), pa.array([error] * len(rows), pa.string()), *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], [ident, "error", "track", "timestamp", "key", "cluster", "start", "length"])

    return files.select(ident, media).mapInArrow(read, f"{ident} {files.schema[ident].dataType.simpleString()}, error string, {PACKETS}")


def features_of(m: Media, payload: bytes) -> str:
    """Counts of the container and simple statistics of the samples, as JSON with a fixed order of keys."""
    samples = np.frombuffer(payload, np.uint8)
    counts = np.bincount(samples, minlength=256)
    p = counts[counts > 0] / max(1, len(samples))
    packets = packets_of(m)
    return json.dumps({"tracks": len(m.tracks), "clusters": len(m.clusters), "packets": len(packets), "cues": len(m.cues), "cues_ok": {c for _, _, c in m.cues} == set(m.clusters), "last_ms": max((x[1] for x in packets), default=0), "mean": round(float(samples.mean()), 4) if len(samples) else 0.0, "entropy": round(float(-(p * np.log2(p)).sum()), 4)})


def read_features(stored: DataFrame) -> DataFrame:
    """Read stored files (doc_id, n_bytes, media) back through their packets.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (last 64 bytes), media_bytes,
    media_sha256, feature, error; one row per file, repeated rows repeatedly. Equal texts give equal
    values; null and empty texts are 64 zero bytes. A null or broken file gives its reason in
    ``error`` and no payload columns (and no media columns if null). Other columns play no part.
    """
    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6 + ("null",)
        own = (len(data), hashlib.sha256(data).hexdigest())
        try:
            m = parse_matroska(data)
            payload = b"".join([data[start : start + n] for *_, start, n in packets_of(m)])
            return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *own, features_of(m, payload), None)
        except ValueError as e:
            return (None, None, None, *own, None, str(e))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(data.as_py()) for data in batch.column("media")]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)
