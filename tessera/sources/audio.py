"""Sampled sound: wave headers and samples, takes in 64-bit wave files, and multi-track project databases."""

from __future__ import annotations

import io
import math
import sqlite3
import struct
from dataclasses import dataclass

import numpy as np


#: Highest rate of a track, and the peak of a mix that would exceed 1.
MOST_RATE, LOUDEST = 768_000, 0.99


@dataclass
class Header:
    rate: int
    channels: int
    bits: int
    format: int
    data_bytes: int
    frames: int
    offset: int


def header(raw: bytes) -> Header:
    """Walk the chunks of a RIFF or RF64 file; sizes that exceed the file give way to its end."""
    if raw[:4] not in (b"RIFF", b"RF64") or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, wide = 12, None, None
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        body = at + 8
        if name == b"ds64" and size >= 24:
            wide = struct.unpack_from("<QQQ", raw, body)[1]
        elif name == b"fmt ":
            if size < 16 or body + 16 > len(raw):
                raise ValueError("truncated fmt")
            fmt = struct.unpack_from("<HHIIHH", raw, body)
        elif name == b"data":
            if fmt is None or not fmt[1] or not fmt[2]:
                raise ValueError("WAV missing fmt chunk")
            if size == 0xFFFFFFFF and wide is not None:
                size = wide
            size = min(size, len(raw) - body)
            block = fmt[1] * max(1, (fmt[5] + 7) // 8)
            return Header(fmt[2], fmt[1], fmt[5], fmt[0], size, size // block, body)
        at = body + size + size % 2
    raise ValueError("WAV missing data chunk" if fmt else "WAV missing fmt chunk")


def _integers(raw: bytes, width: int) -> np.ndarray:
    """Little-endian signed integers of 1 to 4 bytes as numbers in [-1, 1)."""
    octets = np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int64)
    value = (octets << (8 * np.arange(width))).sum(axis=1)
    top = 1 << (8 * width - 1)
    return ((value ^ top) - top) / top


def samples(raw: bytes, skip: int = 0, frames: int | None = None, channel: int | None = None) -> np.ndarray:
    """Frames by channels as floats: PCM of 8 (unsigned), 16, 24 and 32 bits, and 32-bit float."""
    h = header(raw)
    width = max(1, (h.bits + 7) // 8)
    block = width * h.channels
    count = max(0, h.frames - skip) if frames is None else max(0, min(frames, h.frames - skip))
    part = raw[h.offset + skip * block : h.offset + (skip + count) * block]
    if h.format == 3 and width == 4:
        flat = np.frombuffer(part, "<f4").astype(np.float64)
    elif h.format in (1, 0xFFFE) and width == 1:
        flat = (np.frombuffer(part, np.uint8).astype(np.float64) - 128) / 128
    elif h.format in (1, 0xFFFE) and width <= 4:
        flat = _integers(part, width)
    else:
        raise ValueError("sample format not supported")
    table = flat.reshape(-1, h.channels)
    return table if channel is None else table[:, [channel]]


def speech(raw: bytes) -> np.ndarray:
    """Samples of a 16 kHz mono file; anything else needs converting first."""
    h = header(raw)
    if (h.rate, h.channels) != (16000, 1):
        raise ValueError("not 16 kHz mono")
    return samples(raw)[:, 0]


def rf64(table: np.ndarray, rate: int, finished: bool = True) -> bytes:
    """24-bit 64-bit wave file of frames by channels of integers; unfinished: sizes as a crashed take leaves them."""
    channels = table.shape[1]
    value = np.clip(table, -(1 << 23), (1 << 23) - 1).astype("<i4")
    data = np.ascontiguousarray(value).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    open_ = (1 << 64) - 1
    sizes = (72 + len(data), len(data), table.size) if finished else (open_, open_, open_)
    out = io.BytesIO()
    out.write(struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + struct.pack("<4sIQQQI", b"ds64", 28, *sizes, 0))
    out.write(struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 3, channels * 3, 24))
    out.write(struct.pack("<4sI", b"data", 0xFFFFFFFF) + data)
    return out.getvalue()


def repair(raw: bytes) -> bytes:
    """A 64-bit wave file with the sizes that follow from its end."""
    if raw[:4] != b"RF64" or raw[12:16] != b"ds64":
        return raw
    h = header(raw)
    total = h.frames * h.channels
    return raw[:20] + struct.pack("<QQQ", len(raw) - 8, h.data_bytes, total) + raw[44:]


# --- Project databases: binary XML in SQLite ----------------------------------------------------------

#: Field kinds of the binary XML.
CHAR_SIZE, START, END, STRING, INT, BOOL, LONG, LONGLONG, SIZE, FLOAT, DOUBLE, DATA, RAW, PUSH, POP, NAME = range(16)
_VALUES = {INT: "<i", BOOL: "<B", LONG: "<i", LONGLONG: "<q", SIZE: "<I", FLOAT: "<fi", DOUBLE: "<di"}
_CHARSETS = {1: "utf-8", 2: "utf-16-le", 4: "utf-32-le"}
MOST_NODES, MOST_DEPTH = 200_000, 256
#: Sample formats of blocks.
INT16, INT24, FLOAT32 = 0x00020001, 0x00040001, 0x0004000F


def binary_xml(raw: bytes) -> dict:
    """The tree {tag, attrs, children} of dictionary and document bytes."""
    at, charset = 0, "utf-8"
    names: dict[int, str] = {}
    saved, nodes, root, count = [], [], None, 0

    def take(form: str):
        nonlocal at
        got = struct.unpack_from(form, raw, at)
        at += struct.calcsize(form)
        return got[0]

    try:
        while at < len(raw):
            kind = take("<B")
            if kind == CHAR_SIZE:
                charset = _CHARSETS[take("<B")]
            elif kind == NAME:
                number, size = take("<H"), take("<H")
                names[number] = raw[at : at + size].decode(charset)
                at += size
            elif kind == PUSH:
                saved.append(names)
                names = {}
            elif kind == POP:
                names = saved.pop()
            elif kind == START:
                count += 1
                if count > MOST_NODES or len(nodes) >= MOST_DEPTH:
                    raise ValueError("project too large")
                nodes.append({"tag": names[take("<H")], "attrs": {}, "children": []})
            elif kind == END:
                take("<H")
                done = nodes.pop()
                if nodes:
                    nodes[-1]["children"].append(done)
                else:
                    root = done
            elif kind == STRING:
                name, size = names[take("<H")], take("<i")
                nodes[-1]["attrs"][name] = raw[at : at + size].decode(charset)
                at += size
            elif kind in _VALUES:
                name = names[take("<H")]
                nodes[-1]["attrs"][name] = take(_VALUES[kind])
            elif kind in (DATA, RAW):
                at += take("<i")
            else:
                raise ValueError("unknown field")
    except (struct.error, KeyError, IndexError, UnicodeDecodeError):
        raise ValueError("corrupt project") from None
    if root is None or nodes:
        raise ValueError("corrupt project")
    return root


def is_project(raw: bytes) -> bool:
    return raw.startswith(b"SQLite format 3\0") and raw[68:72] == b"AUDY"


def _children(node: dict, tag: str) -> list[dict]:
    return [x for x in node["children"] if x["tag"] == tag]


def _number(node: dict, name: str, default: float, low: float = -math.inf, high: float = math.inf) -> float:
    try:
        value = float(node["attrs"].get(name, default))
    except ValueError:
        return default
    return value if low <= value <= high else default


def _block(form: int, blob: bytes) -> np.ndarray:
    if form == FLOAT32:
        return np.frombuffer(blob, "<f4").astype(np.float64)
    return _integers(blob, {INT16: 2, INT24: 3}[form])


def project_rows(raw: bytes) -> dict:
    """Rate, and rows of tracks, blocks and envelope points of a project file's bytes."""
    if not is_project(raw):
        raise ValueError("not a project")
    with sqlite3.connect(":memory:") as db:
        db.deserialize(raw)
        try:
            stored = db.execute("SELECT dict, doc FROM project LIMIT 1").fetchone() or db.execute("SELECT dict, doc FROM autosave LIMIT 1").fetchone()
            held = dict((i, (f, bytes(s))) for i, f, s in db.execute("SELECT blockid, sampleformat, samples FROM sampleblocks"))
        except sqlite3.DatabaseError as e:
            raise ValueError(f"corrupt project: {e}") from None
    if not stored:
        raise ValueError("empty project")
    root = binary_xml(bytes(stored[0] or b"") + bytes(stored[1] or b""))
    if root["tag"] != "project":
        raise ValueError("corrupt project")
    out = {"rate": _number(root, "rate", 44100.0, 1, 768000), "tracks": [], "blocks": [], "points": [], "samples": held}
    for t, track in enumerate(_children(root, "wavetrack")):
        out["tracks"].append({"track": t, "mute": bool(_number(track, "mute", 0)), "solo": bool(_number(track, "solo", 0)), "gain": _number(track, "gain", 1.0, 0, 100), "pan": _number(track, "pan", 0.0, -1, 1), "rate": _number(track, "rate", -1.0)})
        for k, clip in enumerate(_children(track, "waveclip")):
            place = {"track": t, "clip": k, "offset": _number(clip, "offset", 0.0, 0), "trim_left": _number(clip, "trimLeft", 0.0, 0), "trim_right": _number(clip, "trimRight", 0.0, 0)}
            for sequence in _children(clip, "sequence"):
                blocks = sorted((int(_number(b, "start", 0)), int(_number(b, "blockid", 0)), int(_number(b, "length", -1))) for b in _children(sequence, "waveblock"))
                total = int(_number(sequence, "numsamples", 0))
                for i, (start, block, size) in enumerate(blocks):
                    end = start + size if size >= 0 else blocks[i + 1][0] if i + 1 < len(blocks) else total
                    out["blocks"].append(place | {"block": block, "start": start, "end": end, "total": total})
            out["points"] += [{"track": t, "clip": k, "t": _number(p, "t", 0.0), "gain": _number(p, "val", 1.0)} for e in _children(clip, "envelope") for p in _children(e, "controlpoint")]
    return out


def _whole(x: float) -> int:
    """The nearest whole number; halves go up."""
    return math.floor(x + 0.5)


@dataclass
class Block:
    """A stored block of samples of a clip that is heard, and where its clip lies in the mix.

    Place s of the clip's audible part takes the sample at ``skip + s * ratio``, between two samples by their
    weights; behind the last sample of a block there is silence."""

    first: int  # place of the clip's audible part in the mix
    size: int  # places that it fills there
    skip: int  # samples that are trimmed from its start
    ratio: float  # samples a place
    rate: float  # places a second
    gain: float
    start: int  # samples of the block
    end: int
    form: int
    blob: bytes
    points: list[tuple[float, float]]

    def mixed(self) -> tuple[int, np.ndarray]:
        """(place in the mix, values) of what the block adds."""
        low = max(0, math.ceil((self.start - self.skip) / self.ratio) - 1)
        high = min(self.size, math.ceil((self.end - self.skip) / self.ratio) + 1)
        place = np.arange(low, max(low, high))
        at = self.skip + place * self.ratio
        whole = np.floor(at).astype(np.int64)
        mine = (whole >= self.start) & (whole < self.end)
        place, whole, part = place[mine], whole[mine] - self.start, (at - np.floor(at))[mine]
        if not len(place) or not self.blob:
            return self.first, np.zeros(0)
        value = _block(self.form, self.blob)
        value = np.append(value, np.zeros(max(0, int(whole[-1]) + 2 - len(value))))
        value = value[whole] * (1 - part) + value[whole + 1] * part
        if self.points:
            value = value * np.interp(place / self.rate, *zip(*self.points, strict=True))
        return self.first + int(place[0]), value * self.gain


def heard_blocks(raw: bytes, hours: float = 5) -> tuple[float, int, list[Block]]:
    """(rate, places, blocks) of a project: muted tracks, and those beside a solo one, are not heard.

    A solo track that is muted is not heard and silences no other. Tracks have rates of their own."""
    rows = project_rows(raw)
    rate = rows["rate"]
    solo = any(t["solo"] and not t["mute"] for t in rows["tracks"])
    heard = {t["track"]: t for t in rows["tracks"] if not t["mute"] and (t["solo"] or not solo)}
    out, places = [], 0
    for b in rows["blocks"]:
        track = heard.get(b["track"])
        own = track["rate"] if track and track["rate"] > 0 else rate
        if not track or own > MOST_RATE:
            continue
        skip = _whole(b["trim_left"] * own)
        kept = b["total"] - _whole(b["trim_right"] * own) - skip
        size, first = _whole(kept / own * rate), _whole(b["offset"] * rate)
        if kept <= 0 or size <= 0:
            continue
        places = max(places, first + size)
        angle = (track["pan"] + 1) * math.pi / 4
        gain = track["gain"] * (math.cos(angle) + math.sin(angle)) / math.sqrt(2)
        points = sorted((p["t"], p["gain"]) for p in rows["points"] if (p["track"], p["clip"]) == (b["track"], b["clip"]))
        form, blob = rows["samples"].get(b["block"], (FLOAT32, b""))
        out.append(Block(first, size, skip, own / rate, rate, gain, b["start"], b["end"], form, blob, points))
    if not places:
        raise ValueError("nothing to render")
    if places > hours * 3600 * rate:
        raise ValueError("project too long")
    return rate, places, out


def levelled(mix: np.ndarray, peak: float) -> np.ndarray:
    return mix * (LOUDEST / peak) if peak > 1 else mix


def render(raw: bytes, hours: float = 5) -> tuple[np.ndarray, float]:
    """Mono mix of one project at its rate: solo and mute, gain, pan, envelopes, trims, other rates; missing blocks are silence."""
    rate, places, blocks = heard_blocks(raw, hours)
    mix = np.zeros(places)
    for block in blocks:
        at, value = block.mixed()
        mix[at : at + len(value)] += value
    return levelled(mix, float(np.abs(mix).max())), rate
