"""FLAC media columns: 8-bit mono streams in binary columns, coded and decoded many frames at a time.

A stream has STREAMINFO (with the MD5 of its samples), a seek table with one point a frame, and fixed-size frames (the last
may be shorter). Frames hold constant, verbatim, fixed-predictor or linear-predictor subframes, whichever is shortest, with
Rice-coded residuals; linear predictors of order `ORDER` come from the frame's autocorrelation by the Levinson-Durbin
recursion, in `PRECISION` bits. The decoder also reads predictors of any order, all partition orders, both Rice forms and
escaped partitions. All frames of a block of rows are decoded together: the place of every stop bit is chased one sample at
a time over all frames at once. CRC-8 of each header, CRC-16 of each frame and the MD5 of the whole are verified; a
difference is an error. Decoded streams are PCM blocks, one a frame, each with the offset of its first sample.

Defined results: a null or empty text is 192 spaces; a payload is padded with spaces to a positive multiple of 192; equal
texts and so repeated rows give equal streams; a very long text is one stream of as many frames as it needs, and frames
beyond the largest seek table are found one after the other; of equally short subframes the simpler one is taken; null media
give no blocks; an empty table gives no rows; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

UNIT = 192
BLOCK = 1152
ORDER, PRECISION = 4, 10
RATE = 8000
#: Fixed codes of frame headers: block sizes.
SIZE_CODES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_CODE_OF = {v: k for k, v in SIZE_CODES.items()}
_WORK_BYTES = 1 << 20


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-8 (polynomial 0x07) of one byte; CRC-16 (0x8005) register after 16 more bits."""
    crc8 = np.arange(256)
    for _ in range(8):
        crc8 = np.where(crc8 & 0x80, (crc8 << 1) ^ 0x07, crc8 << 1) & 0xFF
    crc16 = np.arange(65536)
    for _ in range(16):
        crc16 = np.where(crc16 & 0x8000, (crc16 << 1) ^ 0x8005, crc16 << 1) & 0xFFFF
    return crc8.astype(np.uint8), crc16.astype(np.uint16)


_CRC8, _CRC16 = _crc_tables()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16_all(frames: list[bytes]) -> np.ndarray:
    """CRC-16 of each; leading zeros don't change it, so shorter ones are filled up in front."""
    if not frames:
        return np.zeros(0, np.uint16)
    width = (max(map(len, frames)) + 1) // 2 * 2
    words = np.frombuffer(b"".join(f.rjust(width, b"\0") for f in frames), ">u2").reshape(len(frames), -1)
    crc = np.zeros(len(frames), np.uint16)
    for column in np.ascontiguousarray(words.T.astype(np.uint16)):
        crc = _CRC16[crc ^ column]
    return crc


def coded_number(n: int) -> bytes:
    """A frame or sample number in the extended UTF-8 form of the format."""
    if n < 0x80:
        return bytes([n])
    tail: list[int] = []
    limit = 0x40
    while n >= limit:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        limit >>= 1
    return bytes([(0xFF << (7 - len(tail))) & 0xFF | n, *reversed(tail)])


_headers: dict[tuple[int, int], bytes] = {}


def frame_header(number: int, size: int) -> bytes:
    key = (number, size)
    if key not in _headers:
        code = _CODE_OF.get(size, 7)
        head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + coded_number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
        if len(_headers) > 100_000:
            _headers.clear()
        _headers[key] = head + bytes([crc8(head)])
    return _headers[key]


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised linear predictors (frames, ORDER) and their shifts, by Levinson-Durbin over all frames at once."""
    n_frames, n = x.shape
    y = x * np.hanning(n + 2)[1:-1].astype(np.float32)
    r = np.stack([np.einsum("ij,ij->i", y[:, : n - k], y[:, k:], dtype=np.float64) for k in range(ORDER + 1)])
    error = r[0] * (1 + 1e-9) + 1e-9
    a = np.zeros((ORDER, n_frames))
    for i in range(ORDER):
        k = (r[i + 1] - (a[:i] * r[i:0:-1]).sum(0)) / error
        a[:i], a[i] = a[:i] - k * a[:i][::-1], k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = 1 << (PRECISION - 1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(np.abs(a).max(0), 1e-9))), 0, 15).astype(np.int64)
    return np.clip(np.round(a * 2.0**shift), -top, top - 1).astype(np.int64).T, shift


def _predicted(x: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Residuals (frames, size - ORDER) of linear predictors."""
    n = x.shape[1]
    total = np.zeros((len(x), n - ORDER), np.int32)
    for i in range(ORDER):
        total += factor[:, i : i + 1].astype(np.int32) * x[:, ORDER - 1 - i : n - 1 - i]
    return x[:, ORDER:] - (total >> shift[:, None].astype(np.int32))


def _rice(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unsigned residuals, the Rice parameter of each frame, and the bits of all its codes."""
    u = (r << 1) ^ (r >> 31)
    k = np.clip(np.ceil(np.log2(np.maximum(u.mean(1) * np.log(2), 1))), 0, 14).astype(np.int64)
    return u, k, (u >> k[:, None]).sum(1) + r.shape[1] * (1 + k)


def _head(fields: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Bits (frames, width) of numbers of so many bits each."""
    return np.concatenate([(np.asarray(v)[:, None] >> np.arange(n - 1, -1, -1) & 1).astype(np.uint8) for v, n in fields], 1)


def _bodies(x: np.ndarray) -> list[bytes]:
    """Subframes of frames of one size: x is (frames, size) of int32 samples in 8 bits."""
    n_frames, n = x.shape
    out: list[bytes | None] = [None] * n_frames
    flat = x.min(1) == x.max(1)
    for f in np.flatnonzero(flat):
        out[f] = bytes([0x00, int(x[f, 0]) & 0xFF])
    factor, shift = _predictors(x)
    forms = [_rice(np.diff(x, o, axis=1) if o else x) for o in range(3)] + [_rice(_predicted(x, factor, shift))]
    extra = [8 * o for o in range(3)] + [8 * ORDER + 9 + ORDER * PRECISION]
    cost = np.stack([bits + more for (_, _, bits), more in zip(forms, extra, strict=True)])
    best = cost.argmin(0)
    for form, (u, k, codes) in enumerate(forms):
        rows = np.flatnonzero((best == form) & ~flat)
        if not len(rows):
            continue
        order = form if form < 3 else ORDER
        u, k, codes = u[rows], k[rows], codes[rows]
        fields = [(np.full(len(rows), (8 + order if form < 3 else 32 + order - 1) << 1), 8), *((x[rows, i] & 0xFF, 8) for i in range(order))]
        if form == 3:
            fields += [(np.full(len(rows), PRECISION - 1), 4), (shift[rows], 5), *((factor[rows, i] & ((1 << PRECISION) - 1), PRECISION) for i in range(ORDER))]
        # coding method and partition order are 0; the parameter follows
        top = _head([*fields, (np.zeros(len(rows), np.int64), 6), (k, 4)])
        head = top.shape[1]
        bits = codes + head
        raw = bits >= 8 + 8 * n
        width = int(-(-bits.max() // 8)) + 3
        length = (u >> k[:, None]) + 1 + k[:, None]
        at = np.cumsum(length, 1) + head - 1 - k[:, None] + (np.arange(len(rows)) * width * 8)[:, None]
        value = (1 << k[:, None]) | (u & ((1 << k[:, None]) - 1))
        # a stop bit and its k low bits lie within three bytes
        value = value << (23 - k[:, None] - (at & 7))
        place = (at >> 3).ravel()
        size = len(rows) * width
        body = np.zeros(size, np.int64)
        for by, step in ((16, 0), (8, 1), (0, 2)):
            body += np.bincount(place + step, ((value >> by) & 0xFF).ravel(), size).astype(np.int64)
        body = body.astype(np.uint8).reshape(len(rows), width)
        packed = np.packbits(top, axis=1)
        body[:, : packed.shape[1]] |= packed
        used = -(-bits // 8)
        for i, f in enumerate(rows):
            out[f] = bytes([0x02]) + (x[f] & 0xFF).astype(np.uint8).tobytes() if raw[i] else body[i, : used[i]].tobytes()
    return out


def encode_payloads(payloads: list[bytes], block: int = BLOCK) -> list[bytes]:
    """A FLAC stream for each payload; a byte b is the sample b - 128."""
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p, data in enumerate(payloads):
        for number in range(-(-len(data) // block)):
            groups[min(block, len(data) - number * block)].append((p, number))
    frames: list[list[bytes]] = [[b""] * -(-len(d) // block) for d in payloads]
    for size, members in groups.items():
        for lo in range(0, len(members), max(1, _WORK_BYTES // size)):
            part = members[lo : lo + max(1, _WORK_BYTES // size)]
            x = np.frombuffer(b"".join(payloads[p][i * block : i * block + size] for p, i in part), np.uint8).reshape(len(part), size).astype(np.int32) - 128
            whole = [frame_header(i, size) + body for (_, i), body in zip(part, _bodies(x), strict=True)]
            for (p, i), f, c in zip(part, whole, crc16_all(whole), strict=True):
                frames[p][i] = f + struct.pack(">H", int(c))
    return [_stream(data, own, block) for data, own in zip(payloads, frames, strict=True)]


def _stream(data: bytes, frames: list[bytes], block: int) -> bytes:
    lengths = [len(f) for f in frames]
    at, points = 0, []
    for i, n in enumerate(lengths):
        points.append(struct.pack(">QQH", i * block, at, min(block, len(data) - i * block)))
        at += n
    packed = RATE << 44 | 0 << 41 | 7 << 36 | len(data)
    signed = (np.frombuffer(data, np.uint8) ^ 0x80).tobytes()
    info = struct.pack(">HH", block, block) + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed, usedforsecurity=False).digest()
    # a block's length has 24 bits; without a whole table the decoder finds the frames one by one
    table = b"".join(points[: (1 << 24) // 18 - 1])
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(frames)


@dataclass
class Stream:
    samples: int
    md5: bytes
    bits: int
    points: list[tuple[int, int, int]]
    audio: int
    longest: int


def open_stream(data: bytes) -> Stream:
    """Metadata; audio is where the frames begin."""
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last = 4, False
    samples, md5, bits, points, longest = 0, b"", 8, [], 0
    while not last:
        last, kind, size = data[at] >= 0x80, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0:
            packed, longest = int.from_bytes(body[10:18], "big"), int.from_bytes(body[7:10], "big")
            if packed >> 41 & 7:
                raise ValueError("more than one channel")
            samples, bits, md5 = packed & (1 << 36) - 1, (packed >> 36 & 31) + 1, body[18:34]
        elif kind == 3:
            points = [p for p in struct.iter_unpack(">QQH", body) if p[0] != (1 << 64) - 1]
        at += 4 + size
    return Stream(samples, md5, bits, points, at, longest)


def _read_header(data: bytes, at: int) -> tuple[int, int]:
    """(block size, length of the header with its CRC-8), verified."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError(f"no frame at byte {at}")
    code, rate = data[at + 2] >> 4, data[at + 2] & 15
    first = data[at + 4]
    more = 0
    while first & 0x80 >> more and more < 8:
        more += 1
    end = at + 4 + max(1, more)
    if code in (6, 7):
        size = int.from_bytes(data[end : end + code - 5], "big") + 1
        end += code - 5
    else:
        size = SIZE_CODES[code]
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    head = data[at:end]
    if head not in _known_crc8:  # headers recur, as numbers start anew in each stream
        if len(_known_crc8) > 100_000:
            _known_crc8.clear()
        _known_crc8[head] = crc8(head)
    if _known_crc8[head] != data[end]:
        raise ValueError(f"CRC-8 of the header at byte {at} differs")
    return size, end + 1 - at


_known_crc8: dict[bytes, int] = {}


class _Bits:
    """Frames' bytes in a row, with the place of the next one bit for every bit."""

    def __init__(self, parts: list[bytes]):
        self.data = np.frombuffer(b"".join(parts) + b"\x80\0\0\0\0", np.uint8)
        bits = np.unpackbits(self.data)
        ones = np.flatnonzero(bits)
        self.next_one = np.full(len(bits), len(bits) - 1, np.int32)
        run = np.diff(ones, prepend=-1)
        self.next_one[: int(run.sum())] = np.repeat(ones.astype(np.int32), run)
        self.start = (np.cumsum([0, *map(len, parts)])[:-1]) * 8

    def read(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of n bits (25 at most) from bit places."""
        b = at >> 3
        w = np.zeros(at.shape, np.int64)
        for i in range(4):
            w = w << 8 | self.data[np.minimum(b + i, len(self.data) - 1)]
        return w >> (32 - n - (at & 7)) & ((1 << np.asarray(n, np.int64)) - 1)

    def signed(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        v = self.read(at, n)
        return v - ((v >> (np.asarray(n) - 1) & 1) << n)


def _residuals(bits: _Bits, at: np.ndarray, order: int, size: int, method: int, partition_order: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, size - order) residuals of frames of one form, and the bit after each frame's last."""
    out = np.zeros((size - order, len(at)), np.int64)
    width, escape = (4, 15) if method == 0 else (5, 31)
    row = 0
    for part in range(1 << partition_order):
        count = (size >> partition_order) - (order if part == 0 else 0)
        k = bits.read(at, width)
        at = at + width
        raw = k == escape
        if raw.any():
            f = np.flatnonzero(raw)
            n = bits.read(at[f], 5)
            at[f] += 5
            for i in range(count):
                out[row + i, f] = np.where(n > 0, bits.signed(at[f], np.maximum(n, 1)), 0)
                at[f] += n
        coded = np.flatnonzero(~raw)
        if len(coded):
            pos, low = at[coded], k[coded]
            begin = np.empty((count, len(coded)), np.int64)
            stop = np.empty((count, len(coded)), np.int64)
            skip = low + 1
            for i in range(count):
                begin[i] = pos
                pos = bits.next_one[pos]
                stop[i] = pos
                pos = pos + skip
            u = (stop - begin) << low | np.where(low > 0, bits.read(stop + 1, np.broadcast_to(low, stop.shape)), 0)
            out[row : row + count, coded] = (u >> 1) ^ -(u & 1)
            at[coded] = pos
        row += count
    return out.T, at


def _decode_group(parts: list[bytes], head: list[int], size: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples (frames, size) of frames of one block size, and each frame's length in bytes without its CRC-16."""
    bits = _Bits(parts)
    at = bits.start + 8 * np.array(head)
    kind = bits.read(at, 8) >> 1 & 0x3F
    if (bits.read(at, 8) & 0x81).any():
        raise ValueError("wasted bits are not used in these streams")
    at = at + 8
    out = np.zeros((len(parts), size), np.int64)
    end = np.zeros(len(parts), np.int64)
    form = kind.copy()
    coded = np.flatnonzero((kind >= 8) & (kind <= 12) | (kind >= 32))
    orders = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    for k in np.unique(form):
        f = np.flatnonzero(form == k)
        if k == 0:
            out[f] = bits.signed(at[f], depth)[:, None]
            end[f] = at[f] + depth
        elif k == 1:
            out[f] = bits.signed(at[f][:, None] + np.arange(size) * depth, depth)
            end[f] = at[f] + size * depth
        elif not (8 <= k <= 12 or k >= 32):
            raise ValueError(f"reserved subframe type {k}")
    for k in np.unique(form[coded]) if len(coded) else ():
        f = coded[form[coded] == k]
        order = int(orders[f[0]])
        warm = bits.signed(at[f][:, None] + np.arange(order) * depth, depth) if order else np.zeros((len(f), 0), np.int64)
        pos = at[f] + order * depth
        if k >= 32:
            precision, shift = bits.read(pos, 4) + 1, bits.signed(pos + 4, 5)
            factor = np.stack([bits.signed(pos + 9 + i * precision, precision) for i in range(order)], 1)
            pos = pos + 9 + order * precision
        rule = bits.read(pos, 6)
        for r in np.unique(rule):
            g = np.flatnonzero(rule == r)
            res, stop = _residuals(bits, pos[g] + 6, order, size, int(r) >> 4, int(r) & 15)
            own = f[g]
            end[own] = stop
            if k < 32:
                # differences of the samples as if zeros stood before them, summed up once for each order
                lead = np.diff(np.concatenate((np.zeros((len(g), order), np.int64), warm[g]), 1), order, axis=1) if order else warm[g]
                x = np.concatenate((lead, res), 1)
                for _ in range(order):
                    x = np.cumsum(x, 1)
            else:
                # sample by sample over all frames at once
                along = np.ascontiguousarray(np.concatenate((warm[g], res), 1).T)
                by, down = np.ascontiguousarray(factor[g].T), shift[g]
                for i in range(order, size):
                    total = by[0] * along[i - 1]
                    for j in range(1, order):
                        total += by[j] * along[i - 1 - j]
                    total >>= down
                    along[i] += total
                x = along.T
            out[own] = x
    return out, -(-(end - bits.start) // 8)


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """For each stream its samples (int16) and the (first sample, number of samples) of its frames; all checks made."""
    opened = [open_stream(s) for s in streams]
    out = [np.zeros(o.samples, np.int16) for o in opened]
    frames: list[list[tuple[int, int]]] = [[] for _ in streams]
    groups: dict[tuple[int, int], list[tuple[int, int, int, int, int]]] = defaultdict(list)
    for s, (data, o) in enumerate(zip(streams, opened, strict=True)):
        if sum(p[2] for p in o.points) == o.samples:
            starts = [o.audio + p[1] for p in o.points] + [len(data)]
            for (first, _, count), a, b in zip(o.points, starts[:-1], starts[1:], strict=True):
                size, head = _read_header(data, a)
                if size != count:
                    raise ValueError(f"the seek table and the frame at byte {a} differ")
                groups[size, o.bits].append((s, a, b, head, first))
        else:  # without a whole seek table a frame's end is known when it is decoded
            a, first = o.audio, 0
            while first < o.samples:
                size, head = _read_header(data, a)
                # no more than a frame's bytes: the longest one's, or what no sane encoder exceeds
                x, used = _decode_group([data[a : a + (o.longest or 64 + 2 * size * o.bits)]], [head], size, o.bits)
                b = a + int(used[0]) + 2
                if crc16_all([data[a : b - 2]])[0] != int.from_bytes(data[b - 2 : b], "big"):
                    raise ValueError(f"CRC-16 of the frame at byte {a} differs")
                out[s][first : first + size] = x[0]
                frames[s].append((first, size))
                a, first = b, first + size
    for (size, depth), members in groups.items():
        step = max(1, _WORK_BYTES // size)
        for lo in range(0, len(members), step):
            part = members[lo : lo + step]
            raw = [streams[s][a:b] for s, a, b, _, _ in part]
            x, used = _decode_group(raw, [m[3] for m in part], size, depth)
            if any(u + 2 != len(r) for u, r in zip(used, raw, strict=True)):
                raise ValueError("a frame ends before or after its place in the seek table")
            if (crc16_all([r[:-2] for r in raw]) != np.array([int.from_bytes(r[-2:], "big") for r in raw])).any():
                raise ValueError("CRC-16 of a frame differs")
            for (s, _, _, _, first), row in zip(part, x, strict=True):
                out[s][first : first + size] = row
                frames[s].append((first, size))
    for x, o, own in zip(out, opened, frames, strict=True):
        own.sort()
        if o.bits == 8 and any(o.md5) and hashlib.md5(x.astype(np.int8).tobytes(), usedforsecurity=False).digest() != o.md5:
            raise ValueError("MD5 of the samples differs")
    return list(zip(out, frames, strict=True))


def payload(text: bytes, unit: int = UNIT) -> bytes:
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b" ")


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row a document: its id, n_bytes (unpadded), media (the stream)."""
    kind = documents.schema[id_col].dataType.simpleString()

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = K.text_buffers(batch.column(1))
            for lo, hi in K.blocks(offs, 2 << 20, 4096):
                data = [payload(raw[a:b].tobytes()) for a, b in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs[lo : hi + 1]), pa.int64()), pa.array(encode_payloads(data, block), pa.binary())], names=["id", "n_bytes", "media"])

    return documents.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _slices(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    lo, held, size = 0, [], 0
    for i, x in enumerate(column):
        data = x.as_py() or b""
        held.append(data)
        size += len(data)
        if size > limit:
            yield lo, held
            lo, held, size = i + 1, [], 0
    if held:
        yield lo, held


_BLOCKS = pa.list_(pa.struct([("first_sample", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))
_BLOCKS_DDL = "array<struct<first_sample:bigint,n_samples:int,pcm:binary>>"


def decode(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a stream: its id, n_bytes (if there), media_bytes, media_sha256, and blocks: the PCM of every frame at its first sample (signed, one byte a sample up to 8 bits, else two)."""
    kind = media.schema[id_col].dataType.simpleString()
    has_bytes = "n_bytes" in media.columns

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data in _slices(batch.column(2)):
                full = [i for i, d in enumerate(data) if d]
                blocks: list[list[dict]] = [[] for _ in data]
                for i, (x, frames) in zip(full, decode_streams([data[i] for i in full]), strict=True):
                    width = np.int8 if open_stream(data[i]).bits <= 8 else np.dtype("<i2")
                    pcm = x.astype(width)
                    blocks[i] = [{"first_sample": first, "n_samples": n, "pcm": pcm[first : first + n].tobytes()} for first, n in frames]
                made = [pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()), pa.array(blocks, _BLOCKS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(data)), batch.column(1).slice(lo, len(data)), *made], names=["id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    read = media.select(F.col(f"`{id_col}`").alias("id"), (F.col("n_bytes") if has_bytes else F.lit(None)).cast("long").alias("n_bytes"), F.col(f"`{media_col}`").alias("media"))
    made = read.mapInArrow(run, f"id {kind}, n_bytes long, media_bytes long, media_sha256 string, blocks {_BLOCKS_DDL}")
    return made.withColumnRenamed("id", id_col)


def pcm_blocks(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame, with its place: id, block, first_sample, n_samples, pcm."""
    made = decode(media, id_col, media_col).select(id_col, F.posexplode("blocks").alias("block", "b"))
    return made.select(id_col, "block", "b.first_sample", "b.n_samples", "b.pcm")


def _feature(x: np.ndarray, n_blocks: int, last: int) -> str:
    wide = x.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={n_blocks},sum={int(wide.sum())},energy={int((wide * wide).sum())},peak={int(np.abs(wide).max(initial=0))},crossings={crossings},last={last}"


def read_back(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a stream: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, from the PCM blocks of the decoded stream (8-bit samples)."""
    kind = media.schema[id_col].dataType.simpleString()

    @K.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(4)]
            lists = batch.column("blocks")
            flat, cut = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            raw, offs = K.text_buffers(flat.field("pcm"))
            firsts = flat.field("first_sample").to_numpy()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                x = raw[offs[a] : offs[b]].view(np.int8)
                body = (raw[offs[a] : offs[b]] ^ 0x80).tobytes()
                for c, v in zip(cols, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-16:]), _feature(x, int(b - a), int(firsts[b - 1]) if b > a else 0)), strict=True):
                    c.append(v)
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *made[:3], batch.column("media_bytes"), batch.column("media_sha256"), made[3]], names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    # the blocks stand in the order of their samples, as the decoder sorts a stream's frames
    made = decode(media, id_col, media_col).withColumnRenamed(id_col, "id").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return made.withColumnRenamed("id", id_col)
