"""FLAC: an encoder and a decoder for mono audio in numpy, as column operators.

Both work on groups of ``GROUP`` frames, so that what they hold beside a stream and its
samples doesn't grow with it.  The decoder advances all frames of a group in lockstep: the
n-th Rice code of every frame is read in one vector step, predictors are undone by sums or
by one vector step per sample, and header and frame checksums are folded byte by byte over
all frames together.  Samples are handed on in blocks with their offsets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

BLOCK = 512
GROUP = 1024
RATE = 8000
#: Samples of a block that a reader seeks.
PCM_BLOCK = 4096
#: Fixed predictors of the format: order n takes the n-th difference.
FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}
#: The format's block-size and sample-size codes (fixed values; 6 and 7 read 8 or 16 bits after the header).
BLOCK_CODES = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}
DEPTH_CODES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
RATE_EXTRA = {12: 1, 13: 2, 14: 2}


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for byte in range(256):
        x = byte << (bits - 8)
        for _ in range(8):
            x = ((x << 1) ^ (poly if x >> (bits - 1) else 0)) & ((1 << bits) - 1)
        out.append(x)
    return np.array(out, dtype=np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_LEAD = np.array([16 - int(x).bit_length() for x in range(1 << 16)], dtype=np.uint8)


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate((data, np.zeros(16, np.uint8)))


def checksums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of each span of ``data``, all spans in lockstep."""
    crc = np.zeros(len(starts), dtype=np.uint32)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    live = len(starts)
    mask = np.uint32((1 << bits) - 1)
    for i in range(int(sizes[0]) if len(sizes) else 0):
        while live and sizes[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = ((c << np.uint32(8)) & mask) ^ table[(c >> np.uint32(bits - 8)) ^ data[starts[:live] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    more = 1
    while n >= 1 << (6 * more + 6 - more):
        more += 1
    return bytes([(0xFF << (7 - more)) & 0xFF | n >> (6 * more)] + [0x80 | (n >> (6 * i)) & 0x3F for i in range(more - 1, -1, -1)])


class Encoder:
    """Payload bytes to 8-bit mono FLAC, in frames of ``BLOCK`` samples (a byte b is the sample b - 128)."""

    def __init__(self):
        self.headers: dict[tuple[int, int], bytes] = {}

    def header(self, number: int, size: int) -> bytes:
        if (number, size) not in self.headers:
            if len(self.headers) > 100_000:
                self.headers.clear()
            code = 9 if size == BLOCK else 7
            head = bytes([0xFF, 0xF8, code << 4 | 4, 1 << 1]) + _number(number) + (b"" if size == BLOCK else (size - 1).to_bytes(2, "big"))
            crc = 0
            for b in head:
                crc = int(CRC8[crc ^ b])
            self.headers[number, size] = head + bytes([crc])
        return self.headers[number, size]

    def encode(self, payloads: list[bytes]) -> list[bytes]:
        """Each payload (not empty) as a FLAC stream with a seek table."""
        data = np.frombuffer(b"".join(payloads), dtype=np.uint8).astype(np.int16) - 128
        lengths = np.array([len(p) for p in payloads], dtype=np.int64)
        blocks = -(-lengths // BLOCK)
        number = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + number * BLOCK
        size = np.minimum(BLOCK, np.repeat(lengths, blocks) - number * BLOCK)
        bodies = [b for i in range(0, len(start), GROUP) for b in self._bodies(data, start[i : i + GROUP], size[i : i + GROUP])]
        heads = [self.header(n, s) for n, s in zip(number.tolist(), size.tolist(), strict=True)]
        frames = [h + b for h, b in zip(heads, bodies, strict=True)]
        spans = np.array([len(f) for f in frames], dtype=np.int64)
        joined = np.frombuffer(b"".join(frames), dtype=np.uint8)
        crc = checksums(joined, np.cumsum(spans) - spans, spans, CRC16, 16).tolist()
        frames = [f + c.to_bytes(2, "big") for f, c in zip(frames, crc, strict=True)]
        out, at = [], 0
        for payload, n in zip(payloads, blocks.tolist(), strict=True):
            own = frames[at : at + n]
            at += n
            out.append(self.stream(payload, own))
        return out

    @staticmethod
    def stream(payload: bytes, frames: list[bytes]) -> bytes:
        sizes = [len(f) for f in frames]
        total = len(payload)
        signed = (np.frombuffer(payload, dtype=np.uint8) ^ 0x80).tobytes()
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(signed).digest()
        points, at = [], 0
        for k, n in enumerate(sizes):
            if k % 64 == 0:  # a seek point for every 64th frame
                points.append((k * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, total - k * BLOCK).to_bytes(2, "big"))
            at += n
        table = b"".join(points)
        return b"fLaC" + bytes([0]) + (34).to_bytes(3, "big") + info + bytes([0x83]) + len(table).to_bytes(3, "big") + table + b"".join(frames)

    @staticmethod
    def _bodies(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        """Subframes: constant, fixed order 0 to 2 with a Rice parameter by the mean residual, or verbatim, whichever is shortest."""
        n = len(start)
        column = np.arange(BLOCK)
        inside = column < size[:, None]
        x = np.where(inside, data[np.minimum(start[:, None] + column, len(data) - 1)], 0).astype(np.int32)
        best = 8 + 8 * size  # verbatim
        kind, param = np.full(n, 1), np.zeros(n, dtype=np.int64)
        constant = np.where(inside, x == x[:, :1], True).all(axis=1)
        residuals = {}
        r = x
        for order in range(3):
            if order:
                r = np.concatenate((r[:, :1], np.diff(r, axis=1)), axis=1)
            live = inside & (column >= order)
            u = np.where(live, (r << 1) ^ (r >> 31), 0)
            residuals[order] = u
            count = np.maximum(size - order, 1)
            # The parameter that suits the mean: some two thirds of it are below 2**k.
            k = np.clip(np.floor(np.log2(np.maximum(u.sum(axis=1) / count, 1) * 0.7)).astype(np.int64) + 1, 0, 8)
            bits = 8 + 8 * order + 10 + (u >> k[:, None]).sum(axis=1) + count * (1 + k)
            better = (bits < best) & (size > order)
            best, kind, param = np.where(better, bits, best), np.where(better, 8 + order, kind), np.where(better, k, param)
        kind = np.where(constant, 0, kind)
        bits = np.where(constant, 16, best)
        nbytes = -(-bits // 8)
        base = 8 * (np.cumsum(nbytes) - nbytes)
        out = np.zeros(8 * int(nbytes.sum()), dtype=np.uint8)

        def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
            for i in range(width):
                out[at + i] = (value >> (width - 1 - i)) & 1

        put(base + 1, kind, 6)
        raw = x & 0xFF
        flat = np.flatnonzero(kind == 0)
        put(base[flat] + 8, raw[flat, 0], 8)
        row, col = np.nonzero(inside & (kind == 1)[:, None])
        put(base[row] + 8 + 8 * col, raw[row, col], 8)
        for order in range(3):
            own = np.flatnonzero(kind == 8 + order)
            if not len(own):
                continue
            for i in range(order):
                put(base[own] + 8 + 8 * i, raw[own, i], 8)
            put(base[own] + 8 + 8 * order + 6, param[own], 4)
            live = inside[own] & (column >= order)
            u, k = residuals[order][own], param[own][:, None]
            width = np.where(live, (u >> k) + 1 + k, 0)
            end = base[own][:, None] + 18 + 8 * order + np.cumsum(width, axis=1)
            stop = (end - k - 1)[live]
            out[stop] = 1
            values, ks = u[live], np.broadcast_to(k, u.shape)[live]
            for i in range(8):
                some = ks > i
                out[stop[some] + ks[some] - i] = (values[some] >> i) & 1
        packed = np.packbits(out).tobytes()
        ends = np.cumsum(nbytes).tolist()
        return [packed[e - b : e] for e, b in zip(ends, nbytes.tolist(), strict=True)]


class FlacError(ValueError):
    """The bytes are no FLAC stream that this decoder reads, or a checksum fails."""


class _Bits:
    """Big-endian reads at bit positions, vector by vector."""

    def __init__(self, data: np.ndarray):
        padded = _padded(data).astype(np.uint64)
        self.words = np.zeros(len(data) + 8, dtype=np.uint64)
        for i in range(8):
            self.words |= padded[i : i + len(self.words)] << np.uint64(56 - 8 * i)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits from ``at``, at the top of a 64-bit word."""
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, dtype=np.uint64), at.shape)
        value = (self.peek(at) >> np.uint64(32)) >> (np.uint64(32) - width)
        return value.astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value, width = self.read(at, width), np.broadcast_to(np.asarray(width, dtype=np.int64), at.shape)
        return np.where((width > 0) & (value >> np.maximum(width - 1, 0) == 1), value - (np.int64(1) << width), value)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zero bits before the next one."""
        zeros = _LEAD[self.peek(at) >> np.uint64(48)].astype(np.int64)
        wide = np.flatnonzero(zeros == 16)
        while len(wide):
            if (at[wide] + zeros[wide] >= 8 * len(self.words) - 64).any():
                raise FlacError("a Rice code runs past the end")
            more = _LEAD[self.peek(at[wide] + zeros[wide]) >> np.uint64(48)]
            zeros[wide] += more
            wide = wide[more == 16]
        return zeros


def _frame_bounds(stream: np.ndarray, at: int, end: int) -> list[int]:
    """Candidate frame starts: every sync code on a byte boundary."""
    body = stream[at:end]
    return (np.flatnonzero((body[:-1] == 0xFF) & ((body[1:] & 0xFE) == 0xF8)) + at).tolist() if len(body) > 1 else []


def parse_info(stream: bytes) -> dict:
    """STREAMINFO, the first frame's position (at), and the seek points' distances from it (points)."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, info, last, points = 4, None, False, []
    while not last:
        if at + 4 > len(stream):
            raise FlacError("metadata runs past the end")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            block = stream[at + 4 : at + 4 + size]
            packed = int.from_bytes(block[10:18], "big")
            info = {"block": int.from_bytes(block[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": block[18:34]}
        elif kind == 3:
            table = stream[at + 4 : at + 4 + size]
            points = [int.from_bytes(table[i + 8 : i + 16], "big") for i in range(0, len(table) - 17, 18) if table[i : i + 8] != b"\xff" * 8]
        at += 4 + size
    if info is None:
        raise FlacError("no STREAMINFO")
    if info["channels"] != 1 or info["depth"] > 24:
        raise FlacError("only mono of at most 24 bits is read")
    return info | {"at": at, "points": points}


def _proposed(data: np.ndarray, infos: list[dict], base: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of frames and their streams, as sync codes propose them: those whose header's checksum holds and whose numbers follow one another."""
    starts, owner = [], []
    for i, info in enumerate(infos):
        found = _frame_bounds(data, int(base[i]) + info["at"], int(base[i] + lengths[i]))
        starts += found
        owner += [i] * len(found)
    start, owner = np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64)
    heads = _headers(data, start)
    sequels, due = np.zeros(len(start), dtype=bool), {}
    for k, (i, n, ok) in enumerate(zip(owner.tolist(), heads["number"].tolist(), heads["ok"].tolist(), strict=True)):
        if ok and n == due.get(i, 0):
            sequels[k], due[i] = True, n + 1
    return start[sequels], owner[sequels]


def _walked(data: np.ndarray, info: dict) -> np.ndarray:
    """Starts of a stream's frames, each where the one before ends.

    Seek points start many walks at once; where one of them isn't met by the walk before it, the table is wrong, and one
    walk goes from the first frame on.
    """
    points = sorted({info["at"], *(info["at"] + p for p in info["points"] if info["at"] + p < len(data))})
    for origins in (points, [info["at"]]) if len(points) > 1 else (points,):
        try:
            found = []
            for i in range(0, len(origins), GROUP // 8):
                part = np.array(origins[i : i + GROUP // 8], dtype=np.int64)
                goal = np.array([*origins[i + 1 : i + GROUP // 8 + 1], len(data)][: len(part)], dtype=np.int64)
                low, bits = part[0], _Bits(data[part[0] : goal[-1]])
                while len(part):
                    heads = _headers(data, part)
                    if not heads["ok"].all():
                        raise FlacError("no frame where the last one ends")
                    found.append(part)
                    depth = np.where(heads["depth"] == 0, info["depth"], heads["depth"])
                    part = ((_subframes(bits, 8 * (part - low + heads["bytes"]), heads["size"], depth)[1] + 7) >> 3) + 2 + low
                    if (part > goal).any():
                        raise FlacError("a frame runs past the end")
                    part, goal = part[part < goal], goal[part < goal]
            return np.sort(np.concatenate(found))
        except (FlacError, IndexError, OverflowError):
            if origins == [info["at"]]:
                raise
    raise AssertionError("one of the walks ends or raises")


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples (int32) of each stream; raises FlacError where a checksum or the MD5 fails.

    Sync codes propose where frames begin, so that frames are read many at a time.  A proposal stands only if each frame
    begins where the one before was found to end.  Bytes inside a frame may look like a header: a stream whose proposal
    doesn't stand is read again by walking from each frame's end to the next.
    """
    infos = [parse_info(s) for s in streams]
    lengths = np.array([len(s) for s in streams], dtype=np.int64)
    base = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(streams), dtype=np.uint8)
    start, owner = _proposed(data, infos, base, lengths)
    try:
        return _decode_frames(data, infos, base, lengths, start, owner)
    except (FlacError, IndexError, OverflowError):
        if len(streams) > 1:
            return [decode([s])[0] for s in streams]
    try:
        start = _walked(data, infos[0])
        return _decode_frames(data, infos, base, lengths, start, np.zeros(len(start), dtype=np.int64))
    except (IndexError, OverflowError) as e:
        raise FlacError("the stream ends in a frame, or a number is out of range") from e


def _decode_frames(data: np.ndarray, infos: list[dict], base: np.ndarray, lengths: np.ndarray, start: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    heads = _headers(data, start)
    default = np.array([i["depth"] for i in infos], dtype=np.int64)
    depth = np.where(heads["depth"] == 0, default[owner], heads["depth"])
    first = np.searchsorted(owner, np.arange(len(infos) + 1))
    begins = [int(start[a]) if a < b else None for a, b in zip(first[:-1], first[1:], strict=True)]
    if any(at is not None and at != low + info["at"] for at, low, info in zip(begins, base.tolist(), infos, strict=True)):
        raise FlacError("bytes before the first frame")
    closing = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
    follow = np.where(closing, (base + lengths)[owner], np.concatenate((start[1:], [len(data)]))) if len(owner) else start
    samples = [np.zeros(0, np.int32)]
    for i in range(0, len(start), GROUP):
        g = slice(i, i + GROUP)
        low, size = start[i], heads["size"][g]
        own = data[low : int(follow[g][-1])]
        bits = _Bits(own)
        rows, stop = _subframes(bits, 8 * (start[g] - low + heads["bytes"][g]), size, depth[g])
        end = (stop + 7) >> 3
        if (end + low + 2 != follow[g]).any():
            raise FlacError("bytes between frames, or a frame that is cut")
        if (checksums(own, start[g] - low, end - (start[g] - low), CRC16, 16).astype(np.int64) != bits.read(8 * end, 16)).any():
            raise FlacError("a frame's checksum fails")
        samples.append(rows[np.arange(rows.shape[1]) < size[:, None]].astype(np.int32))
    flat, per_frame = np.concatenate(samples), np.concatenate(([0], np.cumsum(heads["size"])))
    out = []
    for i, info in enumerate(infos):
        pcm = flat[per_frame[first[i]] : per_frame[first[i + 1]]]
        width = (info["depth"] + 7) // 8
        raw = pcm.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
        if len(pcm) != info["samples"] or info["md5"] != bytes(16) and hashlib.md5(raw).digest() != info["md5"]:
            raise FlacError("the decoded samples differ from the stream's digest")
        out.append(pcm)
    return out


def _headers(data: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    padded = np.concatenate((data, np.zeros(32, np.uint8)))
    byte = lambda i: padded[start + i].astype(np.int64)
    size_code, rate_code, channel, depth_code = byte(2) >> 4, byte(2) & 15, byte(3) >> 4, byte(3) >> 1 & 7
    lead = byte(4)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE, lead < 0xFF], [0, -1, 1, 2, 3, 4, 5, 6], -1)
    ok = (byte(1) == 0xF8) & (channel == 0) & (more >= 0) & (byte(3) & 1 == 0)
    count = np.maximum(more, 0)
    number = np.where(count == 0, lead, lead & (0x3F >> count))
    for i in range(1, 7):
        number = np.where(count >= i, number << 6 | (byte(4 + i) & 0x3F), number)
    at = start + 5 + count
    one, two = padded[at].astype(np.int64), padded[at].astype(np.int64) << 8 | padded[at + 1]
    sizes = np.zeros(16, dtype=np.int64)
    for code, n in BLOCK_CODES.items():
        sizes[code] = n
    size = np.select([size_code == 6, size_code == 7], [one + 1, two + 1], sizes[size_code])
    extra = np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == c for c in RATE_EXTRA], list(RATE_EXTRA.values()), 0)
    depths = np.zeros(8, dtype=np.int64)
    for code, n in DEPTH_CODES.items():
        depths[code] = n
    nbytes = 5 + count + extra
    ok &= (size > 0) & (start + nbytes < len(data))
    crc = checksums(padded, start, nbytes, CRC8, 8)
    ok &= crc == padded[start + nbytes]
    return {"ok": ok, "number": number, "size": size, "depth": depths[depth_code], "bytes": nbytes + 1}


def _subframes(bits: _Bits, at: np.ndarray, size: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of one subframe each, as rows, and the bit after each."""
    n = len(at)
    out = np.zeros((n, int(size.max()) if n else 0), dtype=np.int64)
    kind = bits.read(at, 8) >> 1
    wasted = bits.read(at, 8) & 1
    at = at + 8
    some = wasted > 0
    if some.any():
        run = np.where(some, bits.unary(at) + 1, 0)
        at, depth, wasted = at + run, depth - run, run
    end = at.copy()
    constant = np.flatnonzero(kind == 0)
    out[constant] = bits.signed(at[constant], depth[constant])[:, None]
    end[constant] += depth[constant]
    verbatim = np.flatnonzero(kind == 1)
    if len(verbatim):
        row, place = np.nonzero(np.arange(int(size[verbatim].max())) < size[verbatim][:, None])
        rows = verbatim[row]
        out[rows, place] = bits.signed(end[rows] + depth[rows] * place, depth[rows])
        end[verbatim] += depth[verbatim] * size[verbatim]
    for code in np.unique(kind[(kind > 1)]).tolist():
        rows = np.flatnonzero(kind == code)
        if 8 <= code <= 12:
            order = code - 8
        elif code >= 32:
            order = code - 31
        else:
            raise FlacError("a reserved subframe type")
        for i in range(order):
            out[rows, i] = bits.signed(end[rows], depth[rows])
            end[rows] += depth[rows]
        shift = np.zeros(len(rows), dtype=np.int64)
        if code < 32:
            taps = np.broadcast_to(np.array(FIXED[order], dtype=np.int64), (len(rows), order))
        else:
            precision = bits.read(end[rows], 4) + 1
            shift = bits.signed(end[rows] + 4, 5)
            end[rows] += 9
            taps = np.zeros((len(rows), order), dtype=np.int64)
            for i in range(order):
                taps[:, i] = bits.signed(end[rows], precision)
                end[rows] += precision
        end[rows] = _rice(bits, end[rows], size[rows], order, out, rows)
        x = out[rows]
        if code < 32 and order <= 2:
            for j in range(order, 0, -1):
                # Undo one difference: the running sum from sample j - 1, whose own difference is known.
                lead = x[:, :order].copy()
                for d in range(j - 1):
                    lead = np.diff(lead, axis=1)
                x[:, order - 1] = lead[:, -1]
                x[:, order - 1 :] = np.cumsum(x[:, order - 1 :], axis=1)
                x[:, :order] = out[rows][:, :order]
        else:
            for i in range(order, x.shape[1]):
                x[:, i] += (taps * x[:, i - order : i][:, ::-1]).sum(axis=1) >> shift
        out[rows] = x
    return out << wasted[:, None], end


def _rice(bits: _Bits, at: np.ndarray, size: np.ndarray, order: int, out: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Reads the residuals of the rows into ``out``, all rows in lockstep; returns the bit after each.

    Longer rows come first, so that the rows that still go on are the first ones.  A code is mostly read from one word.
    """
    by = np.argsort(-size, kind="stable")
    at, size, most = at[by], size[by], int(size.max(initial=0))
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    at = at + 6
    wide = 4 + method
    each, several = np.maximum(size >> parts, 1), bool(parts.any())
    going = np.searchsorted(-size, -np.arange(most), side="left").tolist()
    k, raw = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
    found = np.zeros((most, len(at)), dtype=np.int64)
    some_raw = False
    one = np.uint64(1)
    for i in range(order, most):
        m = going[i]
        if several or i == order:
            fresh = np.flatnonzero((i % each[:m] == 0) | (i == order))
            p = bits.read(at[fresh], wide[fresh])
            at[fresh] += wide[fresh]
            escape = p == (1 << wide[fresh]) - 1
            width = bits.read(at[fresh], 5)
            at[fresh] += np.where(escape, 5, 0)
            k[fresh], raw[fresh] = np.where(escape, width, p), escape
            some_raw = bool(raw.any())
            low, shift, step = k.astype(np.uint64), (63 - k).astype(np.uint64), k + 1
        if not some_raw:
            a = at[:m]
            word = bits.peek(a)
            lead = _LEAD[word >> np.uint64(48)]
            if int(lead.max()) < 16:
                zeros = lead.astype(np.uint64)
                u = (zeros << low[:m] | (word << (zeros + one)) >> one >> shift[:m]).view(np.int64)
                found[i, :m] = (u >> 1) ^ -(u & 1)
                a += lead
                a += step[:m]
                continue
        pick = np.flatnonzero(~raw[:m])
        a, kk = at[pick], k[pick]
        zeros = bits.unary(a)
        u = zeros << kk | bits.read(a + zeros + 1, kk)
        found[i, pick] = (u >> 1) ^ -(u & 1)
        at[pick] = a + zeros + 1 + kk
        if some_raw:
            pick = np.flatnonzero(raw[:m])
            found[i, pick] = bits.signed(at[pick], k[pick])
            at[pick] += k[pick]
    out[rows[by], order:most] = found[order:].T
    end = np.empty_like(at)
    end[by] = at
    return end


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and end row of runs of values of about ``most`` bytes (a longer value ends its run)."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        end = min(int(np.searchsorted(ends, before + most)) + 1, len(sizes))
        yield first, end
        first = end


def _encoded(coder: Encoder, payloads: list[bytes | None]) -> list[bytes | None]:
    full = [x for x in payloads if x]
    made = iter(coder.encode(full) if full else [])
    return [next(made) if x else None for x in payloads]


def _decoded(streams: list[bytes | None]) -> list[tuple[bytes | None, str | None]]:
    """Samples as bytes, or what is wrong with the stream."""

    def raw(stream: bytes, pcm: np.ndarray) -> bytes:
        return pcm.astype("<i4").view(np.uint8).reshape(-1, 4)[:, : (parse_info(stream)["depth"] + 7) // 8].tobytes()

    def alone(stream: bytes) -> tuple[bytes | None, str | None]:
        try:
            return raw(stream, decode([stream])[0]), None
        except (FlacError, IndexError, OverflowError) as e:
            return None, str(e)

    full = [x for x in streams if x is not None]
    try:
        made = iter([(raw(s, p), None) for s, p in zip(full, decode(full), strict=True)] if full else [])
    except (FlacError, IndexError, OverflowError):
        made = iter(map(alone, full))  # one bad stream: each by itself
    return [next(made) if x is not None else (None, None) for x in streams]


def _sizes(batch: pd.Series) -> np.ndarray:
    return np.array([len(x or b"") for x in batch], dtype=np.int64)


def encode_flac(df: DataFrame, *, payload_col: str = "payload", media_col: str = "media", run_bytes: int = 1 << 19) -> DataFrame:
    """Adds ``media_col``: the payload's bytes b as samples b - 128 of a lossless 8-bit mono FLAC stream.

    A null or empty payload gives null.  Equal payloads give equal bytes.  A payload of any length is coded whole; a task
    holds one run of ``run_bytes``, or one longer payload and its stream.
    """

    @F.pandas_udf("binary")
    def coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Encoder()
        for batch in batches:
            yield pd.Series([x for a, b in _runs(_sizes(batch), run_bytes) for x in _encoded(coder, batch[a:b].tolist())], dtype=object)

    return df.withColumn(media_col, coded(F.col(payload_col)))


def decode_flac(df: DataFrame, *, media_col: str = "media", run_bytes: int = 1 << 19) -> DataFrame:
    """Adds ``pcm`` (little-endian signed samples of the stream's byte width) and ``media_error``.

    Frame and stream checksums are verified; a stream that fails one, or is none, has null pcm and a reason
    in ``media_error``.  Null media give null for both.
    """

    @F.pandas_udf("pcm binary, media_error string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for a, b in _runs(_sizes(batch), run_bytes) for x in _decoded(batch[a:b].tolist())], columns=["pcm", "media_error"])

    return df.withColumn("_decoded", decoded(F.col(media_col))).withColumns({"pcm": F.col("_decoded.pcm"), "media_error": F.col("_decoded.media_error")}).drop("_decoded")


def cut_blocks(pcm: bytes, block: int = PCM_BLOCK, width: int = 1) -> Iterator[tuple[int, bytes]]:
    """Sample offset and bytes of each block of ``block`` samples of ``width`` bytes."""
    for at in range(0, len(pcm) // width, block):
        yield at, pcm[at * width : (at + block) * width]


def read_blocks(df: DataFrame, describe: Callable[[bytes | None, Iterator[tuple[int, bytes]]], tuple], fields: StructType, *, media_col: str = "media", block: int = PCM_BLOCK, run_bytes: int = 1 << 19) -> DataFrame:
    """Decodes stored streams and tells of each what ``describe`` does of the stream and its blocks (of 8-bit samples, with their offsets).

    In place of ``media_col`` come ``fields``, those values, and ``media_error``, as ``decode_flac`` has it; a stream that
    fails has no blocks.  A task holds one run of ``run_bytes`` of streams and samples, or one longer stream's, at a time.
    """
    schema = StructType([*df.drop(media_col).schema.fields, *fields.fields, StructField("media_error", StringType())])
    kinds = to_arrow_schema(StructType(schema.fields[-len(fields) - 1 :]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(media_col)
            others = batch.drop_columns([media_col])
            for first, end in _runs(pc.fill_null(pc.binary_length(stored), 0).to_numpy(zero_copy_only=False), run_bytes):
                media = stored.slice(first, end - first).to_pylist()
                rows = [(*describe(m, cut_blocks(pcm or b"", block)), error) for m, (pcm, error) in zip(media, _decoded(media), strict=True)]
                told = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*others.slice(first, end - first).columns, *told], [*others.schema.names, *kinds.names])

    return df.mapInArrow(run, schema)


def pcm_blocks(df: DataFrame, *, id_col: str = "doc_id", block: int = PCM_BLOCK, width: int = 1) -> DataFrame:
    """One row per block of ``block`` samples of ``pcm``: the id, block, sample_offset, samples and pcm.

    A reader seeks sample s in block s div ``block``.  Rows without pcm give no block; rows that repeat an id give its blocks as often.
    """
    n = F.floor(F.octet_length("pcm") / width)
    cut = df.filter("pcm is not null and octet_length(pcm) > 0").select(F.col(id_col), "pcm", F.explode(F.sequence(F.lit(0), (F.ceil(n / block) - 1).cast("int"))).alias("block"))
    part = F.substring(F.col("pcm"), F.col("block") * block * width + 1, F.lit(block * width))
    return cut.select(id_col, "block", (F.col("block").cast("long") * block).alias("sample_offset"), F.floor(F.octet_length(part) / width).alias("samples"), part.alias("pcm"))
