"""FLAC media columns: 8-bit mono streams, coded and decoded many frames at a time."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bytes import ranges, slices, text_sizes
from ._names import Named
from ._scratch import materialize

#: Samples of a frame and of a payload's unit; frames between two seek points.
BLOCK, SEEK_EVERY = 192, 64
LPC_ORDER, LPC_PRECISION = 4, 10
# Fixed values of the format: block size codes, CRC polynomials.
BLOCK_CODES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
_U = np.uint64


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, dtype=np.uint16)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_far = CRC16[None, :].copy()


def _crc16_table(n: int) -> np.ndarray:
    """What a byte adds to the CRC if k bytes follow it, for k below n."""
    global _far
    while len(_far) < n:
        last = _far[-1]
        _far = np.vstack([_far, (CRC16[last >> 8] ^ (last << 8))[None, :]])
    return _far


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each range; leading zeros don't change it, so ranges are right-aligned."""
    out = np.zeros(len(starts), dtype=np.uint16)
    step = max(1, (1 << 21) // max(int((ends - starts).max(initial=1)), 1))
    for a in range(0, len(starts), step):
        s, e = starts[a:a + step], ends[a:a + step]
        n = int((e - s).max(initial=0))
        at = e[:, None] - np.arange(n, 0, -1)[None, :]
        byte = np.where(at >= s[:, None], data[np.maximum(at, 0)], 0)
        table = _crc16_table(n)[:n][::-1].reshape(-1)
        out[a:a + step] = np.bitwise_xor.reduce(table[byte + (np.arange(n) * 256)[None, :]], axis=1)
    return out


def _utf8_number(n: int) -> bytes:
    """The frame number as UTF-8 codes a code point, here up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    for _ in range(size - 1):
        tail.append(0x80 | n & 0x3F)
        n >>= 6
    return bytes([(0xFF << (8 - size)) & 0xFF | n, *reversed(tail)])


_heads: list[bytes] = []


def _head(number: int) -> bytes:
    """Frame header: fixed blocks of 192, mono, 8 bits."""
    for k in range(len(_heads), number + 1):
        raw = bytes([0xFF, 0xF8, 0x10, 0x02]) + _utf8_number(k)
        c = 0
        for byte in raw:
            c = int(CRC8[c ^ byte])
        _heads.append(raw + bytes([c]))
    return _heads[number]


def _levinson(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors of each row and their shifts, from exact autocorrelations."""
    r = [(x[:, lag:] * x[:, :x.shape[1] - lag]).sum(axis=1).astype(np.float64) for lag in range(LPC_ORDER + 1)]
    error = np.maximum(r[0], 1.0)
    a: list[np.ndarray] = []
    for k in range(LPC_ORDER):
        top = r[k + 1].copy()
        for j in range(k):
            top = top - a[j] * r[k - j]
        reflect = top / np.maximum(error, 1e-9)
        a = [a[j] - reflect * a[k - 1 - j] for j in range(k)] + [reflect]
        error = error * (1 - reflect * reflect)
    coef = np.stack(a, axis=1)
    _, power = np.frexp(np.abs(coef).max(axis=1))
    shift = np.clip(LPC_PRECISION - 1 - power, 0, 15)
    limit = 1 << (LPC_PRECISION - 1)
    return np.clip(np.rint(coef * (2.0 ** shift)[:, None]), -limit, limit - 1).astype(np.int64), shift.astype(np.int64)


def _rice(residual: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Zigzag values of each row, its Rice parameter and its bits."""
    u = (residual << 1) ^ (residual >> 31)
    total, n = u.sum(axis=1, dtype=np.int64), residual.shape[1]
    k = np.zeros(len(u), dtype=np.int32)
    for bit in range(14):
        k += (total * 69 // (n * 100)) >> bit > 0
    k = np.minimum(k, 14)
    return u, k, (u >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k + 1)


def encode(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream per payload, whose length is a positive multiple of 192."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    raw = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    x = (raw.astype(np.int32) - 128).reshape(-1, BLOCK)
    lanes = len(x)
    number = np.arange(lanes) - np.repeat(np.cumsum(frames) - frames, frames)
    # candidates: verbatim, fixed orders 0 to 2, one linear predictor
    kind = np.ones(lanes, dtype=np.int64)
    bits = np.full(lanes, 8 * BLOCK, dtype=np.int64)
    order, rice_k = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int32)
    best = np.zeros((lanes, BLOCK), dtype=np.int32)

    def offer(residual: np.ndarray, p: int, code: int, extra: int) -> None:
        u, k, cost = _rice(residual)
        cost = cost + 10 + 8 * p + extra
        win = cost < bits
        bits[win], order[win], kind[win], rice_k[win] = cost[win], p, code, k[win]
        best[win, p:] = u[win]

    d = x
    for p in range(3):
        offer(d, p, 8 + p, 0)
        d = np.diff(d, axis=1)
    coef, shift = _levinson(x.astype(np.int64))
    guess = sum(coef[:, j:j + 1] * x[:, LPC_ORDER - 1 - j:BLOCK - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    offer((x[:, LPC_ORDER:] - guess).astype(np.int32), LPC_ORDER, 31 + LPC_ORDER, 9 + LPC_ORDER * LPC_PRECISION)
    flat = (x == x[:, :1]).all(axis=1)
    kind[flat], bits[flat], order[flat] = 0, 8, 0

    heads = [_head(k) for k in range(int(frames.max(initial=0)))]
    head_size = np.array([len(h) for h in heads])[number]
    size = head_size + (8 + bits + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    bit = np.zeros(int(ends[-1]) * 8 if lanes else 0, dtype=np.uint8)
    cursor = (starts + head_size) * 8

    def put(at: np.ndarray, value: np.ndarray, width: int) -> None:
        for b in range(width):
            bit[at + b] = (value >> (width - 1 - b)) & 1

    put(cursor, kind << 1, 8)
    cursor = cursor + 8
    plain = np.flatnonzero(kind <= 1)
    put(cursor[plain], raw.reshape(-1, BLOCK)[plain, 0].astype(np.int64) ^ 128, 8)
    whole = np.flatnonzero(kind == 1)
    for j in range(1, BLOCK):
        put(cursor[whole] + 8 * j, x[whole, j] & 255, 8)
    for p in range(1, LPC_ORDER + 1):
        with_p = np.flatnonzero((order == p) & (kind >= 8))
        for j in range(p):
            put(cursor[with_p] + 8 * j, x[with_p, j] & 255, 8)
    cursor = cursor + 8 * order
    lpc = np.flatnonzero(kind >= 32)
    put(cursor[lpc], np.full(len(lpc), LPC_PRECISION - 1), 4)
    put(cursor[lpc] + 4, shift[lpc], 5)
    for j in range(LPC_ORDER):
        put(cursor[lpc] + 9 + LPC_PRECISION * j, coef[lpc, j] & ((1 << LPC_PRECISION) - 1), LPC_PRECISION)
    cursor[lpc] += 9 + LPC_ORDER * LPC_PRECISION
    for k in np.unique(rice_k[kind >= 8]).tolist():
        for p in range(LPC_ORDER + 1):
            at = np.flatnonzero((kind >= 8) & (rice_k == k) & (order == p))
            if len(at):
                put(cursor[at] + 6, np.full(len(at), k), 4)  # method 0, one partition
                u = best[at, p:].astype(np.int64)
                length = (u >> k) + 1 + k
                stop = (cursor[at] + 10)[:, None] + np.cumsum(length, axis=1) - k
                bit[stop - 1] = 1
                put(stop, u, k)
    data = np.packbits(bit)
    for width in np.unique(head_size).tolist():
        at = np.flatnonzero(head_size == width)
        table = np.frombuffer(b"".join(h if len(h) == width else bytes(width) for h in heads), dtype=np.uint8).reshape(-1, width)
        data[starts[at][:, None] + np.arange(width)] = table[number[at]]
    check = crc16(data, starts, ends - 2)
    data[ends - 2], data[ends - 1] = check >> 8, check & 255
    blob, out, lane = data.tobytes(), [], 0
    signed = x.astype(np.int8).tobytes()
    for n, p in zip(frames.tolist(), payloads, strict=True):
        a, z = int(starts[lane]), int(ends[lane + n - 1])
        least, most = int(size[lane:lane + n].min()), int(size[lane:lane + n].max())
        info = (BLOCK << 16 | BLOCK).to_bytes(4, "big") + least.to_bytes(3, "big") + most.to_bytes(3, "big")
        info += (8000 << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5(signed[lane * BLOCK:(lane + n) * BLOCK], usedforsecurity=False).digest()
        seek = b"".join((k * BLOCK).to_bytes(8, "big") + (int(starts[lane + k]) - a).to_bytes(8, "big")
                        + BLOCK.to_bytes(2, "big") for k in range(0, n, SEEK_EVERY))
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + blob[a:z])
        lane += n
    return out


class Corrupt(ValueError):
    """A stream that can't be decoded, or whose checksum fails."""


@dataclass
class Decoded:
    samples: np.ndarray  # int32
    sizes: np.ndarray  # samples of each frame
    bits: int


class _Bits:
    """Reads at a bit position of its own for every lane."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
        self.window = np.zeros(len(data) + 8, dtype=np.uint64)
        for k in range(8):
            self.window |= padded[k:k + len(self.window)].astype(np.uint64) << _U(56 - 8 * k)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """57 bits at least, left-aligned."""
        return self.window[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width) -> np.ndarray:
        """Unsigned numbers of up to 57 bits; width 0 gives 0."""
        width = np.asarray(width, dtype=np.uint64)
        return ((self.peek(at) >> _U(1)) >> (_U(63) - width)).astype(np.int64)

    def signed(self, at: np.ndarray, width) -> np.ndarray:
        value, width = self.take(at, width), np.asarray(width, dtype=np.int64)
        return value - ((value >> np.maximum(width - 1, 0)) << width) * (width > 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        zeros, pending = np.zeros(len(at), dtype=np.int64), None
        while True:
            top = (self.peek(at if pending is None else at[pending] + zeros[pending]) >> _U(11)).astype(np.int64)
            found = 52 - ((top.astype(np.float64).view(np.int64) >> 52) - 1023)
            if pending is None:
                zeros, none = np.where(top > 0, found, 46), np.flatnonzero(top == 0)
            else:
                zeros[pending] += np.where(top > 0, found, 46)
                none = pending[top == 0]
            if not len(none):
                return zeros
            if int((at[none] + zeros[none]).max()) >= 8 * (len(self.window) - 8):
                raise Corrupt("a residual runs beyond the stream")
            pending = none


def _stream_info(data: bytes) -> tuple[int, int, int, bytes]:
    """Where the frames begin, bits per sample, all samples, MD5."""
    if data[:4] != b"fLaC":
        raise Corrupt("not a FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        if at + 4 > len(data):
            raise Corrupt("it ends within its metadata")
        last, kind, size = data[at] >= 128, data[at] & 127, int.from_bytes(data[at + 1:at + 4], "big")
        if kind == 0:
            info = data[at + 4:at + 4 + size]
        at += 4 + size
    if len(info) < 34:
        raise Corrupt("no stream information")
    word = int.from_bytes(info[10:18], "big")
    if (word >> 41) & 7:
        raise Corrupt("more than one channel")
    return at, ((word >> 36) & 31) + 1, word & ((1 << 36) - 1), info[18:34]


def _frame_heads(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places that look like frame headers with a valid CRC-8, by stream: (stream,
    place, header size, number, samples)."""
    at = np.flatnonzero((data[:-1] == 0xFF) & (data[1:] == 0xF8))
    stream = np.searchsorted(begin, at, "right") - 1
    inside = (stream >= 0) & (at >= begin[stream]) & (at + 6 <= end[stream])
    at, stream = at[inside], stream[inside]
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)])
    code, lead = padded[at + 2] >> 4, padded[at + 4].astype(np.int64)
    more = np.zeros(len(at), dtype=np.int64)
    for size in range(2, 8):
        more = np.where((lead >= (0xFF << (8 - size)) & 0xFF) & (lead >= 0xC0), size - 1, more)
    number = np.where(more > 0, lead & ((1 << np.maximum(6 - more, 0)) - 1), lead)
    for k in range(1, 7):
        number = np.where(more >= k, number << 6 | padded[at + 4 + k] & 0x3F, number)
    tail = at + 5 + more
    samples = np.zeros(len(at), dtype=np.int64)
    for c, n in BLOCK_CODES.items():
        samples[code == c] = n
    samples = np.where(code == 6, padded[tail].astype(np.int64) + 1, samples)
    samples = np.where(code == 7, (padded[tail].astype(np.int64) << 8 | padded[tail + 1]) + 1, samples)
    size = tail - at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = padded[at + 2] & 15
    size = size + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    crc = np.zeros(len(at), dtype=np.uint16)
    for k in range(int(size.max(initial=0))):
        crc = np.where(k < size, CRC8[crc ^ padded[np.minimum(at + k, len(padded) - 1)]], crc)
    good = (crc == padded[at + size]) & (samples > 0) & (padded[at + 3] >> 4 == 0)
    return stream[good], at[good], size[good] + 1, number[good], samples[good]


def _chain(data, end: int, at, number) -> np.ndarray:
    """Of one stream's possible headers, those of its frames: consecutive numbers, and a
    valid CRC-16 from each to the next."""
    picked: list[int] = []
    k = 0
    if not len(at) or number[0] != 0:
        raise Corrupt("no first frame")
    while True:
        picked.append(k)
        for nxt in [*(j for j in range(k + 1, len(at)) if number[j] == number[k] + 1), len(at)]:
            stop = end if nxt == len(at) else int(at[nxt])
            if crc16(data, np.array([at[k]]), np.array([stop]))[0] == 0:
                break
        else:
            raise Corrupt(f"frame {number[k]}: its CRC-16 fails")
        if nxt == len(at):
            return np.array(picked)
        k = nxt


def _subframes(bits: _Bits, cursor: np.ndarray, n: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [n, lanes] of frames that have n samples each, and where they end."""
    head = bits.take(cursor, 8)
    kind, cursor = head >> 1 & 63, cursor + 8
    if (head & 129).any() or ((kind > 1) & (kind < 8) | (kind > 12) & (kind < 32)).any():
        raise Corrupt("a reserved kind of subframe, or wasted bits")
    out = np.zeros((n, len(cursor)), dtype=np.int64)
    same = np.flatnonzero(kind == 0)
    out[:, same] = bits.signed(cursor[same], depth)
    cursor[same] += depth
    plain = np.flatnonzero(kind == 1)
    for i in range(n if len(plain) else 0):
        out[i, plain] = bits.signed(cursor[plain] + depth * i, depth)
    cursor[plain] += depth * n
    lanes = np.flatnonzero(kind >= 8)
    if not len(lanes):
        return out, cursor
    code, at = kind[lanes], cursor[lanes]
    order = np.where(code >= 32, code - 31, code - 8)
    if int(order.max()) > n:
        raise Corrupt("more warm-up samples than samples")
    x = np.zeros((n, len(lanes)), dtype=np.int64)
    for j in range(int(order.max())):
        has = np.flatnonzero(order > j)
        x[j, has] = bits.signed(at[has], depth)
        at[has] += depth
    lpc = np.flatnonzero(code >= 32)
    coef, shift = np.zeros((32, len(lanes)), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    if len(lpc):
        precision = bits.take(at[lpc], 4) + 1
        shift[lpc] = bits.signed(at[lpc] + 4, 5)
        at[lpc] += 9
        if (precision == 16).any() or (shift < 0).any():
            raise Corrupt("a reserved predictor")
        for j in range(int(order[lpc].max())):
            has = order[lpc] > j
            coef[j, lpc[has]] = bits.signed(at[lpc[has]], precision[has])
            at[lpc[has]] += precision[has]
    method = bits.take(at, 2)
    if (method > 1).any():
        raise Corrupt("a reserved residual")
    part = n >> bits.take(at + 2, 4)
    if (part == 0).any():
        raise Corrupt("too many partitions")
    at += 6
    width = 4 + method
    param, escaped = np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=bool)
    low = int(order.min())
    even, plain_part = low == int(order.max()), bool((part == n).all())
    for i in range(n):
        new = slice(None) if i == 0 else None if plain_part else np.flatnonzero(i % part == 0)
        if new is not None and (i == 0 or len(new)):
            got = bits.take(at[new], width[new])
            at[new] += width[new]
            escaped[new] = got == (1 << width[new]) - 1
            raw = bits.take(at[new], np.where(escaped[new], 5, 0))
            at[new] += np.where(escaped[new], 5, 0)
            param[new] = np.where(escaped[new], raw, got)
            some_escaped = bool(escaped.any())
        if i < low:
            continue
        all_ = even or i >= int(order.max())
        has = slice(None) if all_ and not some_escaped else np.flatnonzero((i >= order) & ~escaped)
        here, k = at[has], param[has]
        zeros = bits.unary(here)
        here = here + zeros + 1
        u = zeros << k | bits.take(here, k)
        x[i, has] = (u >> 1) ^ -(u & 1)
        at[has] = here + k
        if some_escaped:
            has = np.flatnonzero((i >= order) & escaped)
            x[i, has] = bits.signed(at[has], param[has])
            at[has] += param[has]
    for p in np.unique(order).tolist():
        fixed = np.flatnonzero((code < 32) & (order == p))
        if p and len(fixed):
            y = x[:, fixed]
            for level in range(1, p):  # warm-up samples to differences
                y[level:p] = y[level:p] - y[level - 1:p - 1]
            for level in range(p - 1, -1, -1):
                y[level:] = np.cumsum(y[level:], axis=0)
            x[:, fixed] = y
        own = np.flatnonzero((code >= 32) & (order == p))
        if len(own):
            y, c, s = x[:, own], coef[:, own], shift[own]
            for i in range(p, n):
                guess = c[0] * y[i - 1]
                for j in range(1, p):
                    guess += c[j] * y[i - 1 - j]
                y[i] += guess >> s
            x[:, own] = y
    out[:, lanes], cursor[lanes] = x, at
    return out, cursor


def decode(streams: list[bytes]) -> list[Decoded]:
    """Samples of each stream; raises ``Corrupt`` if any can't be decoded.

    Headers are found by their sync code and CRC-8, frames confirmed by consecutive
    numbers and their CRC-16, and the whole by the MD5 of the samples.  Frames with the
    same number of samples are then decoded in step, one sample of each at a time.
    """
    if not streams:
        return []
    infos = [_stream_info(s) for s in streams]
    data = np.frombuffer(b"".join(streams) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    begin = ends - [len(s) - i[0] for s, i in zip(streams, infos, strict=True)]
    stream, at, size, number, samples = _frame_heads(data, begin, ends)
    first = np.searchsorted(stream, np.arange(len(streams) + 1))
    plain = number == np.arange(len(at)) - first[stream]
    stop = np.append(at[1:], 0)
    last = first[1:][np.diff(first) > 0] - 1
    stop[last] = ends[stream[last]]
    plain &= crc16(data, at, np.maximum(stop, at)) == 0
    keep = np.ones(len(at), dtype=bool)
    for k in np.unique(stream[~plain]).tolist():  # a header look-alike, or a damaged frame
        own = slice(first[k], first[k + 1])
        keep[own] = False
        keep[first[k] + _chain(data, int(ends[k]), at[own], number[own])] = True
    stream, at, size, samples = stream[keep], at[keep], size[keep], samples[keep]
    bits, depth = _Bits(data), np.array([i[1] for i in infos])
    stop = np.append(at[1:], 0)
    total = np.cumsum(samples)
    flat = np.zeros(int(total[-1]) if len(total) else 0, dtype=np.int32)
    for n, d in {(int(a), int(b)) for a, b in zip(samples, depth[stream], strict=True)}:
        own = np.flatnonzero((samples == n) & (depth[stream] == d))
        got, _ = _subframes(bits, (at[own] + size[own]) * 8, n, d)
        flat[(total[own] - n)[:, None] + np.arange(n)] = got.T
    out = []
    first = np.searchsorted(stream, np.arange(len(streams) + 1))
    for k, (_, d, count, md5) in enumerate(infos):
        sizes = samples[first[k]:first[k + 1]]
        end = int(total[first[k + 1] - 1]) if len(sizes) else 0
        own = flat[end - int(sizes.sum()):end]
        if count and count != len(own):
            raise Corrupt("not as many samples as it says")
        packed = own.astype("<i1" if d <= 8 else "<i2" if d <= 16 else "<i4").tobytes()
        if any(md5) and d in (8, 16, 32) and hashlib.md5(packed, usedforsecurity=False).digest() != md5:
            raise Corrupt("its MD5 fails")
        out.append(Decoded(own, sizes, d))
    return out


def pad(text: bytes) -> bytes:
    """Blanks up to a positive multiple of 192."""
    return text + b" " * (max(-(-len(text) // BLOCK), 1) * BLOCK - len(text))


def encode_flac(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds a FLAC column: the bytes of ``text_col`` (text or binary) as 8-bit samples.

    Null counts as empty; the payload is padded with blanks to a multiple of 192.  The
    smallest of a constant, verbatim, fixed-order or linear-predictor subframe is
    stored for each frame.  Rows are independent; equal texts get equal bytes.
    """
    named = Named(docs, [media_col])
    text_col, columns = named.plain(text_col), named.kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [pad(t or b"") for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            for a, b in slices(raw):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in columns), pa.array(encode(raw[a:b]), pa.binary())], names=[*columns, "flac"])

    coded = named.df.mapInArrow(apply, T.StructType([*named.fields(), T.StructField("flac", T.BinaryType())]))
    return named.back(coded, F.col("flac").alias(media_col))


def decode_flac(docs: DataFrame, media_col: str = "media", block: int = BLOCK * SEEK_EVERY) -> DataFrame:
    """PCM blocks of a FLAC column: one row per ``block`` samples of a row.

    Columns: those of ``docs`` but the media, then ``block_no``, ``sample_offset``,
    ``n_samples``, ``bits`` and ``pcm`` (little-endian signed samples), so that a reader
    seeks by ``sample_offset``; ``error`` says why a stream can't be decoded, in a single
    row without samples.  A null stream gives no row.
    """
    added = ["block_no", "sample_offset", "n_samples", "bits", "pcm", "error"]
    named = Named(docs, [*added, media_col])
    media_col, columns = named.plain(media_col), named.kept

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, media in enumerate(batch.column(media_col).to_pylist()):
                if media is None:
                    continue
                rows: list[tuple] = []
                try:
                    got = decode([media])[0]
                    kind = "<i1" if got.bits <= 8 else "<i2" if got.bits <= 16 else "<i4"
                    for k in range(0, len(got.samples), block):
                        part = got.samples[k:k + block]
                        rows.append((k // block, k, len(part), got.bits, part.astype(kind).tobytes(), None))
                except Corrupt as e:
                    rows.append((0, 0, 0, None, None, str(e)))
                keys = batch.slice(i, 1).to_pydict()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[c] * len(rows), batch.schema.field(c).type) for c in columns]
                    + [pa.array([r[j] for r in rows], t) for j, t in enumerate(
                        (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.string()))],
                    names=[*columns, *added])

    schema = T.StructType(named.fields() + [T.StructField(c, t) for c, t in zip(added, (
        T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType(), T.StringType()), strict=True)])
    return named.back(named.df.mapInArrow(apply, schema), *added)


def store_and_read(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Stores each text as FLAC, reads the stored bytes back and adds what they give.

    ``n_bytes`` (without padding), ``payload_bytes``, ``payload_sha256`` and
    ``tail_crc32`` (last 16 bytes) of the payload as decoded, ``media_bytes`` and
    ``media_sha256`` of the stream, and ``feature``: samples, frames, sum, energy and
    sign changes of the decoded signal, added up over its PCM blocks.  Null text counts as
    empty; equal texts get equal values; texts are coded whole.  Columns with the names of
    added ones are replaced.

    The streams are written as a Parquet column in the shared folder and decoded by a job
    of its own that reads only this table.
    """
    added = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    named = Named(docs, added)
    text_col = named.plain(text_col)
    columns = named.kept = [c for c in named.kept if c != text_col]

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
            for a, b in slices(texts, 1 << 19):
                piece = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in columns), pa.array([len(t) for t in texts[a:b]], pa.int64()),
                     pa.array(encode([pad(t) for t in texts[a:b]]), pa.binary())], names=[*columns, "n_bytes", "flac"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_sizes(batch.column("flac")), 1 << 19):
                piece = batch.slice(a, b - a)
                media = piece.column("flac").to_pylist()
                rows = [_facts(stored, got) for stored, got in zip(media, decode(media), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in [*columns, "n_bytes"]] + [pa.array([r[j] for r in rows], t) for j, t in enumerate((
                        pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                    names=[*columns, *added])

    stored = materialize(named.df.mapInArrow(store, T.StructType([
        *named.fields(), T.StructField("n_bytes", T.LongType()), T.StructField("flac", T.BinaryType())])))
    kinds = (T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType(named.fields() + [T.StructField(c, t) for c, t in zip(added, kinds, strict=True)])
    return named.back(stored.mapInArrow(read, schema), *added)


def _facts(stored: bytes, got: Decoded, block: int = BLOCK * SEEK_EVERY) -> tuple:
    """What ``store_and_read`` tells of a stream, block after block of its PCM."""
    sha, tail, total, energy, turns, last = hashlib.sha256(), b"", 0, 0, 0, None
    for k in range(0, len(got.samples), block):
        s = got.samples[k:k + block]
        payload = (s + 128).astype(np.uint8).tobytes()
        sha.update(payload)
        tail, wide = (tail + payload[-16:])[-16:], s.astype(np.int64)
        total, energy = total + int(wide.sum()), energy + int((wide * wide).sum())
        turns += int(np.count_nonzero((s[1:] < 0) != (s[:-1] < 0))) + int(last is not None and (s[0] < 0) != (last < 0))
        last = s[-1]
    return (len(got.samples), sha.hexdigest(), zlib.crc32(tail), len(stored), hashlib.sha256(stored).hexdigest(),
            f"{len(got.samples)}:{len(got.sizes)}:{total}:{energy}:{turns}")
