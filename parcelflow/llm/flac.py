"""FLAC for media columns: mono 8-bit streams, many at a time.

Decoding works on all frames of a batch in step: sample i of every frame is taken from its bit stream
before sample i + 1 of any, so a Rice code is read by a few array operations whatever the number of
frames, and linear predictors run the same way.  Header CRC-8, frame CRC-16 and the stream's MD5 are
verified.  Frame positions come from the seek table; a stream without one is walked frame by frame.
The encoder picks, for each frame, the shortest of a constant, plain samples, fixed predictors of order
0 to 4 and a fitted linear predictor.  PCM is kept in blocks behind a table of sample offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import byte_view, slices
from .storage import small_batches

BLOCK = 1024
LPC_ORDER, LPC_BITS = 4, 9
RATE = 8000
#: Payload bytes that go through the coder at once in one Python worker; also the size of PCM blocks.
BATCH_BYTES, PCM_BLOCK = 3 << 20, 4096
#: Fixed predictors' weights of the samples before, nearest first.
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _crc_table(poly: int, bits: int) -> np.ndarray:
    value = np.arange(256, dtype=np.int64) << (bits - 8)
    for _ in range(8):
        value = np.where(value >> (bits - 1) & 1, (value << 1) ^ poly, value << 1) & ((1 << bits) - 1)
    return value


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """CRC of many stretches of bytes, in step."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    value = np.zeros(len(order), np.int64)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), side="left")  # stretches longer than i
    for i, m in enumerate(active.tolist()):
        v = value[:m]
        value[:m] = table[(v >> (bits - 8)) ^ data[at[:m] + i]] ^ ((v << 8) & ((1 << bits) - 1))
    out = np.empty_like(value)
    out[order] = value
    return out


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write values of ``width`` bits, most significant first, into an array of single bits."""
    if isinstance(width, int):
        for j in range(width):
            bits[at + j] = (value >> (width - 1 - j)) & 1
        return
    for j in range(int(width.max(initial=0))):
        if not (m := width > j).all():
            at, value, width = at[m], value[m], width[m]
        bits[at + j] = (value >> (width - 1 - j)) & 1


def _lpc(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(integer weights [frames, order], shift) of a linear predictor for each row; exact sums, so equal rows give equal weights."""
    lags = [np.einsum("ij,ij->i", x[:, : x.shape[1] - k], x[:, k:], dtype=np.int64).astype(float) for k in range(LPC_ORDER + 1)]
    error, a = np.maximum(lags[0], 1.0) * (1 + 1e-9), np.zeros((len(x), LPC_ORDER))
    for i in range(LPC_ORDER):
        acc = lags[i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * lags[i - j]
        k = np.clip(acc / error, -0.999, 0.999)
        old = a[:, :i].copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] -= k * old[:, i - 1 - j]
        error = np.maximum(error * (1 - k * k), 1.0)
    _, top = np.frexp(np.abs(a).max(axis=1))
    shift = np.clip(LPC_BITS - 1 - np.maximum(top, 0), 0, 15).astype(np.int64)
    weights = np.clip(np.round(a * (1 << shift)[:, None]), -(1 << (LPC_BITS - 1)), (1 << (LPC_BITS - 1)) - 1).astype(np.int32)
    return weights, shift


def _frames(x: np.ndarray, n: np.ndarray, number: np.ndarray, partition_order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all frames, byte offset of each) for rows of samples, of which the first n[i] count."""
    count, width = x.shape
    valid = np.arange(width) < n[:, None]
    x = np.where(valid, x, 0).astype(np.int32)

    def estimate(u: np.ndarray, order: int) -> np.ndarray:
        total, m = u.sum(axis=1, dtype=np.int64), n - order
        return np.min([m * (k + 1) + (total >> k) for k in range(15)], axis=0) + 8 * order + 18

    best, kind, kept = 8 * n, np.full(count, -1), np.zeros_like(x)
    r = x
    for order in range(5):
        if order:
            r = np.diff(r, axis=1, prepend=0)
        u = np.where(valid, _zigzag(r), 0)
        u[:, :order] = 0
        cost = estimate(u, order)
        better = (cost < best) & (n > order)
        best, kind = np.where(better, cost, best), np.where(better, order, kind)
        kept[better] = u[better]
    weights, shift = _lpc(x, n)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[:, j + 1 :] += weights[:, j, None] * x[:, : width - j - 1]
    u = np.where(valid, _zigzag(x - (guess >> shift.astype(np.int32)[:, None])), 0)
    u[:, :LPC_ORDER] = 0
    cost = estimate(u, LPC_ORDER) + 9 + LPC_ORDER * LPC_BITS
    better = (cost < best) & (n > LPC_ORDER)
    best, kind = np.where(better, cost, best), np.where(better, 5, kind)
    kept[better] = u[better]
    kind = np.where((x == x[:, :1]).all(axis=1, where=valid), -2, kind)

    order = np.where(kind == 5, LPC_ORDER, np.maximum(kind, 0))
    rice = kind >= 0
    # Partitions: the samples of a frame in equal parts, each with its own Rice parameter.
    po = np.where((n % (1 << partition_order) == 0) & (n >> partition_order > order), partition_order, 0)
    size = n >> po
    param = np.zeros((count, 1 << partition_order), np.int64)
    part_of = np.minimum(np.arange(width)[None, :] // np.maximum(size, 1)[:, None], (1 << partition_order) - 1)
    for p in range(1 << partition_order):
        inside = kept if partition_order == 0 else np.where(part_of == p, kept, 0)
        m = np.maximum(size - np.where(p == 0, order, 0), 1)
        total = inside.sum(axis=1, dtype=np.int64)
        param[:, p] = np.argmin([m * (k + 1) + (total >> k) for k in range(14)], axis=0)
    k = np.take_along_axis(param, part_of, axis=1).astype(np.int32)
    quotient = np.where(valid, kept >> k, 0)
    coded = valid & rice[:, None] & (np.arange(width) >= order[:, None])
    begins = coded & ((np.arange(width) == order[:, None]) | (np.arange(width) % np.maximum(size, 1)[:, None] == 0))
    code_bits = np.where(coded, quotient + 1 + k, 0) + 4 * begins

    numbers = np.where(number < 0x80, 1, np.where(number < 0x800, 2, np.where(number < 0x10000, 3, np.where(number < 0x200000, 4, 5))))
    head = 4 + numbers + 2 + 1
    fixed_bits = 8 + np.select([kind == -2, kind == -1], [8, 8 * n], 8 * order + 6 + np.where(kind == 5, 9 + LPC_ORDER * LPC_BITS, 0))
    body = (fixed_bits + code_bits.sum(axis=1) + 7) >> 3
    total = head + body + 2
    starts = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()) * 8, np.uint8)

    at = starts * 8
    _put(bits, at, np.full(count, 0xFFF8), 16)
    _put(bits, at + 16, np.full(count, 0x70), 8)  # block size in 16 bits, rate of the stream
    _put(bits, at + 24, np.full(count, 0x02), 8)  # mono, 8 bits
    for w in range(1, 6):
        if len(i := np.flatnonzero(numbers == w)):
            v = number[i]
            lead = v if w == 1 else ((0xFF << (8 - w)) & 0xFF) | (v >> (6 * (w - 1)))
            _put(bits, at[i] + 32, lead, 8)
            for j in range(1, w):
                _put(bits, at[i] + 32 + 8 * j, 0x80 | ((v >> (6 * (w - 1 - j))) & 0x3F), 8)
    _put(bits, at + 32 + 8 * numbers, n - 1, 16)
    at = (starts + head) * 8
    _put(bits, at, np.select([kind == -2, kind == -1, kind == 5], [0, 2, (32 + LPC_ORDER - 1) << 1], (8 + kind) << 1), 8)
    at = at + 8
    i = np.flatnonzero(kind == -2)
    _put(bits, at[i], x[i, 0] & 0xFF, 8)
    for i in np.flatnonzero(kind == -1):
        _put(bits, at[i] + 8 * np.arange(n[i]), x[i, : n[i]] & 0xFF, 8)
    for j in range(int(order.max(initial=0))):
        i = np.flatnonzero(rice & (order > j))
        _put(bits, at[i] + 8 * j, x[i, j] & 0xFF, 8)
    at = at + 8 * order
    if len(i := np.flatnonzero(kind == 5)):
        _put(bits, at[i], np.full(len(i), LPC_BITS - 1), 4)
        _put(bits, at[i] + 4, shift[i], 5)
        for j in range(LPC_ORDER):
            _put(bits, at[i] + 9 + LPC_BITS * j, weights[i, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
        at[i] += 9 + LPC_ORDER * LPC_BITS
    i = np.flatnonzero(rice)
    _put(bits, at[i] + 2, po[i], 4)  # method 0 before it
    at = at + 6
    # Rice codes: zeros, a stop bit and the low bits; a partition's parameter stands before its first code.
    first = at[:, None] + np.cumsum(code_bits, axis=1) - code_bits
    rows = np.flatnonzero(begins)
    _put(bits, first.ravel()[rows], k.ravel()[rows], 4)
    rows = np.flatnonzero(coded)
    q, kk = quotient.ravel()[rows], k.ravel()[rows]
    where = first.ravel()[rows] + 4 * begins.ravel()[rows] + q
    low = (kept.ravel()[rows] & ((1 << kk) - 1)) | (1 << kk)
    _put(bits, where, low, kk + 1)
    data = np.packbits(bits)
    data[starts + head - 1] = crc(data, starts, head - 1, CRC8, 8)
    check = crc(data, starts, head + body, CRC16, 16)
    data[starts + head + body], data[starts + head + body + 1] = check >> 8, check & 0xFF
    return data, np.append(starts, int(total.sum()))


def encode(payload: np.ndarray, offsets: np.ndarray, block: int = BLOCK, partition_order: int = 0) -> list[bytes]:
    """One FLAC stream for each stretch of bytes; byte b is sample b - 128.  A stretch must not be empty."""
    lengths = np.diff(offsets)
    frames = -(-lengths // block)
    of = np.repeat(np.arange(len(lengths)), frames)
    number = np.arange(len(of)) - np.repeat(np.cumsum(frames) - frames, frames)
    begin = offsets[of] + number * block
    n = np.minimum(block, offsets[of + 1] - begin)
    signed = payload.astype(np.int16) - 128
    at = np.minimum(begin[:, None] + np.arange(block), max(0, len(payload) - 1))
    data, starts = _frames(signed[at] if len(of) else np.zeros((0, block), np.int16), n, number, partition_order)
    blob, out = data.tobytes(), []
    raw = (payload ^ 0x80).tobytes()
    last = 0
    for i, count in enumerate(frames.tolist()):
        here = starts[last : last + count + 1]
        sizes = np.diff(here)
        info = struct.pack(">HH", block, block) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (7 << 36) | int(lengths[i])).to_bytes(8, "big") + hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest()
        points = np.zeros(count, np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]))
        points["sample"], points["at"], points["n"] = number[last : last + count] * block, here[:-1] - here[0], n[last : last + count]
        out.append(b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + (18 * count).to_bytes(3, "big") + points.tobytes() + blob[here[0] : here[-1]])
        last += count
    return out


class _Bits:
    """Reads bits at many places of one byte array."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        n = len(data) + 8
        self.words = np.zeros(n, np.uint64)
        for j in range(8):
            self.words |= padded[j : j + n].astype(np.uint64) << np.uint64(56 - 8 * j)
        self.zeros = np.full(1 << 16, 16, np.int64)  # zeros before the first one among 16 bits
        for z in range(15, -1, -1):
            self.zeros[1 << (15 - z) : 1 << (16 - z)] = z
        self.end = len(data) * 8

    def window(self, at: np.ndarray) -> np.ndarray:
        """The next 57 bits at least, from the top of a 64-bit word."""
        if len(at) and int(at.max()) > self.end:
            raise ValueError("a frame runs over the end of its stream")
        return self.words[at >> 3] << (at & 7).astype(np.uint64)

    def take(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        value = (self.window(at) >> np.uint64(1)) >> (63 - width).astype(np.uint64)
        return np.where(width > 0, value.astype(np.int64), 0)

    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(residuals, bits after them) of one Rice code at each place."""
        w = self.window(at)
        q = self.zeros[(w >> np.uint64(48)).astype(np.int64)]
        far = np.flatnonzero(q == 16)
        if len(far):
            here = at[far] + 16
            while len(far):
                z = self.zeros[(self.window(here) >> np.uint64(48)).astype(np.int64)]
                q[far] += z
                far, here = far[z == 16], here[z == 16] + 16
            low = self.take(at + q + 1, k)
        else:
            low = ((w << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - k).astype(np.uint64)).astype(np.int64)
        u = (q << k) | low
        return (u >> 1) ^ -(u & 1), at + q + 1 + k


def _signed(value: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    half = 1 << (np.asarray(width) - 1)
    return (value ^ half) - half


def decode_frames(data: np.ndarray, starts: np.ndarray, bits: _Bits | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples [frames, most], number of samples, frame number, byte after the frame) of frames that begin at ``starts``."""
    bits, count = bits or _Bits(data), len(starts)
    at = starts * 8
    head = bits.take(at, 32)
    if ((head >> 16) != 0xFFF8).any() or ((head & 0xFE) != 0x02).any() or ((head >> 8) & 0x0F).any():
        raise ValueError("no frame header of a mono 8-bit stream with fixed blocks")
    code = (head >> 12) & 0x0F
    lead = bits.take(at + 32, 8)
    width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8], [1, 2, 3, 4], 5)
    number = np.where(width == 1, lead, lead & (0x7F >> width))
    for j in range(1, int(width.max(initial=1))):
        number = np.where(width > j, (number << 6) | (bits.take(at + 32 + 8 * j, 8) & 0x3F), number)
    at = at + 32 + 8 * width
    extra = np.select([code == 6, code == 7], [8, 16], 0)
    stated = bits.take(at, extra) + 1
    n = np.select([code >= 8, code == 1, (code >= 2) & (code <= 5)], [256 << np.maximum(code - 8, 0), 192, 576 << np.maximum(code - 2, 0)], stated)
    at = at + extra
    if (crc(data, starts, (at >> 3) - starts, CRC8, 8) != bits.take(at, 8)).any():
        raise ValueError("a frame header's CRC-8 doesn't hold")
    kind = bits.take(at + 8, 8) >> 1
    if (bits.take(at + 8, 8) & 0x81).any():
        raise ValueError("wasted bits aren't used in 8-bit streams")
    at = at + 16
    lpc, fixed = kind >= 32, (kind >= 8) & (kind <= 12)
    if (~(lpc | fixed | (kind <= 1))).any():
        raise ValueError("unknown kind of subframe")
    order = np.select([lpc, fixed], [kind - 31, kind - 8], 0)

    most = int(n.max(initial=0))
    x = np.zeros((most, count), np.int64)  # sample by sample, so that a step is one row
    i = np.flatnonzero(kind == 0)
    x[:, i] = _signed(bits.take(at[i], 8), 8)
    at[i] += 8
    for i in np.flatnonzero(kind == 1):
        raw = at[i] + 8 * np.arange(n[i])
        x[: n[i], i] = _signed(bits.take(raw, 8), 8)
        at[i] += 8 * n[i]
    for j in range(int(order.max(initial=0))):
        i = np.flatnonzero(order > j)
        x[j, i] = _signed(bits.take(at[i], 8), 8)
        at[i] += 8
    weights, shift = np.zeros((32, count), np.int64), np.zeros(count, np.int64)
    if len(i := np.flatnonzero(lpc)):
        precision = bits.take(at[i], 4) + 1
        shift[i] = bits.take(at[i] + 4, 5)
        at[i] += 9
        for j in range(int(order[i].max())):
            has = order[i] > j
            weights[j, i[has]] = _signed(bits.take(at[i[has]], precision[has]), precision[has])
            at[i[has]] += precision[has]
    for o in range(1, 5):
        weights[:o, np.flatnonzero(fixed & (order == o))] = np.array(FIXED[o])[:, None]

    rice = np.flatnonzero(lpc | fixed)
    if len(rice):
        rice = rice[np.argsort(-n[rice], kind="stable")]
        method, po = bits.take(at[rice], 2), bits.take(at[rice] + 2, 4)
        if (method > 1).any():
            raise ValueError("unknown residual coding")
        size = n[rice] >> po
        place, wide = at[rice] + 6, 4 + method
        k, raw = np.zeros(len(rice), np.int64), np.full(len(rice), -1)
        o, m_all, turn = order[rice], n[rice], order[rice].copy()  # turn: sample before which the next parameter stands
        turns = set(turn.tolist()).union(*(range(s, m, s) for s, m in set(zip(size.tolist(), m_all.tolist()))))
        low = int(o.min())
        same = low == int(o.max())
        active = np.searchsorted(-m_all, -np.arange(most), side="left")  # frames with more than s samples
        plain = True
        for s in range(low, most):
            m = int(active[s])
            if s in turns and (new := np.flatnonzero(turn[:m] == s)).size:
                k[new] = bits.take(place[new], wide[new])
                place[new] += wide[new]
                escaped = k[new] == (1 << wide[new]) - 1
                raw[new] = -1
                if escaped.any():
                    e = new[escaped]
                    raw[e] = bits.take(place[e], 5)
                    place[e] += 5
                plain = not (raw >= 0).any()
                turn[new] = (s // size[new] + 1) * size[new]
            if same and plain:
                x[s, rice[:m]], place[:m] = bits.rice(place[:m], k[:m])
                continue
            i = np.flatnonzero((o[:m] <= s) & (raw[:m] < 0))
            x[s, rice[i]], place[i] = bits.rice(place[i], k[i])
            if len(i := np.flatnonzero((o[:m] <= s) & (raw[:m] >= 0))):
                value = bits.take(place[i], raw[i])
                x[s, rice[i]] = np.where(raw[i] > 0, _signed(value, np.maximum(raw[i], 1)), 0)
                place[i] += raw[i]
        at[rice] = place
        # Predictors, in step within each order.
        for o in np.unique(order[rice]).tolist():
            if o:
                i = np.flatnonzero((order == o) & (lpc | fixed))
                part, w, sh = x[:, i], weights[:o, i], shift[i]
                for s in range(o, most):
                    guess = w[0] * part[s - 1]
                    for j in range(1, o):
                        guess += w[j] * part[s - 1 - j]
                    part[s] += guess >> sh
                x[:, i] = part
    end = (at + 7) >> 3
    if (crc(data, starts, end - starts, CRC16, 16) != bits.take(end * 8, 16)).any():
        raise ValueError("a frame's CRC-16 doesn't hold")
    return x.T, n, number, end + 2


def decode(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all streams, offsets of each, frames of each); every checksum is verified."""
    if not streams:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(streams), np.uint8)
    bits, base = _Bits(data), 0
    totals, digests, begin, ends, tables = [], [], [], [], []
    for s in streams:
        if s[:4] != b"fLaC":
            raise ValueError("no FLAC stream")
        at, last, points = 4, False, None
        while not last:
            kind, size = s[at], int.from_bytes(s[at + 1 : at + 4], "big")
            last, kind, block = bool(kind & 0x80), kind & 0x7F, s[at + 4 : at + 4 + size]
            if kind == 0:
                packed = int.from_bytes(block[10:18], "big")
                if (packed >> 36) & 0x1F != 7 or (packed >> 41) & 7:
                    raise ValueError("only mono 8-bit streams are read")
                totals.append(packed & ((1 << 36) - 1))
                digests.append(block[18:34])
            elif kind == 3:
                points = np.frombuffer(block, np.dtype([("sample", ">u8"), ("at", ">u8"), ("n", ">u2")]))
            at += 4 + size
        begin.append(base + at)
        base += len(s)
        ends.append(base)
        whole = points is not None and len(points) and int(points["n"].sum()) == totals[-1]
        tables.append(points["at"].astype(np.int64) + begin[-1] if whole else np.array([begin[-1]]))
    counts = np.array([len(t) for t in tables])
    of, starts = np.repeat(np.arange(len(streams)), counts), np.concatenate(tables) if tables else np.zeros(0, np.int64)
    ends, rounds = np.array(ends), []
    while len(starts):  # one round, unless a stream lacks a whole seek table
        x, n, number, after = decode_frames(data, starts, bits)
        rounds.append((of, number, x, n))
        final = np.append(of[1:] != of[:-1], True)
        left = np.flatnonzero(final & (after < ends[of]))
        joined = np.flatnonzero(~final)
        if (after[joined] != starts[joined + 1]).any():
            raise ValueError("the seek table misses a frame")
        of, starts = of[left], after[left]
    lengths = np.array(totals, np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    out, frames, filled = np.zeros(int(offsets[-1]), np.uint8), np.zeros(len(streams), np.int64), np.zeros(len(streams), np.int64)
    for of, number, x, n in rounds:
        if (number != frames[of] + np.arange(len(of)) - np.searchsorted(of, of)).any():
            raise ValueError("frames are out of order")
        before = np.cumsum(n) - n
        at = offsets[of] + filled[of] + before - before[np.searchsorted(of, of)]
        if (at + n > offsets[of + 1]).any():
            raise ValueError("more samples than the stream states")
        valid = np.arange(x.shape[1]) < n[:, None]
        out[(at[:, None] + np.arange(x.shape[1]))[valid]] = (x[valid] + 128).astype(np.uint8)
        filled += np.bincount(of, n, len(streams)).astype(np.int64)
        frames += np.bincount(of, minlength=len(streams))
    if (filled != lengths).any():
        raise ValueError("fewer samples than the stream states")
    raw = (out ^ 0x80).tobytes()
    for i, digest in enumerate(digests):
        if digest != bytes(16) and hashlib.md5(raw[offsets[i] : offsets[i + 1]]).digest() != digest:
            raise ValueError("a stream's MD5 doesn't hold")
    return out, offsets, frames


def pcm_blocks(pcm: bytes, block: int = PCM_BLOCK) -> bytes:
    """PCM behind a table: magic, block count u32, samples u64, then (first sample u64, byte offset u64) of each block."""
    firsts = range(0, len(pcm), block)
    head = 16 + 16 * len(firsts)
    return b"PCMB" + struct.pack("<IQ", len(firsts), len(pcm)) + b"".join(struct.pack("<QQ", f, head + f) for f in firsts) + pcm


def read_samples(blocks: bytes, first: int, n: int) -> bytes:
    """Samples first .. first + n of what pcm_blocks wrote, by its table."""
    count, total = struct.unpack_from("<IQ", blocks, 4)
    table = np.frombuffer(blocks, np.dtype([("sample", "<u8"), ("at", "<u8")]), count, 16)
    if not count or first >= total:
        return b""
    i = int(np.searchsorted(table["sample"], first, side="right")) - 1
    at = int(table["at"][i]) + first - int(table["sample"][i])
    return blocks[at : at + min(n, total - first)]


def read_blocks(blocks: bytes) -> bytes:
    """All samples of what pcm_blocks wrote, block by block by its table."""
    count, total = struct.unpack_from("<IQ", blocks, 4)
    table = np.frombuffer(blocks, np.dtype([("sample", "<u8"), ("at", "<u8")]), count, 16)
    firsts, at = table["sample"].tolist(), table["at"].tolist()
    return b"".join(blocks[i : i + end - first] for i, first, end in zip(at, firsts, [*firsts[1:], total]))


def pad(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(payloads, offsets): the UTF-8 bytes of each text and zeros up to a positive multiple of 64."""
    data, at = byte_view(texts)
    sizes = np.diff(at)
    padded = np.maximum(64, (sizes + 63) // 64 * 64)
    offsets = np.concatenate([[0], np.cumsum(padded)])
    out = np.zeros(int(offsets[-1]), np.uint8)
    out[np.arange(len(data)) + np.repeat(offsets[:-1] - at[:-1], sizes)] = data
    return out, offsets


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes and media, the FLAC stream of the padded text; a null text counts as empty."""
    small_batches(docs.sparkSession, 2 * BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            media = encode(*pad(part.column(1)))
            yield pa.record_batch([part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per input row: doc_id and pcm, the samples in blocks (see pcm_blocks); null media gives null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            streams = part.column(1).to_pylist()
            out, offsets, _ = decode([s for s in streams if s])
            raw, where = out.tobytes(), iter(zip(offsets.tolist(), offsets[1:].tolist()))
            pcm = [pcm_blocks(raw[slice(*next(where))]) if s else None for s in streams]
            yield pa.record_batch([part.column(0), pa.array(pcm, pa.binary())], names=["doc_id", "pcm"])

    return media.select(media[id_col].cast("bigint").alias("doc_id"), media[media_col].alias("media")).mapInArrow(run, "doc_id bigint, pcm binary")


def text_media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each padded text, decode the stream into PCM blocks and describe both; one row per input row.

    payload_* and tail_crc32 (last 64 bytes) are of the samples read back from the blocks by their table,
    media_* of the stream; feature is frames:sum:energy:sign changes of the samples read back.  Nothing of a row depends on other rows, so equal texts
    give equal values.  A null text counts as empty (64 zero bytes); null ids and repeated rows are kept;
    other columns are not read.  No shuffle; a worker holds BATCH_BYTES of payload, or one document.
    """
    small_batches(docs.sparkSession, 2 * BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BATCH_BYTES):
            media = encode(*pad(part.column(1)))
            out, offsets, frames = decode(media)
            decoded, ends = memoryview(out), offsets.tolist()
            stored = [pcm_blocks(decoded[a:b]) for a, b in zip(ends, ends[1:])]
            del out, decoded
            payloads = [read_blocks(s) for s in stored]
            raw, offsets = b"".join(payloads), np.cumsum([0, *map(len, payloads)])
            x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
            total, energy = (np.concatenate([[0], np.cumsum(v)]) for v in (x, x * x))
            turns = np.concatenate([[0], np.cumsum(np.append(False, (x[1:] < 0) != (x[:-1] < 0)))])
            ends = offsets.tolist()
            spans = list(zip(ends, ends[1:]))
            feature = [f"{f}:{total[b] - total[a]}:{energy[b] - energy[a]}:{turns[b] - turns[a + 1]}" for f, (a, b) in zip(frames.tolist(), spans)]
            yield pa.record_batch(
                [
                    part.column(0), pc.binary_length(part.column(1)).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array([zlib.crc32(read_samples(s, len(p) - 64, 64)) for s, p in zip(stored, payloads)], pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(feature),
                ],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
