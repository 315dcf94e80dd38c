"""FLAC streams, text statistics and trees against plain, independent ways to compute the same."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.llm import flac, quality


class Bits:
    """Reads a byte string bit by bit, as the published format writes it."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        value = 0
        for _ in range(n):
            value = value << 1 | self.data[self.at >> 3] >> (7 - self.at % 8) & 1
            self.at += 1
        return value

    def signed(self, n):
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value

    def ones_end(self):
        n = 0
        while not self.take(1):
            n += 1
        return n


def crc(data, poly, width):
    value = 0
    for byte in data:
        value ^= byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ poly if value >> (width - 1) else value << 1) & (1 << width) - 1
    return value


def scalar_flac(stream):
    """(samples of a mono stream as bytes with offset 128, frames): one sample after the other."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = Bits(stream[at + 4 : at + 4 + size])
            info.take(16 + 16 + 24 + 24 + 20)
            channels, depth, total = info.take(3) + 1, info.take(5) + 1, info.take(36)
        at += 4 + size
    assert channels == 1 and depth == 8
    out, frames = [], 0
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.take(14) == 0b11111111111110 and b.take(1) == 0
        b.take(1)
        block, rate, _, bits, _ = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
        first = b.take(8)
        for _ in range(0 if first < 128 else 7 - (first ^ 255).bit_length()):
            b.take(8)
        n = 192 if block == 1 else 576 << block - 2 if block < 6 else 256 << block - 8 if block > 7 else b.take(8) + 1 if block == 6 else b.take(16) + 1
        b.take({12: 8, 13: 16, 14: 16}.get(rate, 0))
        head = b.at // 8
        assert crc(stream[at : at + head], 0x07, 8) == b.take(8) and bits in (0, 1)
        assert b.take(1) == 0
        kind, wasted = b.take(6), b.take(1)
        shift = b.ones_end() + 1 if wasted else 0
        width = depth - shift
        if kind == 0:
            x = [b.signed(width)] * n
        elif kind == 1:
            x = [b.signed(width) for _ in range(n)]
        else:
            order = kind - 8 if kind < 16 else kind - 31
            x = [b.signed(width) for _ in range(order)]
            if kind >= 32:
                precision, move = b.take(4) + 1, b.signed(5)
                weights = [b.signed(precision) for _ in range(order)]
            else:
                weights, move = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order], 0
            wide, parts = b.take(2), b.take(4)
            for part in range(1 << parts):
                many = (n >> parts) - (order if part == 0 else 0)
                rice = b.take(5 if wide else 4)
                raw = b.take(5) if rice == (31 if wide else 15) else None
                for _ in range(many):
                    if raw is None:
                        u = b.ones_end() << rice | b.take(rice)
                        e = u >> 1 ^ -(u & 1)
                    else:
                        e = b.signed(raw)
                    x.append(e + (sum(w * v for w, v in zip(weights, reversed(x[-order:]))) >> move if order else 0))
        out += [v << shift for v in x]
        end = -(-b.at // 8)
        assert crc(stream[at : at + end], 0x8005, 16) == int.from_bytes(stream[at + end : at + end + 2], "big")
        at, frames = at + end + 2, frames + 1
    assert len(out) == total
    return bytes(v + 128 for v in out), frames


@pytest.mark.parametrize("seed", range(6))
def test_streams_are_read_by_a_scalar_decoder(seed):
    rng = random.Random(seed)
    kinds = [b"", b"a", b"\0" * 700, bytes(rng.choices(range(256), k=900)), b"the cat and the dog " * 60, bytes(int(128 + 100 * math.sin(i / 9)) for i in range(5000)), "é und ü ".encode() * 200, bytes(rng.choices(b"ab", k=4500))]
    texts = pa.array([k + bytes(rng.choices(b"xyz ", k=rng.randint(0, 300))) for k in kinds], pa.binary())
    payloads, offsets = flac.pad(texts)
    for stream, a, b in zip(flac.encode(payloads, offsets), offsets[:-1].tolist(), offsets[1:].tolist()):
        assert scalar_flac(stream)[0] == payloads[a:b].tobytes()


def test_media_columns_are_those_of_a_scalar_decoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").limit(12)
    texts = {r.doc_id: r.text for r in docs.collect()}
    media = {r.doc_id: bytes(r.media) for r in flac.encode_texts(docs).collect()}
    for r in flac.text_media_features(docs).collect():
        raw, frames = scalar_flac(media[r.doc_id])
        plain = texts[r.doc_id].encode()
        assert raw == plain + bytes(max(64, -(-len(plain) // 64) * 64) - len(plain)) and zlib.crc32(raw[-64:]) == r.tail_crc32
        x = [v - 128 for v in raw]
        turns = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
        assert r.feature == f"{frames}:{sum(x)}:{sum(v * v for v in x)}:{turns}"


def plain_features(text):
    raw = text.encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    share = lambda members: sum(c in members for c in raw) / len(raw)
    words, lines = text.replace("\n", " ").split(" "), text.split("\n")
    row = [math.log1p(len(raw)), *(share(m) for m in quality._CLASSES.values()), sum(c >= 128 for c in raw) / len(raw)]
    row += [sum(len(w.encode()) for w in words) / len(words), len(set(words)) / len(words), sum(bool(re.search(r"[!#$%&*|^~]$", w)) for w in words) / len(words)]
    row += [len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), sum(w[:1].isupper() for w in words) / len(words), math.log1p(max(len(w.encode()) for w in words))]
    return row


def test_statistics_are_those_of_a_plain_loop(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + ["", " ", "\n", "Été ÉTÉ!\nété  |", "a b\na b\n\nC#"]
    got = quality.features(pa.array(texts))
    assert np.allclose(got, np.array([plain_features(t) for t in texts]), atol=1e-12)


def plain_trees(x, y, rounds, depth, bins, rate, least, ridge):
    """Scores of the rows after boosting with exhaustive search over the same bins, one split after the other."""
    p = (sum(y) + 1) / (len(y) + 2)
    total = [math.log(p / (1 - p))] * len(y)
    edges = [sorted(set(np.quantile([r[f] for r in x], np.arange(1, bins) / bins).tolist())) for f in range(len(x[0]))]
    for _ in range(rounds):
        prob = [1 / (1 + math.exp(-t)) for t in total]
        g, h = [a - b for a, b in zip(y, prob)], [b * (1 - b) for b in prob]
        leaves = [list(range(len(y)))]
        done = []
        for _ in range(depth):
            below = []
            for rows in leaves:
                best = (1e-9, None)
                sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for f in range(len(x[0])):
                    for cut in edges[f]:
                        left = [i for i in rows if x[i][f] <= cut]
                        if len(left) < least or len(rows) - len(left) < least:
                            continue
                        lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = lg**2 / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg**2 / (sh + ridge)
                        if gain > best[0] + 1e-12:
                            best = (gain, (f, cut))
                if best[1] is None:
                    done.append(rows)
                else:
                    f, cut = best[1]
                    below += [[i for i in rows if x[i][f] <= cut], [i for i in rows if x[i][f] > cut]]
            leaves = below
        for rows in done + leaves:
            value = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                total[i] += value
    return [1 / (1 + math.exp(-t)) for t in total]


def test_trees_grow_as_by_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 3)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] + rng.normal(size=160) * 0.4 > 0)).astype(float)
    for name, value in {"ROUNDS": 4, "DEPTH": 3, "BINS": 8, "LEAST": 10.0}.items():
        monkeypatch.setattr(quality, name, value)
    got = quality.fit(x, y).score(x)
    assert np.allclose(got, plain_trees(x.tolist(), y.tolist(), 4, 3, 8, quality.RATE, 10.0, quality.RIDGE), atol=1e-9)
