"""Removal of byte strings that an earlier document has, by suffix arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller doc_id.
Every such string holds at least one *anchor*: a position whose GRAM-byte hash is the least of a stretch
of LENGTH - GRAM + 1 (a minimizer), so equal strings have equal anchors at equal places.

1. Each task hashes its documents and sends anchors, in packed blocks, to the partition of their hash.
   Of an anchor that two documents of a block share, one is sent and the rest are known to be shared.
2. Those partitions tell which anchors more than one document has.
3. Documents cut out the strings around shared anchors (*segments*) and send each distinct one, with
   the least doc_id of the block, to the bucket of its anchor; in a block's other documents the whole
   segment is known to be a repeat.
4. A bucket sorts the suffixes of its distinct segments in two stages: those smaller than their
   successor directly, the rest induced by one scan over the buckets of first bytes.  Stretches of
   neighbours whose common prefix reaches LENGTH are equal strings; the least doc_id of a stretch
   decides.
5. The marked strings go back to their documents, which remove them.

A block is a few MB of text, so neither step holds more of a hot passage than one entry per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_view, ragged_take, slices
from .storage import partitions, small_batches

LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Text bytes of a part, about: what a task holds of documents at once.  Parts follow the input.
PART_BYTES = 6 << 20
#: Text bytes whose anchors are gathered before they are sent, and bytes hashed at once.
BLOCK_BYTES, STEP = 16 << 20, 1 << 20
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
_BLOB = "at int, blob binary"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of the GRAM bytes from each position (by doubling)."""
    h, base, width, parts = data.astype(np.uint64) + np.uint64(1), 0x9E3779B97F4A7C15, 1, {}
    want, mask = GRAM, (1 << 64) - 1
    power = base
    while width <= want:
        parts[width] = (h, power)
        if width * 2 > want:
            break
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = width * 2, power * power & mask
    h, done = parts[width][0], width
    for w in sorted((w for w in parts if w != width and (want - width) & w), reverse=True):
        p, f = parts[w]
        n = len(data) - done - w + 1
        h, done = h[:n] * np.uint64(f) + p[done : done + n], done + w
    h = h[: len(data) - want + 1]
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def _slide(h: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each stretch of ``width``."""
    done, out = 1, h
    while done * 2 <= width:
        out, done = f(out[:-done], out[done:]), done * 2
    return f(out[: len(h) - width + 1], out[width - done :]) if done < width else out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all anchors of texts that lie side by side; ties count."""
    found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    # Strings over the border of two texts must not count: windows there get no say.
    border = np.zeros(len(data) + 1, bool)
    for cut in offsets[1:-1].tolist():
        border[max(0, cut - LENGTH + 1) : cut] = True
    for begin in range(0, len(data) - LENGTH + 1, STEP):
        piece = data[begin : begin + STEP + LENGTH - 1]
        h = gram_hashes(piece)
        least = _slide(h, WINDOW, np.minimum)
        least[border[begin : begin + len(least)]] = 0
        padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
        at = np.flatnonzero((_slide(padded, WINDOW, np.maximum)[: len(h)] == h) & (h > 0))
        found[0].append(at + begin)
        found[1].append(h[at])
    at, first = np.unique(np.concatenate(found[0]), return_index=True)
    return at, np.concatenate(found[1])[first]


def _pack(**arrays: np.ndarray) -> bytes:
    """Named arrays in one compressed blob: a line of names, kinds and lengths, then the bytes."""
    head = ",".join(f"{k}:{a.dtype.str}:{len(a)}" for k, a in arrays.items()).encode() + b"\n"
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays.values()))


def _unpack(blob: bytes) -> dict[str, np.ndarray]:
    head, _, raw = zstandard.ZstdDecompressor().decompress(blob).partition(b"\n")
    out, at = {}, 0
    for name, kind, n in (x.split(":") for x in head.decode().split(",")):
        out[name] = np.frombuffer(raw, kind, int(n), at)
        at += out[name].nbytes
    return out


def _cuts(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(order, borders) of equal keys."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    return order, [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)] if len(k) else [0]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["at", "blob"])


def _table(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def row_keys(doc_ids: np.ndarray, texts: pa.Array) -> np.ndarray:
    """A key of each (doc_id, text): rows that share an id but not the text stay apart."""
    data, offsets = byte_view(texts)
    return np.array([xxhash.xxh3_64_intdigest(data[a:b], seed=i & ((1 << 64) - 1)) for i, a, b in zip(doc_ids.tolist(), offsets.tolist(), offsets[1:].tolist())], np.uint64)


def _per_part(keys: np.ndarray, parts: int, **arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """Blobs of rows, by the part of their document."""
    at = (keys % np.uint64(parts)).astype(np.int64)
    order, edges = _cuts(at)
    return [(int(at[order[a]]), _pack(key=keys[order[a:b]], **{k: v[order[a:b]] for k, v in arrays.items()})) for a, b in zip(edges, edges[1:])]


def _anchors_of(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(hash, doc_id, position, row key) of the anchors of a slice; a row met before, id and text, has none."""
    data, offsets = byte_view(part.column(1))
    doc_ids = part.column(0).to_numpy()
    at, h = anchors(data, offsets)
    doc = np.searchsorted(offsets, at, side="right") - 1
    row_key = row_keys(doc_ids, part.column(1))
    again = np.ones(len(row_key), bool)
    again[np.unique(row_key, return_index=True)[1]] = False
    doc, at, h = (x[~again[doc]] for x in (doc, at, h))
    return h, doc_ids[doc], (at - offsets[doc]).astype(np.uint32), row_key[doc]


def _send_anchors(found: list[tuple[np.ndarray, ...]], hash_parts: int, parts: int) -> list[tuple[int, bytes]]:
    """Step 1.  Blobs go to partitions of hashes; what is known to be shared rides along."""
    h, ids, pos, keys = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, h))
    h, ids, pos, keys = h[order], ids[order], pos[order], keys[order]
    first = np.append(True, h[1:] != h[:-1]) if len(h) else np.zeros(0, bool)
    group = np.cumsum(first) - 1
    last = np.append(first[1:], True) if len(h) else first
    # Sorted by id within a hash: the first and last ids tell whether two documents of this block have it.
    known = (ids[first] != ids[last])[group] if len(h) else first
    # One entry speaks for its hash, all others of a shared anchor are settled here; where one document
    # holds an anchor more than once, all its positions wait for the answer.
    ask = first | ~known
    h, known = h[ask], known[ask]
    to = (h % np.uint64(hash_parts)).astype(np.int64)
    h = h // np.uint64(hash_parts)
    asked = {"doc_id": ids[ask], "key": keys[ask], "pos": pos[ask], "known": known, "low": h.astype(np.uint32), "high": (h >> np.uint64(32)).astype(np.uint16)}
    # By document within a blob: ids and keys come in runs, which compress.
    order = np.lexsort((asked["pos"], asked["key"], asked["doc_id"], to))
    to = to[order]
    edges = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), len(to)] if len(to) else [0]
    rows = [(int(to[a]), _pack(**{k: v[order[a:b]] for k, v in asked.items()})) for a, b in zip(edges, edges[1:])]
    settled = _per_part(keys[~ask], parts, pos=pos[~ask].astype(np.uint32))
    rows += [(p % hash_parts, b"S" + p.to_bytes(4, "little") + blob) for p, blob in settled]
    return rows


def _shared(blobs: list[bytes], parts: int) -> list[tuple[int, bytes]]:
    """Step 2."""
    rows = [(int.from_bytes(b[1:5], "little"), b[5:]) for b in blobs if b[:1] == b"S"]
    asked = [_unpack(b) for b in blobs if b[:1] != b"S"]
    if asked:
        low, high, ids, pos, known, keys = (np.concatenate([x[k] for x in asked]) for k in ("low", "high", "doc_id", "pos", "known", "key"))
        h = (high.astype(np.uint64) << np.uint64(32)) | low  # 48 bits: a collision only makes a candidate more
        order = np.lexsort((ids, h))
        h, ids, pos, known, keys = h[order], ids[order], pos[order], known[order], keys[order]
        first = np.append(True, h[1:] != h[:-1])
        starts = np.flatnonzero(first)
        last = np.append(starts[1:], len(h)) - 1
        shared = ((ids[starts] != ids[last]) | np.logical_or.reduceat(known, starts))[np.cumsum(first) - 1]
        rows += _per_part(keys[shared], parts, pos=pos[shared])
    return rows


def _segments(docs: pa.Table, blobs: list[bytes], buckets: int, parts: int) -> list[tuple[int, bytes]]:
    """Step 3."""
    docs = _documents(docs)
    if not blobs or not len(docs[0]):
        return []
    got = [_unpack(b) for b in blobs]
    marked, pos = np.concatenate([x["key"] for x in got]), np.concatenate([x["pos"] for x in got]).astype(np.int64)
    order = np.argsort(marked, kind="stable")
    marked, pos = marked[order], pos[order]
    rows, keys, data, offsets = docs
    found: dict[bytes, list] = {}  # segment: [hash, least doc_id, row keys, positions]
    done_keys: list[int] = []
    done_at: list[int] = []
    done_len: list[int] = []
    _, distinct = np.unique(keys, return_index=True)
    starts, stops = np.searchsorted(marked, keys, side="left"), np.searchsorted(marked, keys, side="right")
    size = np.diff(offsets)
    some = distinct[(starts[distinct] < stops[distinct]) & (size[distinct] >= LENGTH)]
    for group in np.array_split(some, max(1, int(size[some].sum()) // STEP)) if len(some) else ():
        n = size[group]
        begin = np.concatenate([[0], np.cumsum(n)])
        text = data[ragged_take(offsets[group], n)]
        h = gram_hashes(text)
        is_shared = np.zeros(len(text), bool)
        count = stops[group] - starts[group]
        where = pos[ragged_take(starts[group], count)]
        inside = where < np.repeat(n, count)
        is_shared[(where + np.repeat(begin[:-1], count))[inside]] = True
        # Each window belongs to its leftmost least hash; windows of one anchor in a row make a segment.
        view = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        anchor = np.concatenate([view[a : a + 32768].argmin(axis=1) for a in range(0, len(view), 32768)]) + np.arange(len(view))
        for cut in begin[1:-1].tolist():
            anchor[max(0, cut - LENGTH + 1) : cut] = -1  # windows over the border of two texts
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        stop = np.append(edge[1:], len(anchor))
        ok = (anchor[edge] >= 0) & is_shared[anchor[edge]]
        edge, stop = edge[ok], stop[ok]
        owner = np.searchsorted(begin, edge, side="right") - 1
        raw = text.tobytes()
        local = edge - begin[owner]
        for a, b, key, at, doc_id, row in zip(edge.tolist(), (stop + LENGTH - 1).tolist(), h[anchor[edge]].tolist(), local.tolist(), rows[group[owner]].tolist(), keys[group[owner]].tolist()):
            segment = raw[a:b]
            a, b = at, at + b - a
            entry = found.get(segment)
            if entry is None:
                found[segment] = [key, doc_id, [row], [a]]
            elif entry[1] == doc_id:
                entry[2].append(row)
                entry[3].append(a)
            else:
                # The larger id loses the whole segment, here and now.
                less = doc_id < entry[1]
                out = entry[2:] if less else [[row], [a]]
                done_keys += out[0]
                done_at += out[1]
                done_len += [b - a] * len(out[0])
                if less:
                    entry[1:] = [doc_id, [row], [a]]
    rows_out = []
    if found:
        keys = np.array([e[0] for e in found.values()], np.uint64)
        to = (keys % np.uint64(buckets)).astype(np.int64)
        order, edges = _cuts(to)
        names, entries = list(found), list(found.values())
        for a, b in zip(edges, edges[1:]):
            some = [(names[j], *entries[j][1:]) for j in order[a:b].tolist()]
            rows_out.append((int(to[order[a]]), _pack(
                length=np.array([len(s) for s, *_ in some], np.uint32), data=np.frombuffer(b"".join(s for s, *_ in some), np.uint8), doc_id=np.array([d for _, d, *_ in some], np.int64),
                count=np.array([len(p) for *_, p in some], np.uint32), key=np.array([k for *_, ks, _ in some for k in ks], np.uint64), pos=np.array([p for *_, ps in some for p in ps], np.uint32),
            )))
    if done_keys:
        settled = _per_part(np.array(done_keys, np.uint64), parts, pos=np.array(done_at, np.uint32), length=np.array(done_len, np.uint32))
        rows_out += [(p % buckets, b"S" + p.to_bytes(4, "little") + blob) for p, blob in settled]
    return rows_out


def _words(data: np.ndarray, more: int) -> np.ndarray:
    """The eight bytes from each position on as one number, and of ``more`` positions after the end (zeros)."""
    padded = np.concatenate([data, np.zeros(more + 8, np.uint8)])
    words = np.zeros(len(data) + more, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    return words


def suffix_array(data: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least, by two-stage sorting.

    A suffix smaller than its successor is sorted directly (by 8 bytes, and on only where that ties).
    The others start with a byte no smaller than the next one, so each follows from its successor, which
    stands earlier: bucket by bucket of first bytes, sorted suffixes are scanned and the larger
    predecessors appended to their buckets in that order.  The end of the data counts as smallest.  With
    ``wanted`` (a flag for each position) only those suffixes and the successors they follow from appear.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    t = np.append(data.astype(np.int16), -1)
    # Smaller than the successor: the next different byte is larger.
    change = np.flatnonzero(t[1:] != t[:-1])
    next_change = change[np.searchsorted(change, np.arange(n))]
    small = t[next_change + 1] > t[:n]
    need = np.ones(n, bool)
    if wanted is not None:
        after = np.append(np.flatnonzero(small), n - 1)
        last = after[np.minimum(np.searchsorted(after, np.arange(n)), len(after) - 1)]
        reach = np.zeros(n + 1, np.int32)
        at = np.flatnonzero(wanted)
        np.add.at(reach, at, 1)
        np.add.at(reach, np.maximum(last[at], at) + 1, -1)
        need = np.cumsum(reach[:n]) > 0
    words = _words(data, depth + 8)
    direct = np.flatnonzero(small & need)
    direct = direct[np.argsort(words[direct])]
    tied = np.append(False, words[direct[1:]] == words[direct[:-1]]) if len(direct) else np.zeros(0, bool)
    group = np.cumsum(~tied)
    for at in range(8, depth, 8):
        busy = np.flatnonzero(tied | np.append(tied[1:], False)) if len(tied) else tied
        if not len(busy):
            break
        w = words[direct[busy] + at]
        order = np.argsort(w)
        order = order[np.argsort(group[busy][order], kind="stable")]
        direct[busy], w = direct[busy][order], w[order]
        g = group[busy]  # sorted already, and the order within it doesn't change it
        tied[busy] = np.append(False, (g[1:] == g[:-1]) & (w[1:] == w[:-1]))
        group = np.cumsum(~tied)
    lead = t[direct]
    cut = np.searchsorted(lead, np.arange(257))
    waiting: dict[int, list[np.ndarray]] = {}
    if not small[n - 1] and need[n - 1]:
        waiting[int(t[n - 1])] = [np.array([n - 1])]  # its successor is the end
    out = []
    for c in range(256):
        level = np.concatenate(waiting.pop(c)) if c in waiting else np.zeros(0, np.int64)
        block = []
        while len(level):  # runs of one byte follow from within the bucket, one step a round
            block.append(level)
            before = level[level > 0] - 1
            level = before[(t[before] == c) & need[before]]
        block = np.concatenate([*block, direct[cut[c] : cut[c + 1]]])
        if not len(block):
            continue
        out.append(block)
        before = block[block > 0] - 1
        lead = t[before]
        go = (lead > c) & need[before]
        before, lead = before[go], lead[go]
        order, edges = _cuts(lead)
        for a, b in zip(edges, edges[1:]):
            waiting.setdefault(int(lead[order[a]]), []).append(before[order[a:b]])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, suffixes: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``most`` bytes; 0 for the first."""
    out = np.zeros(len(suffixes), np.int64)
    if len(suffixes) < 2:
        return out
    words, left = _words(data, most + 8), np.arange(1, len(suffixes))
    for at in range(0, most, 8):
        x = words[suffixes[left - 1] + at] ^ words[suffixes[left] + at]
        same = x == 0
        ended = x[~same]
        out[left[~same]] += sum((ended < np.uint64(1 << (56 - 8 * j))).astype(np.int64) for j in range(7))
        left = left[same]
        out[left] += 8
        if not len(left):
            break
    out[1:] = np.minimum(out[1:], np.minimum(len(data) - suffixes[1:], len(data) - suffixes[:-1]))
    return np.minimum(out, most)


def _repeats(blobs: list[bytes], parts: int) -> list[tuple[int, bytes]]:
    """Step 4."""
    rows = [(int.from_bytes(b[1:5], "little"), b[5:]) for b in blobs if b[:1] == b"S"]
    number: dict[bytes, int] = {}
    least: list[int] = []
    of, ids, at, keys = [], [], [], []
    for x in (_unpack(b) for b in blobs if b[:1] != b"S"):
        raw, end = x["data"].tobytes(), 0
        place = 0
        for length, doc_id, count in zip(x["length"].tolist(), x["doc_id"].tolist(), x["count"].tolist()):
            segment, end = raw[end : end + length], end + length
            i = number.setdefault(segment, len(number))
            if i == len(least):
                least.append(doc_id)
            elif doc_id < least[i]:
                least[i] = doc_id
            of += [i] * count
            ids += [doc_id] * count
            place += count
        at.append(x["pos"][:place])
        keys.append(x["key"][:place])
    if not number:
        return rows
    names = list(number)
    lengths = np.array([len(s) for s in names], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(names), np.uint8)
    owner = np.repeat(np.arange(len(names)), lengths)
    room = offsets[owner + 1] - np.arange(len(data))  # bytes to the end of the segment
    suffixes = suffix_array(data, wanted=room >= LENGTH)
    prefix = common_prefixes(data, suffixes)
    whole = room[suffixes] >= LENGTH
    least_of = np.array(least, np.int64)
    # Only strings inside a segment take part; between two of them the least common prefix counts, and
    # any suffix between equal strings begins with the same bytes.
    group = np.cumsum(prefix < LENGTH)[whole]
    inside = suffixes[whole]
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    smallest = np.minimum.reduceat(least_of[owner[inside[order]]], first) if len(first) else np.zeros(0, np.int64)
    best = np.full(len(data), np.iinfo(np.int64).max)
    best[inside[order]] = np.repeat(smallest, np.diff(np.append(first, len(order))))
    # Each place of a segment takes what strings of it an earlier document has.
    of, ids, at, keys = np.array(of), np.array(ids, np.int64), np.concatenate(at).astype(np.int64), np.concatenate(keys)
    windows = lengths[of] - LENGTH + 1
    where = ragged_take(offsets[of], windows)
    entry = np.repeat(np.arange(len(of)), windows)
    hit = best[where] < ids[entry]
    e, k = entry[hit], (where - offsets[of][entry])[hit]
    start = np.append(True, (e[1:] != e[:-1]) | (k[1:] != k[:-1] + 1)) if len(e) else np.zeros(0, bool)
    s = np.flatnonzero(start)
    stop = np.append(s[1:], len(e)) - 1
    if len(s):
        rows += _per_part(keys[e[s]], parts, pos=(at[e[s]] + k[s]).astype(np.uint32), length=(k[stop] - k[s] + LENGTH).astype(np.uint32))
    return rows


def _remove(docs: pa.Table, blobs: list[bytes]) -> pa.Table:
    """Step 5."""
    got = [_unpack(b) for b in blobs]
    none = np.zeros(0, np.int64)
    marked = np.concatenate([x["key"] for x in got]) if got else none.astype(np.uint64)
    pos, length = (np.concatenate([x[k] for x in got]).astype(np.int64) if got else none for k in ("pos", "length"))
    order = np.argsort(marked, kind="stable")
    marked, pos, length = marked[order], pos[order], length[order]
    rows, keys, data, offsets = _documents(docs)
    removed, spans, digests = [], [], []
    lo, hi = np.searchsorted(marked, keys, side="left"), np.searchsorted(marked, keys, side="right")
    for i in range(len(rows)):
        text = data[offsets[i] : offsets[i + 1]]
        if lo[i] == hi[i]:
            removed.append(0)
            spans.append(0)
            digests.append(hashlib.sha256(text).hexdigest())
            continue
        change = np.zeros(len(text) + 1, np.int64)
        a = np.minimum(pos[lo[i] : hi[i]], len(text))
        np.add.at(change, a, 1)
        np.add.at(change, np.minimum(a + length[lo[i] : hi[i]], len(text)), -1)
        gone = np.cumsum(change[:-1]) > 0
        removed.append(int(gone.sum()))
        spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        digests.append(hashlib.sha256(text[~gone]).hexdigest())
    return pa.table({"doc_id": pa.array(rows), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, row keys, bytes, offsets) of the documents packed in a table's blobs."""
    got = [_unpack(b) for b in _blobs(table)]
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    rows, keys, data, size = (np.concatenate([x[k] for x in got]) for k in ("doc_id", "key", "data", "size"))
    return rows, keys, data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def _blobs(table: pa.Table) -> list[bytes]:
    return table.column("blob").to_pylist()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    Texts are UTF-8 bytes, matches never cross documents, and strings are judged on the input.  A null
    text counts as empty.  Rows with a null id are nobody's earlier or later document: they keep all
    their bytes.  Rows that share an id are one document for the question who came first, and each lose
    what earlier documents have.  Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 4 << 20)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    numbered = rows.where("doc_id is not null")
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(partitions(spark), round(size / PART_BYTES))
    hash_parts = max(partitions(spark), round(size / BLOCK_BYTES))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, limit=STEP):
            held.append(_anchors_of(part))
            size += part.column(1).nbytes
            if size >= BLOCK_BYTES:
                yield _batch(_send_anchors(held, hash_parts, parts))
                held, size = [], 0
        if held:
            yield _batch(_send_anchors(held, hash_parts, parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=BLOCK_BYTES):
            keys = row_keys(part.column(0).to_numpy(), part.column(1))
            data, offsets = byte_view(part.column(1))
            at, size, rows = (keys % np.uint64(parts)).astype(np.int64), np.diff(offsets), part.column(0).to_numpy()
            order, edges = _cuts(at)
            for a, b in zip(edges, edges[1:]):
                some = order[a:b]
                blob = _pack(doc_id=rows[some], key=keys[some], size=size[some], data=data[ragged_take(offsets[some], size[some])])
                yield _batch([(int(at[some[0]]), blob)])

    laid = numbered.mapInArrow(place, _BLOB).groupBy("at")
    asked = numbered.mapInArrow(send, _BLOB)
    shared = asked.groupBy("at").applyInArrow(lambda t: _table(_shared(_blobs(t), parts)), _BLOB)
    segments = laid.cogroup(shared.groupBy("at")).applyInArrow(lambda d, s: _table(_segments(d, _blobs(s), parts, parts)), _BLOB)
    repeats = segments.groupBy("at").applyInArrow(lambda t: _table(_repeats(_blobs(t), parts)), _BLOB)
    out = laid.cogroup(repeats.groupBy("at")).applyInArrow(lambda d, r: _remove(d, _blobs(r)), SCHEMA)
    empty = rows.where("doc_id is null").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"))
    return out.unionByName(empty)
