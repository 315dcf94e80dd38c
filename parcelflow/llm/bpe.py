"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merging keeps one bucket of linked-list positions per merge rank and a bitmap of the ranks that have a
bucket, with two summary levels above it.  Find-first-set on the three levels gives the lowest rank; its
bucket is merged from left to right, and entries whose pair is gone by then are skipped.  All distinct
pre-tokens of a slice share one queue: they don't touch each other, so working by global rank keeps
each one's own order, and a bucket is a handful of array operations however many positions it holds.  A
run of a million letters is no different from a short word.  The text is first cut at single spaces
between words, where no pre-token can continue, so that each distinct piece is split once per slice.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .chunks import ragged_take, slices, split_distinct, sums
from .storage import small_batches

#: Pre-tokens remembered by one Python worker; when full, the memory starts anew.
REMEMBERED = 300_000
#: Text bytes whose pre-tokens share one queue.
ENCODE_BYTES = 4 << 20
ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Merge ranks that wait, each with the positions it waits at."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int] | np.ndarray] = {}

    def push(self, rank: int, positions: list[int] | np.ndarray) -> None:
        """Positions in an array wait as such until others join them."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            if isinstance(bucket, np.ndarray):
                bucket = self.buckets[rank] = bucket.tolist()
            bucket.extend(positions)
            return
        self.buckets[rank] = positions
        word = rank >> 6
        self.low[word] |= 1 << (rank & 63)
        self.mid[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int] | np.ndarray]:
        """The lowest rank that waits and its bucket, which leaves the queue; -1 if none waits."""
        top = self.top
        if not top:
            return -1, []
        i = (top & -top).bit_length() - 1
        mid = self.mid[i]
        i = (i << 6) + (mid & -mid).bit_length() - 1
        low = self.low[i]
        rank = (i << 6) + (low & -low).bit_length() - 1
        self.low[i] = low & (low - 1)
        if not self.low[i]:
            self.mid[i >> 6] &= ~(1 << (i & 63))
            if not self.mid[i >> 6]:
                self.top &= ~(1 << (i >> 6))
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """Ids of texts by a table of byte strings and their ranks; ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte needs a rank")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.concatenate([[0], np.cumsum(self.token_lengths)[:-1]])
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Every way to put a token together from two tokens.
        pairs = {ranks[t[:i]] * self.size + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.known: dict[str, bytes] = {}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge or one of them is -1."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def merge_many(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each) of many pre-tokens, merged together over one rank queue."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        data = np.frombuffer(b"".join(tokens), np.uint8)
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), lengths
        # Linked list of symbols; position n is the end, and stands between pre-tokens too.
        kind = np.int32 if n < 1 << 31 else np.int64
        owner = np.repeat(np.arange(len(tokens), dtype=kind), lengths)
        symbol = np.append(self.byte_ids[data], -1).astype(kind)
        after, before = np.arange(1, n + 2, dtype=kind), np.arange(-1, n, dtype=kind)
        ends = np.cumsum(lengths)[lengths > 0]
        after[ends - 1] = n
        before[np.concatenate([[0], ends[:-1]])] = n
        due = np.append(self._pair(symbol[:n], symbol[after[:n]]), -1).astype(kind)  # rank of the pair that starts here, as it stands
        queue = RankQueue(self.size)

        def wait(positions: np.ndarray) -> None:
            ranks = due[positions]
            for r, p in zip(ranks.tolist(), positions.tolist()):
                if r >= 0:
                    queue.push(r, [p])

        start = np.flatnonzero(due >= 0)
        order = start[np.argsort(due[start], kind="stable")]
        for group in np.split(order, np.flatnonzero(np.diff(due[order])) + 1) if len(order) else ():
            queue.push(int(due[group[0]]), group.astype(kind))
        while True:
            rank, bucket = queue.pop()
            if rank < 0:
                break
            at = np.unique(bucket)
            at = at[due[at] == rank]  # the rest is stale
            if not len(at):
                continue
            if len(at) > 1:  # pairs that overlap (a run of one symbol): every other one, from the left
                joined = np.append(False, after[at[:-1]] == at[1:])
                if joined.any():
                    i = np.arange(len(at))
                    at = at[(i - np.maximum.accumulate(np.where(joined, 0, i))) % 2 == 0]
            second = after[at]
            third, left = after[second], before[at]
            made = np.full(len(at), rank)
            new = np.concatenate([self._pair(symbol[left], made), self._pair(made, symbol[third]), self._pair(made[:1], made[:1])])
            if len(at) > 1 and ((new >= 0) & (new < rank)).any():
                # A pair made here goes before the rest of its pre-token: only the leftmost of each now.
                keep = np.append(True, np.diff(owner[at]) != 0)
                queue.push(rank, at[~keep].tolist()) if not keep.all() else None
                at, second, third, left = at[keep], second[keep], third[keep], left[keep]
            symbol[at], symbol[second] = rank, -1
            after[at], due[second] = third, -1
            real = third < n
            before[third[real]] = at[real]
            due[at] = self._pair(symbol[at], symbol[third])
            left = left[(left < n)]
            left = left[symbol[left] >= 0]  # a neighbour that was merged away itself has been dealt with
            due[left] = self._pair(symbol[left], symbol[after[left]])
            wait(np.concatenate([at, left]))
        alive = np.flatnonzero(symbol[:n] >= 0)
        return symbol[alive], np.bincount(owner[alive], minlength=len(tokens))

    @classmethod
    def from_file(cls, path: str, pattern: str) -> "ByteBPE":
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of stretches of text that are cut where pre-tokens end."""
        split = [self.pattern.findall(p) for p in pieces]
        known, ranks = self.known, self.ranks
        if len(known) > REMEMBERED:
            known.clear()
        new, merged = {t: t.encode() for tokens in split for t in tokens if t not in known}, []
        for t, raw in new.items():
            if (whole := ranks.get(raw)) is not None:
                known[t] = whole.to_bytes(4, "little")
            else:
                merged.append(t)
        ids, counts = self.merge_many([new[t] for t in merged])
        ids, at = ids.astype("<u4").tobytes(), 0
        for t, to in zip(merged, (np.cumsum(counts) * 4).tolist()):
            known[t], at = ids[at:to], to
        out = [b"".join([known[t] for t in tokens]) for tokens in split]
        for t in merged:
            if len(t) > 64:
                del known[t]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text) of an array without nulls."""
        # A cut before a space is safe between two characters that aren't white space.  Only texts with
        # other neighbours of a space (two in a row, at an end, beside a line break) are taken whole.
        odd = pc.match_substring_regex(texts, r"(?:^|[\s\p{Z}\x0b\x1c-\x1f\x{85}]) |[ ](?:[\s\p{Z}\x0b\x1c-\x1f\x{85}]|$)")
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(texts), np.int64)
        flat: list[np.ndarray] = []
        if not odd.all():
            offsets, codes, words = split_distinct(texts.filter(pa.array(~odd)))
            # The first word of a text has no space before it, all others do.
            first = np.zeros(len(codes), bool)
            first[offsets[:-1]] = True
            forms, codes = np.unique(codes.astype(np.int64) * 2 + first, return_inverse=True)
            words = words.to_pylist()
            ids = self._ids([words[f >> 1] if f & 1 else " " + words[f >> 1] for f in forms.tolist()])
            sizes = np.array([len(x) >> 2 for x in ids], np.int64)
            table = np.frombuffer(b"".join(ids), "<u4")
            lengths[~odd] = sums(sizes[codes], offsets)
            starts = np.cumsum(sizes) - sizes
            flat.append(table[ragged_take(starts[codes], sizes[codes])])
        if odd.any():
            ids = self._ids(texts.filter(pa.array(odd)).to_pylist())
            lengths[odd] = [len(x) >> 2 for x in ids]
            flat.append(np.frombuffer(b"".join(ids), "<u4"))
            # Back into the order of the texts.
            order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
            starts = np.empty(len(texts), np.int64)
            starts[order] = np.cumsum(lengths[order]) - lengths[order]
            flat = [np.concatenate(flat)[ragged_take(starts, lengths)]]
        return (flat[0] if flat else np.zeros(0, "<u4")), np.concatenate([[0], np.cumsum(lengths)])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        ids = ids.astype(np.int64)
        return self.token_bytes[ragged_take(self.token_starts[ids], self.token_lengths[ids])].tobytes()


_coders: dict[tuple[str, str], ByteBPE] = {}


def _coder(path: str, pattern: str) -> ByteBPE:
    return _coders.get((path, pattern)) or _coders.setdefault((path, pattern), ByteBPE.from_file(path, pattern))


def encode_docs(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens and ids (little-endian unsigned 32-bit integers).

    Each match of ``pattern`` is merged by itself; no special tokens.  A null text counts as empty and
    has no ids; null ids and repeated rows are kept; other columns are not read.  No shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for part in slices(batches, limit=ENCODE_BYTES):
            ids, offsets = coder.encode(part.column(1))
            blobs = [ids[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.record_batch([part.column(0), pa.array(np.diff(offsets)), pa.array(blobs, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, ENCODED)


def decode_docs(encoded: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and the decoded bytes as ``data``; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for part in slices(batches):
            data = [coder.decode(np.frombuffer(x, "<u4")) for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(encoded[id_col].cast("bigint").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id bigint, data binary")


def round_trip_digests(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode each text in one pass: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex).

    Nulls and repeats as in encode_docs.
    """
    small_batches(docs.sparkSession, ENCODE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        for part in slices(batches, limit=ENCODE_BYTES):
            ids, offsets = coder.encode(part.column(1))
            lengths = np.concatenate([[0], np.cumsum(coder.token_lengths[ids])])[offsets]
            data = coder.decode(ids)
            digest = lambda raw, at: [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at, at[1:])]
            yield pa.record_batch(
                [part.column(0), pa.array(np.diff(offsets)), pa.array(digest(memoryview(ids.tobytes()), (offsets * 4).tolist())), pa.array(digest(memoryview(data), lengths.tolist()))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, DIGESTS)
