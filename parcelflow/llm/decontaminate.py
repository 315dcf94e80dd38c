"""Benchmark decontamination by CGK embeddings.

A CGK walk reads a word sequence and, at each step, writes the word under its pointer and moves on or not
as a random bit of (walk, step, word) says.  Walks over two sequences that are few edits apart meet again
after each edit and write the same from there on, so edit distance becomes Hamming distance of what is
written.  Half of the walks read backwards, from an item's end.

Bit sampling: a repeat is a walk and SAMPLES of its steps, drawn over the whole walk or its first part; an item and a window
of a text, as long as the item, collide in it if they write the same words at all of them.  Every word of
a text starts a window.  Items come in size classes, each with repeats of its own, as many as its recall
takes; long items are cut in pieces of PIECE words at most, one of which has no more than its share of the
edits.  Of a collision, further steps of the walk are compared: a Hamming distance that no leak has is
dropped.  What is left is settled by the exact word edit distance of the item to the best stretch there.

All windows of a text walk together: windows whose pointers meet stay together, so a step is taken once for
each pointer, of which there are ever fewer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_view, ragged_take, slices, split_distinct, text_flags
from .near_dup import mix
from .storage import file_system, fresh, small_batches

#: Edits (words put in, left out or changed) per word of an item at most.
MAX_EDITS = 0.1
#: Words of a piece of a long item at most; the ratio of the sizes in a class, and the least size that may have edits.
PIECE, RATIO, EDITABLE = 40, 1.4, 10
#: Walks, half of them backwards; repeats of a class, dealt over the walks; steps that a repeat samples.
WALKS, REPEATS, SAMPLES = 4, 12, 4
#: Parts of a walk, from its beginning, that its repeats sample in turn: edits in an item's second half leave the first half of a
#: forward walk as it was, those in its first half that of a backward walk.
PARTS = (1.0, 0.5, 0.75)
#: Steps of a walk per word of a class's least item: its pointer stays inside the item for most of them.
STEPS = 1.6
#: Steps at which windows that have met are put together.
MEETINGS = frozenset([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 48, 64, 80])
#: Steps that are compared after a collision, and how many of them have to agree at least.
CHECKS, AGREE = 16, 5
#: Items, and words of them, that are held at once; more are taken in blocks, each against every slice of the documents.
ITEM_BLOCK, WORD_BLOCK = 20_000, 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, n_edits int, start_word bigint, end_word bigint"
_END = np.uint64(0x5BD1E9955BD1E995)  # stands for the words past an end


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: its bytes times random odd numbers by position, mixed with its length."""
    data, at = byte_view(words)
    size = np.diff(at)
    if not len(data):
        return mix(size.astype(np.uint64))
    odd = mix(np.arange(int(size.max()), dtype=np.uint64)) | np.uint64(1)
    total = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    total[full] = np.add.reduceat(odd[np.arange(len(data)) - np.repeat(at[:-1], size)] * (data.astype(np.uint64) + np.uint64(1)), at[:-1][full])
    return mix(total ^ mix(size.astype(np.uint64)))


def word_sequences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, offsets of each text).  Words are runs of letters and digits, in lower case."""
    flat = pc.replace_substring_regex(texts, r"[\s\x{85}\p{Z}]", " ")
    offsets, codes, chunks = split_distinct(flat)
    pieces = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(chunks), r"[^\p{L}\p{N}\p{M}]+", " "), " ")
    lists = pc.split_pattern(pieces, " ")
    own = np.diff(lists.offsets.to_numpy().astype(np.int64)) * (pc.binary_length(pieces).to_numpy(zero_copy_only=False) > 0)
    hashes = _hashes(lists.flatten())[ragged_take(lists.offsets.to_numpy().astype(np.int64)[:-1], own)]
    first = np.concatenate([[0], np.cumsum(own)])[:-1]
    n = own[codes]
    ends = np.concatenate([[0], np.cumsum(n)])
    return hashes[ragged_take(first[codes], n)], ends[offsets]


def _bits(words: np.ndarray, walk: int, step: int) -> np.ndarray:
    """Of each word the random bits of 64 steps from ``step`` on, a multiple of 64; the end of a text never moves on."""
    seed = np.uint64(((walk + 1) * 0x9E3779B97F4A7C15 ^ (step + 1) * 0xC2B2AE3D27D4EB4F) & ((1 << 64) - 1))
    return np.where(words == _END, np.uint64(0), mix(words ^ mix(seed[None])))


def _step(bits: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    return at + (bits[at] >> np.uint64(step % 64) & np.uint64(1)).astype(at.dtype)


def _pointers(words: np.ndarray, start: np.ndarray, walk: int, steps: np.ndarray) -> np.ndarray:
    """Pointers [step, start] of walks from ``start`` at ascending steps."""
    out, at = np.empty((len(steps), len(start)), np.int64), start
    for step in range(int(steps[-1]) + 1 if len(steps) else 0):
        if step % 64 == 0:
            bits = _bits(words, walk, step)
        out[steps == step] = at
        at = _step(bits, at, step)
    return out


class Repeats:
    """The repeats of one size class in one walk: sampled steps, and what the class's windows write there."""

    def __init__(self, walk: int, low: int, many: int, words: np.ndarray, start: np.ndarray, window: np.ndarray):
        self.walk, self.window = walk, window
        length = low if low < EDITABLE else int(STEPS * low)
        rng = np.random.default_rng([walk, low])
        draw = lambda k, part=1.0: np.sort(rng.permutation(max(min(k, length), int(part * length)))[: min(k, length)])
        self.checks = draw(CHECKS)
        self.check_at = _pointers(words, start, walk, self.checks).T
        self.check_words, self.check_at = words[self.check_at], self.check_at - start[:, None]
        self.agree = min(AGREE, len(self.checks))
        #: Of each repeat: its steps; the words at the first, then the keys that windows have so far, sorted; at last their windows by key.
        self.steps: list[np.ndarray] = []
        self.keys: list[list[np.ndarray]] = []
        self.of: list[tuple[np.ndarray, np.ndarray]] = []
        self.first_at: list[np.ndarray] = []  # pointers of windows at the first step
        for repeat in range(many):
            steps = draw(SAMPLES, PARTS[repeat % len(PARTS)] if low >= EDITABLE else 1.0)
            key, seen = np.zeros(len(start), np.uint64), []
            self.first_at.append(_pointers(words, start, walk, steps[:1])[0] - start)
            for at in _pointers(words, start, walk, steps):
                key = mix(key ^ words[at])
                seen.append(np.unique(key) if seen else np.unique(words[at]))
            order = np.argsort(key, kind="stable")
            self.steps.append(steps), self.keys.append(seen), self.of.append((key[order], order))


def _pointers_of(vocabulary: np.ndarray, code: np.ndarray, walk: int, steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Pointers [start, step] of walks over coded words, from some starts only."""
    out, at = np.empty((len(start), len(steps)), np.int64), start
    for step in range(int(steps[-1]) + 1):
        if step % 64 == 0:
            bits = _bits(vocabulary, walk, step)
        out[:, steps == step] = at[:, None]
        at = at + (bits[code[at]] >> np.uint64(step % 64) & np.uint64(1)).astype(np.int64)
    return out


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


class Items:
    """Items' words, their windows and the repeats of all size classes."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float = MAX_EDITS):
        words, offsets = word_sequences(pa.array(texts, pa.string()))
        self.max_edits = max_edits
        self.rows = [(i, words[a:b].tolist()) for i, a, b in zip(ids, offsets.tolist(), offsets[1:].tolist()) if b > a]
        self.masks = []
        cuts = []  # item, first word and end of each window, the latter two in its item
        for k, (_, seq) in enumerate(self.rows):
            mask: dict[int, int] = defaultdict(int)
            for j, w in enumerate(seq):
                mask[w] |= 1 << j
            self.masks.append(dict(mask))
            n = len(seq)
            parts = -(-n // PIECE)
            cuts += [(k, n * p // parts, n * (p + 1) // parts) for p in range(parts)]
        self.item, begin, end = np.array(cuts, np.int64).reshape(-1, 3).T
        self.shift, self.size = begin, end - begin
        low = [n if n < EDITABLE else int(np.ceil(EDITABLE * RATIO ** int(np.log(n / EDITABLE) / np.log(RATIO) + 1e-9))) for n in self.size.tolist()]
        self.walks: list[list[Repeats]] = [[] for _ in range(WALKS)]
        for walk in range(WALKS if cuts else 0):
            flat = [self.rows[k][1][a:b][:: -1 if walk % 2 else 1] + [int(_END)] for k, a, b in cuts]
            start = np.cumsum([0, *map(len, flat)])[:-1]
            joined = np.array([w for f in flat for w in f], np.uint64)
            for least in sorted(set(low)):
                if least < EDITABLE and walk:
                    continue  # without edits a window writes what the item writes, in any walk
                own = np.flatnonzero(np.array(low) == least)
                self.walks[walk].append(Repeats(walk, least, 1 if least < EDITABLE else REPEATS // WALKS, joined, start[own], own))

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], set[int]]:
        """(text, item) -> where the item would start, as words of the text, as far as its windows collide with the text's.

        A start may lie before the text or run past its end, if the item's outer words are edited.
        """
        # An end behind each text, and one before all, stops the pointers of both directions.
        seq = np.concatenate([[_END], np.insert(words, offsets[1:], _END)])
        begin = 1 + offsets[:-1] + np.arange(len(offsets) - 1)
        vocabulary, code = np.unique(seq, return_inverse=True)
        found: dict[tuple[int, int], set[int]] = defaultdict(set)
        for walk, classes in enumerate(self.walks):
            if not classes:
                continue
            back = walk % 2
            own = code[::-1] if back else code
            start = np.flatnonzero(vocabulary[own] != _END).astype(np.int32)
            for repeats, window, where in self._collisions(classes, walk, vocabulary, own, start):
                words_here, place = vocabulary[own], _pointers_of(vocabulary, own, walk, repeats.checks, where)
                same = words_here[place] == repeats.check_words[window]
                good = np.flatnonzero(same.sum(axis=1) >= repeats.agree)
                if not len(good):
                    continue
                # Where a step agrees the pointers tell how text and item lie to each other; the middle one of these counts.
                apart = np.where(same[good], place[good] - repeats.check_at[window[good]], np.iinfo(np.int64).max)
                apart.sort(axis=1)
                first = apart[np.arange(len(good)), same[good].sum(axis=1) // 2]
                number, at_word = repeats.window[window[good]], where[good].astype(np.int64)
                if back:  # positions count from the end, and the window's last word comes first
                    first, at_word = len(seq) - first - self.size[number], len(seq) - 1 - at_word
                text = np.searchsorted(begin, at_word, side="right") - 1
                for i, k, x in np.unique(np.stack([text, self.item[number], first - begin[text] - self.shift[number]], axis=1), axis=0).tolist():
                    found[i, k].add(x)
        return found

    @staticmethod
    def _collisions(classes: list[Repeats], walk: int, vocabulary: np.ndarray, code: np.ndarray, start: np.ndarray) -> Iterator[tuple[Repeats, np.ndarray, np.ndarray]]:
        """(repeats, windows of items, starts in the text) that collide; each pair once a class."""
        last = max(int(s[-1]) for r in classes for s in r.steps)
        due: dict[int, list[tuple[Repeats, int, int]]] = defaultdict(list)
        for r in classes:
            for j, steps in enumerate(r.steps):
                for k, step in enumerate(steps.tolist()):
                    due[step].append((r, j, k))
        # A repeat knows nothing of a window before its first step: from there on windows of one pointer are one.
        live: dict[tuple[int, int], list[np.ndarray]] = {}
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        pointer, lo, hi = start, start, start  # distinct pointers, and the first and last start of each
        for step in range(last + 1):
            if step % 64 == 0:
                bits = _bits(vocabulary, walk, step)[code]
            if step in MEETINGS and len(pointer):
                new = np.concatenate([[True], pointer[1:] != pointer[:-1]])  # pointers of later starts are never behind
                group, at = np.cumsum(new) - 1, np.flatnonzero(new)
                pointer, lo, hi = pointer[at], lo[at], hi[np.append(at[1:], len(new)) - 1]
                for one in live.values():
                    one[0] = group[one[0]]
            here = code[pointer] if any(k == 0 for _, _, k in due.get(step, ())) else None
            for r, j, k in due.get(step, ()):
                if k == 0:
                    place = np.minimum(np.searchsorted(vocabulary, r.keys[j][0]), len(vocabulary) - 1)
                    flags = np.zeros(len(vocabulary), bool)
                    flags[place[vocabulary[place] == r.keys[j][0]]] = True
                    some = np.flatnonzero(flags[here])
                    live[id(r), j] = [some, mix(vocabulary[here[some]]), pointer[some], lo[some], hi[some]]
                else:
                    one = live[id(r), j]
                    one[1] = mix(one[1] ^ vocabulary[code[pointer[one[0]]]])
                    keep = np.flatnonzero(_among(one[1], r.keys[j][k]))
                    live[id(r), j] = [x[keep] for x in one]
                if k + 1 == len(r.steps[j]):
                    _, key, first, low, high = live.pop((id(r), j))
                    keys, order = r.of[j]
                    a, b = np.searchsorted(keys, key, side="left"), np.searchsorted(keys, key, side="right")
                    window = order[ragged_take(a, b - a)]
                    first, low, high = (np.repeat(x, b - a) for x in (first, low, high))
                    # Of the windows that are one, the one that had as far to go as the item.
                    hits[id(r)].append((window, np.clip(first - r.first_at[j][window], low, high)))
            pointer = _step(bits, pointer, step)
        for r in classes:
            window, where = (np.concatenate(x) for x in zip(*hits[id(r)]))
            pair = np.unique(where.astype(np.int64) * len(r.window) + window)
            if len(pair):
                yield r, pair % len(r.window), pair // len(r.window)

    def settle(self, k: int, words: list[int], starts: set[int]) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best stretch near ``starts`` for item k, or None beyond the allowed edits."""
        seq, mask = self.rows[k][1], self.masks[k]
        n, most = len(seq), int(len(seq) * self.max_edits)
        regions: list[list[int]] = []
        for start in sorted(starts):
            if start >= 0 and words[start : start + n] == seq:
                return 0, start, start + n
            # A stretch with a whole piece is shifted and stretched by its edits at most.  Neighbours share a region.
            lo, hi = max(0, start - most), start + n + most
            if regions and lo <= regions[-1][1]:
                regions[-1][1] = hi
            else:
                regions.append([lo, hi])
        best = None
        for lo, hi in regions if most else []:
            score, end = _distances(words[lo:hi], mask, n)
            if score <= most and (best is None or score < best[0]):
                best = (score, lo, lo + end)
        if best is None:
            return None
        score, lo, end = best
        # Where the stretch starts: the same distance read backwards from its end.
        back: dict[int, int] = defaultdict(int)
        for i, w in enumerate(reversed(seq)):
            back[w] |= 1 << i
        _, length = _distances(list(reversed(words[max(0, end - n - most) : end])), back, n, anchored=True)
        return score, end - length, end


def _distances(words: list[int], mask: dict[int, int], n: int, anchored: bool = False) -> tuple[int, int]:
    """(least edit distance, first end) of a pattern of n words to any stretch of ``words``, bit-parallel.

    If anchored, to any stretch that starts with the first word.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, best, end = full, 0, n, n, 0
    for i, w in enumerate(words):
        eq = mask.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1 | anchored) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


def _leaks(items: Items, texts: pa.Array, sequences: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int, int]]:
    """(text, item id, edits, start word, end word) of all leaks in an array without nulls, whose word sequences may be given."""
    words, offsets = sequences or word_sequences(texts)
    found, lists = items.candidates(words, offsets), {}
    out = []
    for (i, k), starts in found.items():
        a, b = int(offsets[i]), int(offsets[i + 1])
        if i not in lists:
            lists[i] = words[a:b].tolist()
        if hit := items.settle(k, lists[i], starts):
            out.append((i, items.rows[k][0], *hit))
    return sorted(out)


def item_files(benchmark: DataFrame, block: int = ITEM_BLOCK, words: int = WORD_BLOCK) -> list[str]:
    """Parquet files of the items in the shared folder, in the order of item_id, of so many rows and about so many words at most.

    Null ids and texts are left out, equal rows are one.  Only the files' names come to the driver.
    """
    rows = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].alias("text")).where("item_id is not null and text is not null").distinct()
    n, size = rows.agg(F.count("*"), F.sum(F.size(F.split("text", " ")))).first()
    if not n:
        return []
    path = fresh(benchmark.sparkSession, "items")
    parts = max(-(-n // block), -(-size // words))
    # Few files, however many ranges there are: each is compared with all documents.
    rows.repartitionByRange(parts, "item_id", "text").sortWithinPartitions("item_id", "text").coalesce(parts).write.option("maxRecordsPerFile", block).parquet(path)
    system, at = file_system(path)
    names = [i.base_name for i in system.get_file_info(FileSelector(at)) if i.base_name.startswith("part-")]
    return [f"{path}/{name}" for name in sorted(names)]


#: Blocks of items that a Python worker keeps, the latest last; two at most.
_held: dict[str, Items] = {}


def _block(file: str) -> Items:
    if file not in _held:
        if len(_held) > 1:
            _held.pop(next(iter(_held)))
        system, at = file_system(file)
        with system.open_input_file(at) as f:
            rows = pq.read_table(f)
        _held[file] = Items(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())
    return _held[file]


def item_blocks(benchmark: DataFrame, block: int = ITEM_BLOCK) -> Iterator[Items]:
    """The items of each file of ``item_files``, one after the other."""
    for file in item_files(benchmark, block):
        yield _block(file)


def _all_leaks(files: list[str], texts: pa.Array) -> list[tuple[int, int, int, int, int]]:
    sequences = word_sequences(texts)
    return sorted(hit for file in files for hit in _leaks(_block(file), texts, sequences))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (row of docs, item) that leaks: doc_id, item_id, n_edits, start_word and end_word.

    An item leaks if its words are within MAX_EDITS of a stretch of the text; the stretch of the fewest
    edits is given, as word positions.  Whatever is given is exact; of the leaks with the most edits the
    repeats find at least 95 % in each size class, wherever the edits are, and exact copies always.  Null
    texts hold nothing; null ids and repeated rows are kept; an item without words leaks nowhere; equal items
    leak alike; other columns are not read.  One pass over the documents, without a shuffle.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    files = item_files(benchmark)
    if not files:
        return rows.sparkSession.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hits = _all_leaks(files, part.column(1))
            columns = list(zip(*hits)) if hits else [()] * 5
            yield pa.record_batch([part.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def drop_leaking(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, in which no item leaks, in one pass.

    Null and empty texts hold nothing and stay.  Only the texts go to Python, and only flags come back.
    """
    small_batches(docs.sparkSession)
    files = item_files(benchmark)
    if not files:
        return docs

    def clean(texts: pa.Array) -> np.ndarray:
        keep = np.ones(len(texts), bool)
        keep[[h[0] for h in _all_leaks(files, texts)]] = False
        return keep

    @F.arrow_udf("boolean")
    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from text_flags(batches, clean)

    return docs.where(flags(docs[text_col]))
