"""Periodic runs of words, found in a grammar of the texts.

Re-Pair in rounds: every occurrence of a pair of neighbouring symbols that is met at least twice, and more
often than the pairs that overlap it (ties by a hash of the pair), becomes one symbol, the same for the
same pair in all texts of a slice; a balanced tree joins what has no repeated pair left.  Symbols that are
made in one round stand for disjoint stretches where they are met first, and there are about log n rounds,
so the lengths of all symbols add up to about n log n.

Each rule X -> A B is looked at once: the runs of X's words that cross the border between A and B, cut off
at the ends of X.  A run of four periods or more has two of them on one side of the border, so each period
q whose next q words repeat on a side is a candidate, and how far it reaches both ways is read off names of
stretches of 1, 2, 4, ... words.  The runs are then translated to all places that X has in the derivation
of the texts, where those that are parts of others of the same period are merged into them: the rule whose
border a run crosses and whose stretch holds all of it gives the whole run.

Before that, pairs of words that a text has fewer than three times cut it: inside a run of four periods
every pair is met three times at least, so no run is lost, and stretches under six words hold none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ragged_take, slices, split_distinct
from .near_dup import mix
from .storage import small_batches

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Rounds of Re-Pair at most; what is left then is joined by the balanced tree, with the same runs.
ROUNDS = 64
#: Candidate periods that are held at once, and the length (as a power of two) of the longest named stretches.
CANDIDATES, NAMED = 1 << 20, 12
RUN_SCHEMA = "doc_id bigint, start bigint, length bigint, period bigint"
SCHEMA = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string, n_words bigint, n_kept bigint"


@dataclass
class Grammar:
    """Rules as arrays, children before parents: symbol ``base`` + r stands for ``size[r]`` words, as from word ``first[r]`` on."""

    base: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    first: np.ndarray
    rounds: list[tuple[int, int]]
    roots: np.ndarray
    at: np.ndarray


def _every_second(chosen: np.ndarray) -> np.ndarray:
    """Of neighbouring positions, the first, third, ... of each stretch."""
    where = np.flatnonzero(chosen)
    begins = np.concatenate([[True], np.diff(where) > 1])[: len(where)]
    start = np.maximum.accumulate(np.where(begins, np.arange(len(where)), 0))
    return where[(np.arange(len(where)) - start) % 2 == 0]


def re_pair(words: np.ndarray, stretch: np.ndarray) -> Grammar:
    """A grammar whose roots, one for each stretch (numbers in ascending order), derive the words of it."""
    base = int(words.max()) + 1 if len(words) else 0
    symbol, part, at = words.astype(np.int64), stretch, np.arange(len(words))
    keys, number = np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right, size, first, rounds = ([np.zeros(0, np.int64)] for _ in range(5))
    rounds, made = [], 0

    def lengths(symbols: np.ndarray) -> np.ndarray:
        every = np.concatenate(size)
        return np.where(symbols < base, 1, every[np.maximum(symbols - base, 0)] if len(every) else 1)

    def replace(where: np.ndarray) -> None:
        nonlocal symbol, part, at, keys, number, made
        a, b = symbol[where], symbol[where + 1]
        pairs, seen, of = np.unique(a << 32 | b, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(keys, pairs), max(0, len(keys) - 1))
        known = keys[place] == pairs if len(keys) else np.zeros(len(pairs), bool)
        names = np.where(known, number[place] if len(keys) else 0, base + made + np.cumsum(~known) - 1)
        new = seen[~known]
        total = lengths(a[new]) + lengths(b[new])
        left.append(a[new]), right.append(b[new]), size.append(total), first.append(at[where[new]])
        keys, number = np.concatenate([keys, pairs[~known]]), np.concatenate([number, names[~known]])
        order = np.argsort(keys)
        keys, number = keys[order], number[order]
        rounds.append((made, made + len(new)))
        made += len(new)
        symbol = symbol.copy()
        symbol[where] = names[of]
        stays = np.ones(len(symbol), bool)
        stays[where + 1] = False
        symbol, part, at = symbol[stays], part[stays], at[stays]

    for _ in range(ROUNDS):
        inside = np.flatnonzero(part[:-1] == part[1:])
        pairs, of, count = np.unique(symbol[inside] << 32 | symbol[inside + 1], return_inverse=True, return_counts=True)
        order = np.lexsort((mix(pairs.astype(np.uint64)), count))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(1, len(pairs) + 1)
        weight = np.zeros(len(symbol) + 1, np.int64)  # of the pair that begins at a position, from 1 on; ends stay 0
        weight[inside + 1] = np.where(count > 1, rank, 0)[of]
        here = weight[1:]
        best = (here > 0) & (here >= weight[:-1]) & (here >= np.append(weight[2:], 0))
        if not best.any():
            break
        replace(_every_second(best))
    while (same := np.flatnonzero(part[:-1] == part[1:])).size:
        begins = np.concatenate([[True], part[:-1] != part[1:]])
        start = np.maximum.accumulate(np.where(begins, np.arange(len(part)), 0))
        replace(same[(same - start[same]) % 2 == 0])
    return Grammar(base, *(np.concatenate(x) for x in (left, right, size, first)), rounds, symbol, at)


class Names:
    """Names of all stretches of 1, 2, 4, ... words: equal names, equal words."""

    def __init__(self, words: np.ndarray, longest: int):
        self.levels = [words.astype(np.int32)]
        while (step := 1 << len(self.levels) - 1) * 2 <= min(longest, 1 << NAMED):
            below = self.levels[-1].astype(np.int64)
            self.levels.append(np.unique(below[:-step] << 32 | below[step:], return_inverse=True)[1].astype(np.int32))

    def _same(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool) -> np.ndarray:
        got = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.levels))):
            names, step = self.levels[k], 1 << k
            while True:
                fits = np.flatnonzero(got + step <= limit)
                shift = -got[fits] - step if back else got[fits]
                more = fits[names[i[fits] + shift] == names[j[fits] + shift]]
                got[more] += step
                if k < len(self.levels) - 1 or not len(more):
                    break
        return got

    def ahead(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words from i and j on are equal, up to a limit."""
        return self._same(i, j, limit, False)

    def behind(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many words before i and j are equal, up to a limit."""
        return self._same(i, j, limit, True)


def _crossing(words: np.ndarray, names: Names, low: np.ndarray, border: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Rows (rule, start, end, period) of the runs in words low .. high of each rule that cross its border; positions count from low."""
    found = [np.zeros((0, 4), np.int64)]
    for right in (True, False):
        room = (high - border if right else border - low) // 2
        most = np.where(high - low >= LEAST_WORDS, np.minimum(room, (high - low) // LEAST_PERIODS), 0)
        ends = np.cumsum(most)
        begin = 0
        while begin < len(most):  # rules whose candidates are held at once; one rule at least
            done = ends[begin - 1] if begin else 0
            to = max(begin + 1, int(np.searchsorted(ends, done + CANDIDATES, side="right")))
            rule = np.repeat(np.arange(begin, to), most[begin:to])
            q = ragged_take(np.ones(to - begin, np.int64), most[begin:to])
            begin = to
            b = border[rule]
            i, j = (b, b + q) if right else (b - q, b)
            edge = (words[b] == words[b + q]) if right else (words[b - 1] == words[b - 1 - q])
            rule, q, i, j = (x[edge] for x in (rule, q, i, j))
            ahead, behind = names.ahead(i, j, high[rule] - j), names.behind(i, j, i - low[rule])
            start, end = i - behind, j + ahead
            run = (end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)) & (start < border[rule]) & (end > border[rule])
            found.append(np.stack([rule, start - low[rule], end - low[rule], q], axis=1)[run])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    # A multiple of a period reaches as far: the least counts.
    least = np.ones(len(rows), bool)
    least[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[least]


def stretch_runs(words: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs inside the stretches, in word positions, by start and then period."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    g = re_pair(words, stretch)
    names = Names(words, int(np.bincount(stretch).max()))
    sizes = lambda symbols: np.where(symbols < g.base, 1, g.size[np.maximum(symbols - g.base, 0)]) if len(g.size) else np.ones(len(symbols), np.int64)
    own = _crossing(words, names, g.first, g.first + sizes(g.left), g.first + g.size)
    begin, end = np.searchsorted(own[:, 0], np.arange(len(g.size))), np.searchsorted(own[:, 0], np.arange(len(g.size)), side="right")
    holds = np.append(end > begin, False)  # words hold none
    index = lambda symbols: np.where(symbols < g.base, len(g.size), symbols - g.base)
    for lo, hi in g.rounds:
        holds[lo:hi] |= holds[index(g.left[lo:hi])] | holds[index(g.right[lo:hi])]
    symbol, at, found = g.roots, g.at, []
    while len(symbol):
        on = holds[index(symbol)]
        rule, at = symbol[on] - g.base, at[on]
        many = end[rule] - begin[rule]
        runs, shift = own[ragged_take(begin[rule], many)], np.repeat(at, many)
        found.append(np.stack([runs[:, 1] + shift, runs[:, 2] + shift, runs[:, 3]], axis=1))
        symbol, at = np.concatenate([g.left[rule], g.right[rule]]), np.concatenate([at, at + sizes(g.left[rule])])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((-rows[:, 1], rows[:, 0], rows[:, 2]))]
    # Within a period, what ends no later than something that began no later is a part of it.
    group = np.cumsum(np.concatenate([[0], np.diff(rows[:, 2]) != 0])[: len(rows)])
    reach = np.maximum.accumulate(rows[:, 1] + group * (len(words) + 1)) - group * (len(words) + 1)
    whole = np.ones(len(rows), bool)
    whole[1:] = (group[1:] != group[:-1]) | (rows[1:, 1] > reach[:-1])
    rows = rows[whole]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _stretches(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the words that may lie in runs, numbers of the stretches they form); stretches keep within a text."""
    at, part = np.arange(len(codes)), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    while len(at):
        word, many = codes[at].astype(np.int64), len(at)
        width = int(word.max()) + 1
        pairs, of, count = np.unique((part[:-1] * width + word[:-1]) * width + word[1:], return_inverse=True, return_counts=True)
        cut = (part[:-1] != part[1:]) | (np.diff(at) > 1) | (count[of] < LEAST_PERIODS - 1)
        part = np.concatenate([[0], np.cumsum(cut)])
        long = np.bincount(part)[part] >= LEAST_WORDS
        at, part = at[long], part[long]
        if len(at) > 0.9 * many:
            break
    return at, part


def text_runs(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period; ``codes`` number the words of the texts between ``offsets``."""
    at, part = _stretches(codes, offsets)
    rows = stretch_runs(codes[at], part)
    start = at[rows[:, 0]] if len(rows) else rows[:, 0]
    text = np.searchsorted(offsets, start, side="right") - 1
    return np.stack([text, start - offsets[text], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(texts with one space between words, codes of all words, offsets of each text) of an array without nulls."""
    plain = [b" ".join(t.split()) for t in texts.cast(pa.binary()).to_pylist()]
    full = np.array([bool(t) for t in plain], bool)
    starts, codes, _ = split_distinct(pa.array([t for t in plain if t], pa.binary()))
    count = np.zeros(len(plain), np.int64)
    count[full] = np.diff(starts)
    return plain, codes, np.concatenate([[0], np.cumsum(count)])


def _kept(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run holds after its first period."""
    drop = np.zeros(len(words) + 1, np.int64)
    np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
    np.add.at(drop, runs[:, 0] + runs[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run: doc_id, start (number of its first word, from 0), length and period in words.

    A run is a longest stretch of words, at least LEAST_WORDS and LEAST_PERIODS times its smallest period,
    in which words a period apart are equal; words are what blanks (space, 9 to 13) separate.  Null, empty
    and blank texts have none; repeated rows give their runs again; null ids are kept; other columns are
    not read.  No shuffle; a slice of texts, or one longer text, is held at once.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, codes, offsets = words_of(part.column(1))
            rows = text_runs(codes, offsets)
            yield pa.record_batch([part.column(0).take(pa.array(rows[:, 0])), *(pa.array(rows[:, k]) for k in (1, 2, 3))], names=["doc_id", "start", "length", "period"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, RUN_SCHEMA)


def collapse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every run in its texts reduced to its first period; texts without runs, and nulls, stay as they are.

    Where something is dropped, the words left are joined by one space.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def shorter(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for part in slices(iter([pa.record_batch([texts], names=["text"])]), 0):
                plain, codes, offsets = words_of(part.column(0))
                rows, parts = text_runs(codes, offsets), part.column(0).to_pylist()
                for text in np.unique(rows[:, 0]).tolist():
                    parts[text] = b" ".join(_kept(plain[text].split(b" "), rows[rows[:, 0] == text][:, 1:])).decode()
                out += parts
            yield pc.if_else(pc.is_valid(texts), pa.array(out, pa.string()), pa.scalar(None, pa.string()))

    return docs.withColumn(text_col, shorter(docs[text_col]))


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: how many runs a text has, the one of the greatest exponent, digests of all and of what is kept.

    Of equal exponents the run of the smallest start counts, then of the smallest period; without runs its
    columns are null.  ``collapsed_sha256`` is of the words that no run holds after its first period, joined
    by one space.  Null texts count as empty.  As find_runs for the rest.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            plain, codes, offsets = words_of(part.column(1))
            rows = text_runs(codes, offsets)
            borders = np.searchsorted(rows[:, 0], np.arange(len(plain) + 1))
            out: list[tuple] = []
            for k, (text, a, b) in enumerate(zip(plain, borders[:-1].tolist(), borders[1:].tolist())):
                n = int(offsets[k + 1] - offsets[k])
                if a == b:
                    out.append((0, None, None, None, None, hashlib.sha256().hexdigest(), hashlib.sha256(text).hexdigest(), n, n))
                    continue
                own = rows[a:b, 1:]
                start, length, period = best = own[0].tolist()
                for start, length, period in own[1:].tolist():  # by start and period, so only greater exponents win
                    if length * best[2] > best[1] * period:
                        best = [start, length, period]
                kept = _kept(text.split(b" "), own)
                listed = "".join(f"{s},{c},{q}\n" for s, c, q in own.tolist())
                out.append((b - a, *best, 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(), n, len(kept)))
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            columns = [pa.array(c, pa.string() if "sha256" in name else pa.int64()) for name, c in zip(names[1:], zip(*out))]
            yield pa.record_batch([part.column(0), *columns], names=names)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)


def repeat_tails(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with runs put into every tenth text, by h = crc32(doc_id) and g = h // 10: a test of run detection.

    Where h % 10 is 0, of the n words each word i from a = g % n on becomes word a + (i - a) % p, with
    p = 1 + (n - a) // (3 + g % 8), and one space goes between words.  Null ids and texts without words stay.
    """
    h = F.crc32(docs[id_col].cast("string"))
    tenth = h % 10 == 0

    @F.arrow_udf("string")
    def repeated(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, seeds in batches:
            out = []
            for text, g in zip(texts.cast(pa.binary()).to_pylist(), seeds.to_pylist()):
                words = text.split() if text is not None else []
                if n := len(words):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
                out.append(None if text is None else b" ".join(words).decode())
            yield pa.array(out, pa.string())

    changed = repeated(F.when(tenth, docs[text_col]), F.floor(h / 10).cast("bigint"))
    return docs.withColumn(text_col, F.when(tenth, changed).otherwise(docs[text_col]))
