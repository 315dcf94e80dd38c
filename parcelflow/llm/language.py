"""Language identification by mixtures of languages.

Counts of byte trigrams in words, by language and over all texts that are learned from, give each word a
likelihood under each language: the product of its trigrams' shares, mixed with those of all languages
together and tempered, as trigrams overlap.  A document is a mixture of languages: each of its words
comes from one of them, with proportions that expectation-maximisation fits.  The set of languages grows
from the one that explains the document best: the language along which the likelihood rises most is
added, proportions are fitted anew, and it stays if the likelihood has risen by more than the penalty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import byte_view, slices, split_distinct, sums
from .storage import small_batches

#: Trigrams are counted in so many cells by a hash, so a model holds so many numbers a language.
CELLS = 1 << 18
#: Weight of all languages' shares in each language's; power that tempers overlapping trigrams.
MIXED, TEMPER = 0.02, 1 / 3
#: A further language has to raise the log-likelihood by so many times log(1 + words), and by a constant.
PENALTY, AT_LEAST = 2.0, 2.0
#: Steps of expectation-maximisation at most, and the change of a proportion that ends it.
STEPS, SETTLED = 40, 1e-3
#: The language of texts without letters.
UNDETERMINED = "und"
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, languages array<struct<lang: string, share: double>>"
_LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


@dataclass
class Words:
    """Words of texts: codes between offsets, and of each distinct word its trigrams' cells between ``begin``; words without letters have none."""

    offsets: np.ndarray
    codes: np.ndarray
    cells: np.ndarray
    begin: np.ndarray


def words_of(texts: pa.Array) -> Words:
    """Split an array without nulls at blanks; what isn't a letter or its mark counts as a blank inside words."""
    offsets, codes, chunks = split_distinct(pc.replace_substring_regex(texts, r"[\s\x{85}\p{Z}]", " "))
    clean = pc.utf8_lower(pc.utf8_trim(pc.replace_substring_regex(chunks, r"[^\p{L}\p{M}]+", " "), " "))
    clean = pc.if_else(pc.match_substring_regex(clean, r"\p{L}"), clean, "")
    framed = pc.binary_join_element_wise("", clean, "", " ")
    data, begin = byte_view(framed)
    x = data.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)
    cell = (code * np.uint32(0x9E3779B1) >> np.uint32(14)).astype(np.int32)
    # The trigrams that begin in a word and end in it: all but its last two bytes; a lone frame has none.
    count = np.where(np.diff(begin) > 2, np.diff(begin) - 2, 0)
    inside = np.ones(len(data), bool)
    inside[begin[1:] - 1] = False
    inside[np.maximum(begin[1:] - 2, 0)] = False
    return Words(offsets, codes, cell[inside[: len(cell)]], np.concatenate([[0], np.cumsum(count)]))


def count_trigrams(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, cell, n) over all rows with a language and a text; summed in tasks first, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs = part.column(0).dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            w = words_of(part.column(1))
            many, lang = len(w.begin) - 1, np.repeat(of, np.diff(w.offsets))
            for k in range(len(names)):
                weight = np.bincount(w.codes[lang == k], minlength=many)
                n = np.bincount(w.cells, np.repeat(weight, np.diff(w.begin)), minlength=CELLS)
                seen = np.flatnonzero(n)
                yield pa.record_batch([pa.repeat(names[k], len(seen)), pa.array(seen.astype(np.int32)), pa.array(n[seen].astype(np.int64))], names=["lang", "cell", "n"])

    rows = docs.select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text")).where("lang is not null and text is not null")
    return rows.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages and the tempered log-shares of cells, one row a cell."""

    langs: list[str]
    log_share: np.ndarray

    @classmethod
    def of(cls, counts: DataFrame) -> Model:
        """From (lang, cell, n): CELLS numbers a language come to the driver, however large the corpus is."""
        got = counts.toPandas()
        langs = sorted(got["lang"].unique())
        n = np.zeros((CELLS, len(langs)))
        n[got["cell"].to_numpy(np.int64), np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else []] = got["n"]
        total = n.sum(axis=0)
        share, whole = n / np.maximum(total, 1), (n / np.maximum(total, 1)).sum(axis=1, keepdims=True) / max(1, len(langs))
        mixed = (1 - MIXED) * share + MIXED * (0.999 * whole + 0.001 / CELLS)
        return cls(list(map(str, langs)), (TEMPER * np.log(mixed)).astype(np.float32))

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        """(language, score, languages with their shares) of each text of an array without nulls.

        The score is the share of the language times how sure it is as the only one.
        """
        w, k = words_of(texts), len(self.langs)
        trigrams = np.diff(w.begin)
        some = trigrams[w.codes] > 0
        count = sums(some.astype(np.int64), w.offsets)
        names, score, shares = [UNDETERMINED] * len(texts), np.zeros(len(texts)), [[] for _ in range(len(texts))]
        told = np.flatnonzero(count > 0)
        if not k or not len(told):
            return names, score, shares
        each = np.zeros((len(trigrams), k), np.float32)
        full = np.flatnonzero(trigrams)
        each[full] = np.add.reduceat(self.log_share[w.cells], w.begin[full], axis=0)
        codes, n = w.codes[some], count[told]
        begin = np.concatenate([[0], np.cumsum(n)])
        theta = self._mixtures(each, codes, begin)
        alone = np.add.reduceat(each[codes].astype(float), begin[:-1], axis=0)
        sure = np.exp(alone - alone.max(axis=1, keepdims=True))
        sure /= sure.sum(axis=1, keepdims=True)
        best = theta.argmax(axis=1)
        rows = np.arange(len(told))
        for row, text, lang, value in zip(rows.tolist(), told.tolist(), best.tolist(), (theta[rows, best] * sure[rows, best]).tolist()):
            names[text], score[text] = self.langs[lang], value
            shares[text] = [{"lang": self.langs[j], "share": float(theta[row, j])} for j in np.argsort(-theta[row], kind="stable") if theta[row, j] > 0]
        return names, score, shares

    @staticmethod
    def _mixtures(each: np.ndarray, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Proportions (text, language) of the chosen languages; ``each`` has the words' log-likelihoods, ``codes`` the words between ``begin``."""
        texts, k = len(begin) - 1, each.shape[1]
        n = np.diff(begin).astype(float)
        top = each.max(axis=1, keepdims=True)
        near = np.exp(each - top)  # up to a factor for each word, which no comparison of mixtures feels
        alone = np.add.reduceat((each - top)[codes].astype(float), begin[:-1], axis=0)
        theta = np.zeros((texts, k))
        rows = np.arange(texts)
        theta[rows, alone.argmax(axis=1)] = 1.0
        value = alone.max(axis=1)
        penalty = AT_LEAST + PENALTY * np.log1p(n)
        active = rows[value + penalty < 0]  # no mixture rises over 0, where each word has its best language
        while len(active):
            words, at = Model._of(active, begin)
            p = near[codes[words]]
            many, of = n[active], np.repeat(np.arange(len(active)), np.diff(at))
            now = theta[active]
            dense = np.maximum((p * now[of]).sum(axis=1, keepdims=True), 1e-30)
            slope = np.add.reduceat(p / dense, at[:-1], axis=0)
            slope[now > 0] = -1
            added = slope.argmax(axis=1)
            rises = slope.max(axis=1) > many  # the likelihood is concave in the proportions: else it can't rise along any
            start = now * 0.7
            start[np.arange(len(active)), added] += 0.3
            fitted, likely = Model._fit(p, at, of, start, rises)
            better = rises & (likely > value[active] + penalty[active])
            theta[active[better]], value[active[better]] = fitted[better], likely[better]
            active = active[better & ((fitted > 0).sum(axis=1) < k)]
        return theta

    @staticmethod
    def _of(rows: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of some texts, where each text's begin among them)."""
        n = begin[rows + 1] - begin[rows]
        at = np.concatenate([[0], np.cumsum(n)])
        return np.arange(at[-1]) + np.repeat(begin[rows] - at[:-1], n), at

    @staticmethod
    def _fit(p: np.ndarray, at: np.ndarray, of: np.ndarray, theta: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, log-likelihoods) after expectation-maximisation from ``theta``, of the wanted texts; others keep theirs, at minus infinity."""
        theta, likely = theta.copy(), np.full(len(theta), -np.inf)
        moving = np.flatnonzero(wanted)
        for step in range(STEPS):
            if not len(moving):
                break
            if step == 0 or len(moving) < len(now):
                words, begin = Model._of(moving, at)
                q, which = p[words], np.repeat(np.arange(len(moving)), np.diff(begin))
            now = theta[moving]
            part = q * now.astype(np.float32)[which]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            new = np.add.reduceat(part, begin[:-1], axis=0) / np.diff(begin)[:, None]
            new[new < 1e-6] = 0
            new /= new.sum(axis=1, keepdims=True)
            theta[moving] = new
            moving = moving[np.abs(new - now).max(axis=1) > SETTLED]
        done = np.flatnonzero(wanted)
        if len(done):
            words, begin = Model._of(done, at)
            dense = (p[words] * theta[done].astype(np.float32)[np.repeat(np.arange(len(done)), np.diff(begin))]).sum(axis=1)
            likely[done] = np.add.reduceat(np.log(np.maximum(dense, 1e-30)).astype(float), begin[:-1])
        return theta, likely


def held_out(id_col: str = "doc_id"):
    """True for rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1) and all languages with their shares.

    Learned from the rows with a language and a text whose crc32(doc_id) mod 3 is 0 or 2; rows with a null
    id aren't learned from.  A null text, or one without letters, is "und" with score 0 and no languages;
    so is every text if no language was learned.  Repeated rows are kept, and count as often when learned
    from; other columns are not read.  Equal texts get the same result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    model = Model.of(count_trigrams(rows.where(~held_out() & F.col("doc_id").isNotNull())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=2):
            names, score, shares = model.predict(part.column(2))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(shares, _LANGUAGES)], names=["doc_id", "held_out", "lang_pred", "score", "languages"])

    return rows.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)
