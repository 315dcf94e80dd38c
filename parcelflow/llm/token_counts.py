"""Token counts with a whole-token shortcut.

Offline proof: a vocabulary piece that starts with the word mark and that the library encodes, alone, as
one token is a *whole token*.  No piece holds a word mark after another character, so no merge crosses
the start of a word and every word of a text can be counted by itself.  Words that are whole tokens
count 1 straight away; only the other distinct words go through the library's merges, once per slice
and remembered between slices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .chunks import SLICE_BYTES, slices, split_distinct, sums
from .storage import small_batches

MARK = "▁"
#: Words remembered by one Python worker; when full, the memory starts anew.
REMEMBERED = 400_000
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


class PieceCounter:
    """Counts the tokens of texts as ``SentencePieceProcessor.encode`` gives them for an identity-normalised BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if MARK not in pieces or any(MARK in p.lstrip(MARK) for p in pieces) or self.model.encode("a  b", out_type=str)[0][:1] != MARK:
            raise ValueError("the model joins words or lacks the word mark: words can't be counted one by one")
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and p[1] != MARK]
        self.whole = pa.array([w for w, ids in zip(words, self.model.encode(words)) if len(ids) == 1], pa.string())
        self.known: dict[str, int] = {}

    def _merged(self, words: list[str]) -> list[int]:
        """Counts of words, each standing for itself behind one word mark; "" is a lone mark."""
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = words
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
            known[""] = 1  # the mark alone is a piece; the library gives nothing for an empty text
        return [known[w] for w in words]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an array without nulls."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        odd = pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        out = np.zeros(len(texts), np.int64)
        if not odd.all():
            offsets, codes, words = split_distinct(texts.filter(pa.array(~odd)))
            whole = pc.is_in(words, value_set=self.whole).to_numpy(zero_copy_only=False)
            each = np.ones(len(words), np.int64)
            each[~whole] = self._merged(words.filter(pa.array(~whole)).to_pylist())
            out[~odd] = sums(each[codes], offsets)
        for i in np.flatnonzero(odd):
            if text := texts[int(i)].as_py():
                marked = re.findall(" +[^ ]*", " " + text.replace(MARK, " "))
                out[i] = sum(self._merged([m[1:] for m in marked]))
        return out


_counters: dict[str, PieceCounter] = {}


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows are kept as they are;
    other columns are not read.  No shuffle: each row is counted where it is scanned.
    """
    small_batches(docs.sparkSession, SLICE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model_file) or _counters.setdefault(model_file, PieceCounter(model_file))
        for part in slices(batches):
            n = counter.counts(part.column(1))
            size = pc.binary_length(part.column(1)).cast(pa.int64())
            yield pa.record_batch([part.column(0), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
