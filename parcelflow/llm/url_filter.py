"""URL filter over a sorted digest array.

Rules (host, path prefix) are kept as ascending 64-bit xxhash keys of host + path, with the full strings
beside them.  The file is shipped to the executors by Spark and memory-mapped there, so all workers of a
machine share its pages.  A url's candidate keys, made of its host's suffixes and the rules' path
lengths, are probed by one vectorised binary search per batch; a hit counts only if the stored string is
the same, so collisions do no harm.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import file_system, fresh

MAGIC = b"URLKEYS2"
HEAD = struct.Struct("<8sQQQ")
SCHEMA = "page_id bigint, host string, path string, rule string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def index_bytes(rules: Iterable[tuple[str, str]]) -> bytes:
    """Rules ("allow" or "block", host + path) as path lengths | keys | string offsets | strings | verdicts.

    A rule's host is lower-cased; a rule without a path gets "/" so that it can't end inside a host.  Of
    rules given twice the last counts.
    """
    table: dict[bytes, bool] = {}
    for verdict, rule in rules:
        host, _, rest = rule.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"a rule is allow or block and a host: {verdict!r} {rule!r}")
        table[f"{host.translate(str.maketrans(UPPER, LOWER))}/{rest}".encode()] = verdict == "block"
    rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in table.items())
    strings = b"".join(k for _, k, _ in rows)
    keys = np.array([r[0] for r in rows], "<u8").tobytes()
    offsets = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8").tobytes()
    lengths = np.array(sorted({len(k) - k.index(b"/") for k in table}), "<u8")  # what has to be tried of a url's path
    return HEAD.pack(MAGIC, len(lengths), len(rows), len(strings)) + lengths.tobytes() + keys + offsets + strings + np.array([r[2] for r in rows], np.uint8).tobytes()


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            magic, m, n, size = HEAD.unpack(f.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("no url index")
        mapped = lambda kind, at, count: np.memmap(path, kind, "r", at, (count,)) if count else np.zeros(0, kind)
        self.lengths = mapped("<u8", HEAD.size, m).tolist()
        at = HEAD.size + 8 * m
        self.keys, self.offsets = mapped("<u8", at, n), mapped("<u8", at + 8 * n, n + 1)
        at += 16 * n + 8
        self.strings, self.block = mapped(np.uint8, at, size), mapped(np.uint8, at + size, n)

    def find(self, candidates: list[bytes]) -> np.ndarray:
        """Position of the rule that equals each candidate, or -1."""
        out = np.full(len(candidates), -1)
        if not len(self.keys) or not candidates:
            return out
        keys = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # keys may collide; strings don't
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == candidates[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def rule(self, j: int) -> tuple[str, str]:
        return self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes().decode(), "block" if self.block[j] else "allow"


def _distinct(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """(distinct strings as bytes, which of them each row has)."""
    coded = texts.cast(pa.binary()).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _suffixes(host: bytes) -> list[bytes]:
    """A host and the domains above it; none of an empty host."""
    parts = host.split(b".")
    return [b".".join(parts[i:]) for i in range(len(parts))] if host else []


_indexes: dict[str, Index] = {}


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule (or null) and verdict.

    The host is what stands between the first "://" and "/", "?", "#" or the end, A-Z lower-cased; the
    path goes on to "?", "#" or the end.  A null url or one without "://" has both empty and gets the
    default verdict, as has a url that no rule fits.  A rule fits its host and all its subdomains if the
    path starts with the rule's; the longest rule wins, of two as long the one with the longer host.
    Null ids and repeated rows are kept; other columns are not read.  No shuffle.
    """
    spark = pages.sparkSession
    data = index_bytes(rules)
    name = f"url-index-{hashlib.sha256(data).hexdigest()[:16]}"
    if not os.path.exists(SparkFiles.get(name)):
        path = f"{fresh(spark, 'urls')}/{name}"
        system, at = file_system(path)
        system.create_dir(at.rpartition("/")[0])
        with system.open_output_stream(at) as out:
            out.write(data)
        spark.sparkContext.addFile(path)

    rest = F.when(F.instr("url", "://") > 0, F.substring_index(F.substring(F.col("url"), F.instr("url", "://") + 3, F.length("url")), "#", 1)).otherwise("")
    rest = F.substring_index(rest, "?", 1)
    host = F.substring_index(rest, "/", 1)
    split = pages.select(pages[id_col].cast("bigint").alias("page_id"), F.coalesce(pages[url_col], F.lit("")).alias("url"))
    split = split.select("page_id", rest.alias("rest"), host.alias("raw")).select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.expr("substring(rest, length(raw) + 1)").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _indexes.get(name) or _indexes.setdefault(name, Index(SparkFiles.get(name)))
        for batch in batches:
            hosts, of_host = _distinct(batch.column(1))
            paths, of_path = _distinct(batch.column(2))
            # Each distinct host's suffixes and each distinct path's heads once; then each distinct pair of both.
            suffixes = [_suffixes(h) for h in hosts]
            heads = [[p[:n] for n in index.lengths if n <= len(p)] for p in paths]
            pairs, of_pair = np.unique(of_host * max(1, len(paths)) + of_path, return_inverse=True)
            candidates: dict[bytes, int] = {}
            owners, numbers, hosts_len = [], [], []
            for k, pair in enumerate(pairs.tolist()):
                h, p = divmod(pair, max(1, len(paths)))
                for host in suffixes[h]:
                    for head in heads[p]:
                        owners.append(k)
                        numbers.append(candidates.setdefault(host + head, len(candidates)))
                        hosts_len.append(len(host))
            texts = list(candidates)
            found = index.find(texts)[numbers] if numbers else np.zeros(0, np.int64)
            best: dict[int, tuple[int, int, int]] = {}
            for i in np.flatnonzero(found >= 0).tolist():
                mine = (len(texts[numbers[i]]), hosts_len[i], int(found[i]))
                best[owners[i]] = max(best.get(owners[i], (-1, -1, -1)), mine)
            hits = [index.rule(best[k][2]) if k in best else (None, default) for k in range(len(pairs))]
            rule, verdict = (pa.array([h[j] for h in hits], pa.string()).take(pa.array(of_pair)) for j in (0, 1))
            yield pa.record_batch([*batch.columns, rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, SCHEMA)
