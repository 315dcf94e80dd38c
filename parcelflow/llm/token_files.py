"""Token ids in seekable binary files.

A file is a row of independent zstandard frames, each with the ids of some whole documents and a content
checksum, and a seek table at its end.  A reader takes the tail, finds the frame of a document by binary
search, and decompresses that frame only.

Layout (little-endian): frames | table (frames x [first entry u64, byte offset u64, byte length u32,
ids u32, xxh64 of the frame's bytes u64]) | entries (documents x [doc_id i64, ids before it in the file
u64, ids u32, 1 if there is an id u8]) | tail [entries u64, frames u64, id width u32, xxh64 of table and
entries u64, magic 8s].  Entries stand in the order written, which is ascending doc_id, those without one first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ragged_take, slices, split_distinct, sums
from .storage import file_system, fresh, partitions, small_batches, stored

MAGIC = b"TOKSEEK2"
TAIL = struct.Struct("<QQIQ8s")
FRAME = np.dtype([("entry", "<u8"), ("at", "<u8"), ("size", "<u4"), ("ids", "<u4"), ("check", "<u8")])
ENTRY = np.dtype([("doc_id", "<i8"), ("start", "<u8"), ("ids", "<u4"), ("has_id", "u1")])
#: Ids after which a frame is closed; a longer document is a frame of its own.
FRAME_IDS = 1 << 16
#: Forms of words remembered by one Python worker; when full, the memory before it goes and those still met move on.
REMEMBERED = 300_000
#: Ids after which a file is closed and the next one begun.
FILE_IDS = 8 << 20
#: Words that go through the library as one text, and the last letter they may have for that.
TOGETHER, LATIN_END = 256, "\u024f"
#: Text bytes encoded at once.
ENCODE_BYTES = 6 << 20
MANIFEST = "bucket int, part int, path string, n_docs bigint, n_ids bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class Writer:
    """Appends documents to one file; ids are stored in 16 bits where the vocabulary allows it."""

    def __init__(self, out, width: int = 4):
        self.out, self.width = out, width
        self.at = self.ids = self.waiting = 0
        self.frames: list[tuple] = []
        self.entries: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.first = self.n = 0
        self.press = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)

    def add(self, doc_ids: np.ndarray, has_id: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        """Documents in order; ids[offsets[i]:offsets[i+1]] are those of document i."""
        at, n = 0, len(doc_ids)
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + FRAME_IDS - self.waiting, side="right")) - 1)
            entry = np.zeros(to - at, ENTRY)
            entry["doc_id"], entry["has_id"], entry["ids"] = doc_ids[at:to], has_id[at:to], np.diff(offsets[at : to + 1])
            entry["start"] = self.ids + offsets[at:to] - offsets[at]
            self.entries.append(entry)
            self.parts.append(ids[offsets[at] : offsets[to]].astype(f"<u{self.width}"))
            self.waiting += int(offsets[to] - offsets[at])
            self.ids += int(offsets[to] - offsets[at])
            self.n += to - at
            at = to
            if self.waiting >= FRAME_IDS or at < n:
                self._close_frame()

    def _close_frame(self) -> None:
        if self.n > self.first:
            frame = self.press.compress(np.concatenate(self.parts).tobytes())
            self.frames.append((self.first, self.at, len(frame), self.waiting, xxhash.xxh64_intdigest(frame)))
            self.out.write(frame)
            self.at += len(frame)
            self.first, self.waiting, self.parts = self.n, 0, []

    def close(self) -> None:
        self._close_frame()
        index = np.array(self.frames, FRAME).tobytes() + (np.concatenate(self.entries).tobytes() if self.entries else b"")
        self.out.write(index + TAIL.pack(self.n, len(self.frames), self.width, xxhash.xxh64_intdigest(index), MAGIC))


class Reader:
    """Reads documents of one file by position or by doc_id."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if size < TAIL.size:
            raise ValueError("no token file: too short")
        file.seek(size - TAIL.size)
        n, frames, self.width, check, magic = TAIL.unpack(file.read(TAIL.size))
        length = frames * FRAME.itemsize + n * ENTRY.itemsize
        if magic != MAGIC or length + TAIL.size > size:
            raise ValueError("no token file: bad tail")
        file.seek(size - TAIL.size - length)
        index = file.read(length)
        if xxhash.xxh64_intdigest(index) != check:
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(index[: frames * FRAME.itemsize], FRAME)
        self.entries = np.frombuffer(index[frames * FRAME.itemsize :], ENTRY)

    def frame(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries, ids) of frame i, after its checksum held."""
        f = self.frames[i]
        self.file.seek(int(f["at"]))
        raw = self.file.read(int(f["size"]))
        if xxhash.xxh64_intdigest(raw) != int(f["check"]):
            raise ValueError(f"frame {i} is damaged")
        to = int(self.frames[i + 1]["entry"]) if i + 1 < len(self.frames) else len(self.entries)
        ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), f"<u{self.width}")
        if len(ids) != int(f["ids"]):
            raise ValueError(f"frame {i} has {len(ids)} ids; the table says {f['ids']}")
        return self.entries[int(f["entry"]) : to], ids

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every entry of a document; only the frames that hold it are decompressed."""
        none = int(np.searchsorted(self.entries["has_id"], 1))
        lo, hi = (none + int(np.searchsorted(self.entries["doc_id"][none:], doc_id, side=s)) for s in ("left", "right"))
        out, held = [], {}
        for e in range(lo, hi):
            i = int(np.searchsorted(self.frames["entry"], e, side="right")) - 1
            entries, ids = held.get(i) or held.setdefault(i, self.frame(i))
            at = int(self.entries[e]["start"] - entries[0]["start"])
            out.append(ids[at : at + int(self.entries[e]["ids"])])
        return out


class ChunkEncoder:
    """Ids of texts by the tokenizers library.

    For a tokenizer that lower-cases and whose pre-tokenizer drops white space, a text's ids are those of
    its chunks between white space.  A chunk of plain Latin letters is looked up in lower case, and the
    marks behind its last letter or digit, where a pre-token ends, by themselves.  Each distinct form goes
    through the library once and is remembered; Latin forms go many at a time, with a letter of another
    script between them whose one id tells them apart again.
    """

    LATIN = r"^[\x21-\x7e\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]*$"
    MARKS = ".,!?;:%*#&$"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        a, b = (self.model.encode(x, add_special_tokens=False).ids for x in ("it's one, Two%%%", "IT'S   oNe ,\nTWO %%%"))
        if a != b:
            raise ValueError("the tokenizer keeps white space or case: texts can't be encoded chunk by chunk")
        self.width = 2 if self.model.get_vocab_size() <= 1 << 16 else 4
        self.between = next(((c, i[0]) for c in "日人大の中и" if len(i := self.model.encode(c, add_special_tokens=False).ids) == 1 and self.model.encode(f"it's {c} one", add_special_tokens=False).ids == [*self.model.encode("it's", add_special_tokens=False).ids, *i, *self.model.encode("one", add_special_tokens=False).ids]), None)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _looked_up(self, forms: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        known.update((w, older[w]) for w in forms if w not in known and w in older)
        new = list(dict.fromkeys(w for w in forms if w not in known))
        kind = np.dtype(f"<u{self.width}")
        plain = [w for w in new if (w.isascii() or max(w) <= LATIN_END) and "<" not in w] if self.between else []
        if plain:
            letter, mark = self.between
            parts = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
            for words, e in zip(parts, self.model.encode_batch_fast([f" {letter} ".join(p) for p in parts], add_special_tokens=False)):
                ids = np.array([*e.ids, mark], kind)
                cut = np.flatnonzero(ids == mark)
                raw, ends = ids.tobytes(), (cut * self.width).tolist()
                known.update(zip(words, (raw[x:y] for x, y in zip([0, *(e + self.width for e in ends)], ends)), strict=True))
            new = [w for w in new if w not in known]
        if new:
            known.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False)))
        return [known[w] for w in forms]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of an array without nulls; ``end`` is appended to each text."""
        offsets, codes, words = split_distinct(pc.replace_substring(texts, "\n", " "))
        plain = pc.and_(pc.match_substring_regex(words, self.LATIN), pc.invert(pc.match_substring(words, "<|")))
        words = pc.if_else(plain, pc.utf8_lower(words), words)
        marked = pc.and_(plain, pc.match_substring_regex(words, rf"[a-z0-9\x{{e0}}-\x{{f6}}\x{{f8}}-\x{{ff}}][{self.MARKS}]+$"))
        bodies = pc.if_else(marked, pc.ascii_rtrim(words, self.MARKS), words).dictionary_encode()
        tails = pc.if_else(marked, pc.replace_substring_regex(words, rf"(?s)^.*[^{self.MARKS}]", ""), "").dictionary_encode()
        body, tail = (self._looked_up(x.dictionary.to_pylist()) for x in (bodies, tails))
        ids = [body[i] + tail[j] for i, j in zip(bodies.indices.to_pylist(), tails.indices.to_pylist())]
        sizes = np.array([len(x) for x in ids], np.int64) // self.width
        table = np.frombuffer(b"".join(ids), f"<u{self.width}")
        starts = np.cumsum(sizes) - sizes
        flat, lengths = table[ragged_take(starts[codes], sizes[codes])], sums(sizes[codes], offsets)
        ends = np.cumsum(lengths)
        if end is not None:
            flat = np.insert(flat, ends, end)
            lengths = lengths + 1
            ends = np.cumsum(lengths)
        return flat, np.concatenate([[0], ends])


_encoders: dict[str, ChunkEncoder] = {}


def write_token_files(docs: DataFrame, tokenizer: str, out: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text and write files in ascending doc_id order; returns the manifest (bucket, part, path, n_docs, n_ids).

    Spark deals the documents over ranges of doc_id by its sampled bounds, and a task cuts its range into
    files of ``file_ids`` ids, about, so the files in order of bucket and part hold ascending ids.  Rows
    with the same id stand side by side in the order of the input, and may be split over ranges, however
    many they are.  A null text counts as empty; rows with a null id come first.  Other columns are not
    read.  One shuffle (of ids and texts, by range).  A task that runs again writes files of new names;
    the manifest names those that count.
    """
    small_batches(docs.sparkSession, ENCODE_BYTES)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("place"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        coder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, ChunkEncoder(tokenizer))
        bucket, writer, done = TaskContext.get().partitionId(), None, []
        for part in slices(batches, limit=ENCODE_BYTES):
            ids, offsets = coder.encode(part.column(1), end)
            has_id = part.column(0).is_valid().to_numpy(zero_copy_only=False)
            doc_ids = pc.fill_null(part.column(0), 0).to_numpy()
            at = 0
            while at < len(doc_ids):
                if writer is None:
                    path = f"{out}/{bucket:06d}-{len(done):04d}-{uuid.uuid4().hex}.tok"
                    system, where = file_system(path)
                    system.create_dir(where.rpartition("/")[0])
                    file = system.open_output_stream(where)
                    writer = Writer(file, coder.width)
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + file_ids - writer.ids, side="right")) - 1)
                writer.add(doc_ids[at:to], has_id[at:to], ids, offsets[at : to + 1])
                at = to
                if writer.ids >= file_ids or at < len(doc_ids):
                    writer.close()
                    file.close()
                    done.append((path, writer.n, writer.ids))
                    writer = None
        if writer:
            writer.close()
            file.close()
            done.append((path, writer.n, writer.ids))
        for i, (path, n, ids) in enumerate(done):
            yield pa.record_batch([pa.array([bucket], pa.int32()), pa.array([i], pa.int32()), pa.array([path]), pa.array([n]), pa.array([ids])], names=[c.split()[0] for c in MANIFEST.split(", ")])

    laid = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("place")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "place").select("doc_id", "text")
    return stored(laid.mapInArrow(run, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    The crc32 is that of the ids as little-endian unsigned 32-bit integers; frames are read one at a time
    and their checksums verified.  An empty manifest gives no rows.
    """
    # Ids before a file: those before its bucket (one row per task that wrote) and before it in the bucket.
    totals = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("ids"))
    earlier = totals.select("bucket", (F.sum("ids").over(Window.orderBy("bucket")) - F.col("ids")).alias("earlier"))
    within = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("part")) - F.col("n_ids")
    placed = manifest.withColumn("within", within).join(earlier, "bucket").select("path", (F.col("earlier") + F.col("within")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = file_system(path)
                with system.open_input_file(at) as file:
                    reader = Reader(file)
                    for i in range(len(reader.frames)):
                        entries, ids = reader.frame(i)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        starts = (entries["start"] - entries["start"][0]).astype(np.int64) * 4
                        ends = starts + entries["ids"].astype(np.int64) * 4
                        crc = [zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
                        yield pa.record_batch(
                            [pa.array(entries["doc_id"], mask=entries["has_id"] == 0), pa.array(base + entries["start"].astype(np.int64)), pa.array(entries["ids"].astype(np.int64)), pa.array(crc, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return placed.repartition(partitions(manifest.sparkSession)).mapInArrow(run, READ)


def token_file_index(docs: DataFrame, tokenizer: str, end: int | None = None, **names) -> DataFrame:
    """write_token_files to the shared folder, then read_token_files."""
    return read_token_files(write_token_files(docs, tokenizer, fresh(docs.sparkSession, "token-files"), end, **names))
