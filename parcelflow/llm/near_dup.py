"""Near-duplicate classes by DartMinHash.

The shingles of a text are elements, how often each stands there is its weight.  Hashed darts are thrown
at each element's region of weight x rank: a dart's place depends on the element and the dart's number
alone, and it counts if it falls below the element's weight.  About k ln k + 2k darts hit per text,
whatever its length; each has a coordinate, and the earliest dart of each of the k coordinates makes the
signature.  Two signatures agree in a coordinate with the probability of the weighted Jaccard similarity.

Signatures are joined in bands.  In a band's bucket every text is compared with its least text (stars, not
all pairs) on all of its shingles, which are told apart by 64-bit hashes.  Where a bucket then still
holds different classes, the texts outside the main one meet two further leaders.  What is
left meets the texts of other classes in its bucket, under an exact bound of what the two can share, so
texts that merely have much in common are told apart without their shingles.  No candidate of different
classes is left out.  Classes are connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import byte_view, slices, split_distinct, sums
from .storage import Scratch, free_name, small_batches

WORDS, SIMILARITY = 5, 0.8
#: 24 bands of 5: a pair at similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^5)^24 = 0.9999.
BANDS, ROWS = 24, 5
#: Candidate ids that are broadcast at most; beyond that they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rounds in which texts outside their bucket's main class meet two further leaders, before the rest is compared in full.
LEADER_ROUNDS = 1
#: Groups of hashes in which shared shingles are counted to bound an overlap.
GROUPS = 64
#: Parts that the pairs of one leader are dealt over; its shingles are sent once to each.
LEADER_PARTS = 32
#: Darts thrown at once where elements are few.
DARTS = 1 << 15
#: Text bytes shingled at once.
STEP = 2 << 20
SIGNATURES = "doc_id bigint, digest binary, bands array<bigint>"
_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of 64-bit integers."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(texts: pa.Array, width: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each, hash, count) of the distinct word shingles, ordered by text and hash.

    Words stand between white space, in lower case; a text of fewer words than a shingle is one shingle.
    """
    flat = pc.replace_substring_regex(texts, r"[\s\x{85}\p{Z}]", " ")
    offsets, codes, words = split_distinct(flat)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(str.lower, words.to_pylist())), np.uint64, len(words))
    full = (pc.binary_length(words).to_numpy(zero_copy_only=False) > 0)[codes]
    of = np.repeat(np.arange(len(texts)), np.diff(offsets))[full]
    h = hashes[codes[full]]
    n = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n) - n
    # Position in the text and words left from there decide where a shingle starts.
    left = n[of] - (np.arange(len(of)) - first[of])
    start = (left >= width) | ((n[of] < width) & (left == n[of]))
    value, at = np.zeros(len(h), np.uint64), np.flatnonzero(start)
    for j in range(min(width, len(h))):
        value[: len(h) - j] = mix(value[: len(h) - j] * _M1 + h[j:])
    value, size = value[at], np.minimum(width, n[of[at]])
    short = np.flatnonzero(size < width)
    value[short] = 0
    for j in range(width):
        short = short[size[short] > j]
        value[short] = mix(value[short] * _M1 + h[at[short] + j])
    of = of[at]
    order = np.argsort(value)
    order = order[np.argsort(of[order].astype(np.min_scalar_type(len(texts))), kind="stable")]
    of, value = of[order], value[order]
    new = np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1])) if len(of) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return of[at], value[at], np.diff(np.append(at, len(of)))


def dart_sketch(of: np.ndarray, elements: np.ndarray, weights: np.ndarray, texts: int, k: int = BANDS * ROWS) -> np.ndarray:
    """Signatures [texts, k] of weighted elements; a text without elements gets zeros.

    Weights are cut into regions [0, 1), [1, 2), [2, 4), ...; the darts of an element's region come at
    ranks of a Poisson process, uniform over the region's weights.  A text whose darts leave a coordinate
    empty throws on to twice the rank; darts thrown before stay the same.
    """
    out = np.zeros((texts, k), np.uint64)
    total = np.bincount(of, weights, texts)
    pending = np.flatnonzero(total > 0)
    reach = np.zeros(texts)
    reach[pending] = (k * np.log(k) + 2 * k) / total[pending]
    weights = weights.astype(float)
    scale = 1.0 / (1 << 53)
    while len(pending):
        busy = np.zeros(texts, bool)
        busy[pending] = True
        use = busy[of]
        got_of, got_rank, got_id = [], [], []
        low, high, level = 0.0, 1.0, 0
        e_of, e_h, e_w = of[use], elements[use], weights[use]
        while len(e_of):
            rank, seed, number = np.zeros(len(e_of)), mix(e_h ^ np.uint64(level)), 0
            t_of, t_w, limit = e_of, e_w, reach[e_of]
            while len(t_of):
                # Few elements throw many darts at once, so that texts of few words take few rounds too.
                many = int(min(max(1, DARTS // len(t_of)), np.max(limit - rank) * (high - low) + 8))
                dart = mix(seed[:, None] ^ np.arange(number + 1, number + many + 1, dtype=np.uint64))
                number += many
                ranks = np.log(((dart >> np.uint64(11)).astype(float) + 0.5) * scale) / (low - high)
                ranks[:, 0] += rank
                ranks = np.cumsum(ranks, axis=1)
                row, column = np.nonzero(ranks < limit[:, None])
                dart, thrown = dart[row, column], ranks[row, column]
                place = low + (mix(dart ^ _M1) >> np.uint64(11)).astype(float) * scale * (high - low)
                hit = place < t_w[row]
                got_of.append(t_of[row[hit]])
                got_rank.append(thrown[hit])
                got_id.append(mix(dart[hit] ^ _M2))
                rank = ranks[:, -1]
                go = rank < limit
                t_of, t_w, limit, rank, seed = t_of[go], t_w[go], limit[go], rank[go], seed[go]
            low, high, level = high, high * 2, level + 1
            more = e_w > low
            e_of, e_h, e_w = e_of[more], e_h[more], e_w[more]
        d_of, d_rank, d_id = np.concatenate(got_of), np.concatenate(got_rank), np.concatenate(got_id)
        cell = d_of * k + (d_id % np.uint64(k)).astype(np.int64)
        best = np.full(texts * k, np.inf)
        np.minimum.at(best, cell, d_rank)
        done = busy & np.isfinite(best).reshape(texts, k).all(axis=1)
        keep = np.flatnonzero((d_rank == best[cell]) & done[d_of])
        out.reshape(-1)[cell[keep]] = d_id[keep]
        pending = np.flatnonzero(busy & ~done)
        reach[pending] *= 2
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key for each band of each signature."""
    rows = sketch.shape[1] // bands
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sketch), 1))
    for r in range(rows):
        keys = mix(keys * _M1 + sketch[:, r::rows][:, :bands])
    return keys


def signatures(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, digest of the text and band keys (none for a text without words) of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=STEP):
            texts = part.column(1)
            of, h, n = shingles(texts)
            keys = band_keys(dart_sketch(of, h, n if weighted else np.ones(len(n)), len(texts))).view(np.int64)
            has = np.bincount(of, minlength=len(texts)) > 0
            data, at = byte_view(texts)
            digest = [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * BANDS)]), pa.int32()), pa.array(keys[has].ravel()))
            yield pa.record_batch([part.column(0), pa.array(digest, pa.binary()), lists], names=["doc_id", "digest", "bands"])

    return docs.mapInArrow(run, SIGNATURES)


def _sets(texts: DataFrame, weighted: bool) -> DataFrame:
    """node and its shingles (ascending 64-bit hashes, and their counts unless all are 1) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=STEP):
            of, h, n = shingles(part.column(1))
            cut = np.searchsorted(of, np.arange(len(part.column(1)) + 1)).tolist()
            blobs = [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            counts = [n[a:b].astype(np.uint32).tobytes() if weighted and (n[a:b] > 1).any() else b"" for a, b in zip(cut, cut[1:])]
            yield pa.record_batch([part.column(0), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], names=["node", "h", "n"])

    return texts.mapInArrow(run, "node bigint, h binary, n binary")


def _set_arrays(h: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, weights, offsets of each set) of columns that _sets made."""
    sizes = pc.binary_length(h).to_numpy(zero_copy_only=False).astype(np.int64) // 8
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    weights = np.ones(int(offsets[-1]), np.int64)
    for i in np.flatnonzero(pc.binary_length(n).to_numpy(zero_copy_only=False)).tolist():
        weights[offsets[i] : offsets[i + 1]] = np.frombuffer(n[i].as_buffer(), np.uint32)
    return np.frombuffer(b"".join(h.to_pylist()), np.uint64), weights, offsets


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b and lead, which is one of the two): their similarity is at least ``similarity``.

    A leader's shingles go once to each part of its pairs and stand before them there, so they aren't
    copied for every pair and a leader of many is no one task's work.
    """
    node = F.when(F.col("lead") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    dealt = pairs.select("lead", node.alias("node"), F.pmod(F.xxhash64("a", "b"), F.lit(LEADER_PARTS)).cast("int").alias("part"))
    leaders = dealt.select("lead", "part").distinct().join(sets.withColumnRenamed("node", "lead"), "lead").select("lead", "part", F.lit(None).cast("bigint").alias("node"), "h", "n")
    members = dealt.join(sets, "node").select("lead", "part", "node", "h", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int] | None = None
        own: list[tuple[np.ndarray, np.ndarray]] = []  # an id with several texts leads by each
        for batch in batches:
            lead, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            follows = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            edges = np.unique(np.concatenate([[0, batch.num_rows], np.flatnonzero(~follows), np.flatnonzero(~follows) + 1])).tolist()
            keep = np.zeros(batch.num_rows, bool)
            for a, b in zip(edges, edges[1:]):
                h, n, at = _set_arrays(batch.column(3).slice(a, b - a), batch.column(4).slice(a, b - a))
                if not follows[a]:
                    if held != (lead[a], part[a]):
                        held, own = (lead[a], part[a]), []
                    own.append((h, n))
                    continue
                total = sums(n, at)
                for x, w in own:
                    place = np.minimum(np.searchsorted(x, h), len(x) - 1)
                    both = sums(np.where(x[place] == h, np.minimum(w[place], n), 0), at) if len(x) else np.zeros(b - a)
                    keep[a:b] |= both >= similarity * (total + w.sum() - both)
            u, v = lead[keep], batch.column(2).filter(pa.array(keep)).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])

    laid = leaders.unionByName(members).repartition("lead", "part").sortWithinPartitions("lead", "part", F.col("node").asc_nulls_first())
    return laid.mapInArrow(run, "a bigint, b bigint").distinct()


def _common(sets: DataFrame) -> DataFrame:
    """(node, size, common, groups): weight of a text's shingles, and of those that another text of ``sets`` has too, also by groups of their hashes.

    A node with several texts is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text=1, limit=STEP):
            h, n, at = _set_arrays(part.column(1), part.column(2))
            yield pa.record_batch([pa.array(np.repeat(part.column(0).to_numpy(), np.diff(at))), pa.array(h.view(np.int64)), pa.array(n)], names=["node", "h", "w"])

    rows = sets.select("node", "h", "n").mapInArrow(run, "node bigint, h bigint, w bigint")
    size = rows.groupBy("node").agg(F.sum("w").alias("size"))
    one = sets.groupBy("node").count().where("count = 1").select("node")
    alone = rows.groupBy("h").agg(F.count("*").alias("times"), F.min("node").alias("node"), F.min("w").alias("w")).where("times = 1")
    shared = rows.select("node", "h", "w").unionByName(alone.select("node", "h", (-F.col("w")).alias("w")))
    each = shared.groupBy("node", F.pmod("h", F.lit(GROUPS)).cast("int").alias("g")).agg(F.sum("w").alias("c"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    groups = each.groupBy("node").agg(F.sum("c").alias("common"), F.map_from_entries(F.collect_list(F.struct("g", "c"))).alias("m")).select("node", "common", dense.alias("groups"))
    return size.join(one, "node").join(groups, "node")


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of the connected components of links (a, b); the root is the least node.

    Each round points every neighbour larger than a node at the node's least neighbour, then every smaller
    one; stars form in a logarithmic number of rounds.  Rounds are written to the shared folder.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        before, edges = edges, scratch.stored(small, "edges")
        scratch.drop(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, weighted: bool = True) -> DataFrame:
    """One row per input row: doc_id and class_id.

    class_id is the least doc_id of the class: texts linked by a similarity of at least ``similarity``,
    directly or over others, and equal texts.  Similarity is the weighted Jaccard similarity of 5-word
    shingles: a shingle weighs as often as it stands in a text, or 1 if not ``weighted``.
    Texts without words are in a class with equal texts only.  A null text counts as empty.  Rows with a
    null id have a null class.  Rows that share an id are one document: links of all their texts count.
    Other columns are not read.  The result is a table in the shared folder; all others made on the way
    are removed.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    numbered = rows.where("doc_id is not null")
    signed = scratch.stored(signatures(numbered, weighted), "signatures")
    # Equal texts: the least id stands for all of them.
    texts = scratch.stored(signed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "texts")
    bands = texts.select("node", F.explode("bands").alias("band"))
    # The least text of a bucket leads it: near copies meet in many bands, and mostly under the same one.
    buckets = bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last")
    members = scratch.stored(bands.join(buckets.select("band", "first"), "band"), "buckets")
    star = lambda df, c: df.where(F.col("node") != F.col(c)).select(F.least("node", c).alias("a"), F.greatest("node", c).alias("b"), F.col(c).alias("lead"))
    once = lambda df: df.groupBy("a", "b").agg(F.min("lead").alias("lead"))
    pairs = scratch.stored(once(star(members, "first")), "pairs")
    nodes = scratch.stored(members.select(F.col("node").alias("doc_id")).distinct(), "nodes")
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    sets = scratch.stored(_sets(numbered.join(wanted, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), weighted).dropDuplicates(["node", "h", "n"]), "shingles")
    # An id with several texts ties their classes together.
    several = signed.groupBy("doc_id").agg(F.min("digest").alias("one"), F.max("digest").alias("other")).where("one != other").select("doc_id")
    tied = signed.join(several, "doc_id").join(texts, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b")
    links = scratch.stored(_verify(pairs, sets, similarity).unionByName(tied).distinct(), "links")
    roots = components(links, scratch)
    places = members.select("band", "node").distinct()

    def unsettled(roots: DataFrame) -> DataFrame:
        """Members of buckets that hold several classes; main is the bucket's least root."""
        placed = places.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        split = placed.groupBy("band").agg(F.min("root").alias("main"), F.max("root").alias("last")).where("main != last").select("band", "main")
        return scratch.stored(placed.join(split, "band"), "unsettled")

    # Shingles that no other text has can't be shared, which bounds a text's similarity to any other.
    rest = unsettled(roots)
    common = scratch.stored(_common(sets.join(rest.select("node").distinct(), "node", "left_semi")), "common")
    for _ in range(LEADER_ROUNDS):
        # Texts outside a bucket's main class meet the least edited text of that class, and of the others.
        held = rest.join(common, "node", "left").withColumn("best", F.struct(F.coalesce(F.col("common") / F.col("size"), F.lit(0.0)).alias("share"), "node"))
        leaders = held.groupBy("band").agg(F.max(F.when(F.col("root") == F.col("main"), F.col("best")))["node"].alias("lo"), F.max(F.when(F.col("root") != F.col("main"), F.col("best")))["node"].alias("hi"))
        led = rest.where("root != main").join(leaders, "band")
        new = scratch.stored(once(star(led, "lo").unionByName(star(led, "hi"))).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        pairs = pairs.unionByName(new)
        found = scratch.stored(_verify(new, sets, similarity), "links")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = components(links, scratch)
            rest = unsettled(roots)
    # What is left is compared in full: the texts outside the main class with all of other classes.
    # Two texts meet in the first bucket that both are in.
    own = rest.groupBy("node").agg(F.collect_set("band").alias("bands"))
    rest = rest.join(common, "node", "left").join(own, "node")
    side = lambda df, c: df.select("band", F.col("node").alias(c), *(F.col(x).alias(f"{c}_{x}") for x in ("root", "size", "common", "groups", "bands")))
    # Shared shingles are equal hashes, so they fall into the same group: a group's lesser weight bounds them.
    both = F.aggregate(F.zip_with("x_groups", "y_groups", lambda a, b: F.least(a, b)), F.lit(0).cast("bigint"), lambda a, c: a + c)
    first = F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("band")
    possible = F.coalesce(both >= similarity * (F.col("x_size") + F.col("y_size") - both), F.lit(True))
    minor, others = side(rest.where("root != main"), "x"), side(rest, "y").withColumnRenamed("band", "y_band")
    minor = minor.where(F.coalesce(F.col("x_common") >= similarity * F.col("x_size"), F.lit(True)))
    meet = minor.join(others, (F.col("band") == F.col("y_band")) & (F.col("x_root") != F.col("y_root")) & possible & first)
    more = meet.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("x").alias("lead"))
    more = scratch.stored(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = scratch.stored(_verify(more, sets, similarity), "links")
        if not found.isEmpty():
            roots = components(links.unionByName(found), scratch)
    classes = texts.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("class_id"))
    out = signed.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")
    out = scratch.stored(out.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("bigint").alias("class_id"))), "classes")
    scratch.clear(keep=out)
    return out


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, without those whose class has a smaller doc_id.

    Rows with a null id stay.  Of rows that share both id and text one stays, the least by a hash of its
    columns; rows that share an id but not the text are parts of one document and all stay.
    """
    classes = near_duplicates(docs, id_col, text_col)
    key, rank = free_name(docs, "id"), free_name(docs, "rank")
    scratch = Scratch(docs.sparkSession)
    losers = scratch.stored(classes.where("doc_id != class_id").select(F.col("doc_id").alias(key)).distinct(), "losers")
    twice = scratch.stored(classes.where("doc_id = class_id").groupBy(F.col("doc_id").alias(key)).count().where("count > 1").select(key), "twice")
    gone = losers.unionByName(twice)
    small = gone.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(gone) if small else gone, docs[id_col].cast("bigint") == F.col(key), "left_anti")
    if not twice.isEmpty():
        again = docs.join(twice, docs[id_col].cast("bigint") == F.col(key), "left_semi")
        first = Window.partitionBy(id_col, text_col).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        out = out.unionByName(again.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank))
    return out
