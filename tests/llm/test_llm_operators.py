"""The numbered operators against brute force, public libraries and exact round trips."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict
from functools import cache
from unittest.mock import MagicMock

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from parcelflow.llm import bpe, decontaminate, flac, near_dup, pii, quality, suffix_dedup, token_counts, token_files, url_filter
from parcelflow.llm.chunks import slices

DOCS = "doc_id long, text string"
TEXT = st.text(alphabet=st.sampled_from(list("abAB  \n\t.,'é1日\u2581\x85\u3000\x00%<|>s@+-()")), max_size=80)
#: Nulls in any column, empty and long texts, ties, repeated rows.
ODD = [(1, None), (None, "a b"), (None, None), (2, ""), (2, ""), (3, " "), (4, "x" * 30000), (5, "it's  we'll\n\n a"), (5, "it's  we'll\n\n a"), (6, "<|endoftext|> <s> \u2581\u2581 é"), (7, "mail a@b.co now")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd(spark):
    """ODD with columns whose names clash with results'."""
    return spark.createDataFrame([(*r, "x", 1, None) for r in ODD], DOCS + ", n_tokens string, score int, text_2 string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1, 6, 10: tokens


@pytest.fixture(scope="module")
def pieces():
    return token_counts.PieceCounter(P.path("piece_bpe_32k.model"))


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_counts_are_the_librarys(texts):
    counter = pieces_once()
    assert counter.counts(pa.array(texts)).tolist() == [len(counter.model.encode(t)) for t in texts]


@cache
def pieces_once():
    return token_counts.PieceCounter(P.path("piece_bpe_32k.model"))


@cache
def coder():
    return bpe.ByteBPE.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@cache
def chunked():
    return token_files.ChunkEncoder(P.path("word_bpe_49k.json"))


def test_whole_tokens_are_proven(pieces):
    words = pieces.whole.to_pylist()
    assert len(words) > 10_000 and all(len(i) == 1 for i in pieces.model.encode(words))


@cache
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder().ranks, special_tokens={})


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_bpe_is_the_librarys_and_goes_back(texts):
    ids, at = coder().encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library().encode_ordinary(t)
        assert coder().decode(ids[at[i] : at[i + 1]]) == t.encode()


def test_bpe_of_very_long_pre_tokens():
    rng = random.Random(0)
    for t in ("a" * 20_001, "ab" * 5_000 + "aab", "".join(rng.choice("abcdefgh") for _ in range(5_000)), "é" * 3000):
        ids, _ = coder().encode(pa.array([t]))
        assert ids.tolist() == library().encode_ordinary(t)


def test_bpe_where_a_later_rank_is_lower():
    # ab merges at 258 only to find abc at 256: rank order must go back.
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"ca": 257, b"ab": 258, b"abab": 259, b"aa": 260}
    own, rng = bpe.ByteBPE(ranks, r"\S+|\s+"), random.Random(1)

    def brute(token):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(token) and token not in ranks:
            best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1)), default=(1 << 30, 0))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[token]] if token in ranks else [ranks[p] for p in parts]

    for _ in range(400):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
        assert own.encode(pa.array([t]))[0].tolist() == brute(t.encode())


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_file_ids_are_the_librarys(texts):
    ids, at = chunked().encode(pa.array(texts), 1)
    for i, e in enumerate(chunked().model.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == [*e.ids, 1]


def test_token_files_seek_and_notice_damage(spark, tmp_path):
    docs = spark.createDataFrame([(i * 7 % 101, "word " * (i % 9) + str(i)) for i in range(101)] + [(3, "again"), (None, "none"), (50, "long " * 70_000), (-(1 << 63), "least")], DOCS)
    manifest = token_files.write_token_files(docs, P.path("word_bpe_49k.json"), tmp_path.as_uri(), end=1, file_ids=20_000)
    assert manifest.count() > 1 and manifest.where("part > 0").count() > 0
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert len(got) == 105 and got[0].doc_id is None and got[1].doc_id == -(1 << 63) and [r.doc_id for r in got[1:]] == sorted(i for i in texts if i is not None for _ in texts[i])
    start = 0
    for r in got:
        want = {zlib.crc32(np.array([*chunked().model.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()) for t in texts[r.doc_id]}
        assert r.start == start and r.ids_crc32 in want
        start += r.n_tokens
    path = max(manifest.collect(), key=lambda r: (r.n_docs, r.path)).path
    system, at = token_files.file_system(path)
    raw = bytearray(system.open_input_file(at).read())
    with system.open_input_file(at) as f:
        reader = token_files.Reader(f)
        one = int(reader.entries["doc_id"][len(reader.entries) // 2])
        assert [x.tolist() for x in reader.get(one)] == [[*chunked().model.encode(t, add_special_tokens=False).ids, 1] for t in texts[one]]
        assert reader.get(10**9) == []
    raw[10] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_files.Reader(pa.BufferReader(bytes(raw))).frame(0)
    raw[-30] ^= 1
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(bytes(raw)))


def test_one_id_may_hold_most_rows(spark, tmp_path):
    """The ranges split even rows of one id, which keep the order of the input."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.range(4000).selectExpr("if(id % 3 > 0, 7, id) as doc_id", "concat('word ', id, repeat(' and more', 300)) as text")
    manifest = token_files.write_token_files(docs.repartition(4), P.path("word_bpe_49k.json"), tmp_path.as_uri(), file_ids=1 << 30)
    got = token_files.read_token_files(manifest).orderBy("start").collect()
    assert len(got) == 4000 and [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    assert manifest.count() > 1 and manifest.agg({"n_docs": "max"}).first()[0] < 2400
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_token_queries_on_odd_rows(spark):
    for df in (token_counts.count_tokens(odd(spark), P.path("piece_bpe_32k.model")), bpe.round_trip_digests(odd(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), token_files.token_file_index(odd(spark), P.path("word_bpe_49k.json"), end=1)):
        assert len(df.collect()) == len(ODD)
    for df in (token_counts.count_tokens(empty(spark), P.path("piece_bpe_32k.model")), bpe.encode_docs(empty(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), token_files.token_file_index(empty(spark), P.path("word_bpe_49k.json"), end=1)):
        assert df.collect() == []
    back = bpe.decode_docs(bpe.encode_docs(odd(spark), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert rows(back) == sorted(((i, bytearray((t or "").encode())) for i, t in ODD), key=repr)


# 2: decontamination


def distance(words, item):
    """Least edits of an item to any stretch."""
    column = list(range(len(item) + 1))
    best = column[-1]
    for w in words:
        last, column[0] = 0, 0
        for i, x in enumerate(item):
            last, column[i + 1] = column[i + 1], min(last + (x != w), column[i] + 1, column[i + 1] + 1)
        best = min(best, column[-1])
    return best


def test_leaks_are_exact_and_found(spark):
    rng = random.Random(4)
    items = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in [1, 2, 5] + [rng.randint(15, 60) for _ in range(60)]]
    it = decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items])
    texts, owners = [], []
    for k, item in enumerate(items):
        for rate in (0, 0.05, 0.1, 0.3):
            words = list(item)
            for _ in range(int(len(item) * rate)):
                at, kind = rng.randrange(len(words)), rng.randrange(3)
                words[at : at + (kind != 0)] = [] if kind == 2 else [f"new{rng.randint(0, 9999)}"]
            texts.append(" ".join([f"f{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30))] + words + [f"f{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30))]))
            owners.append((k, rate))
    found = {(i, k): edits for i, k, edits, *_ in decontaminate._leaks(it, pa.array(texts))}
    want = {(i, k): d for i, t in enumerate(texts) for k, item in enumerate(items) if (d := distance(t.split(), item)) <= int(len(item) * decontaminate.MAX_EDITS)}
    assert set(found) <= set(want) and all(found[x] >= want[x] for x in found)
    assert all((i, k) in found for i, (k, rate) in enumerate(owners) if rate == 0)
    assert len(found) >= 0.95 * len(want)


def edited(words, places, rng):
    """Words with one left out, changed or put in at each of the places."""
    out = list(words)
    for at in sorted(places, reverse=True):
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 2 else [f"new{rng.randint(0, 9999)}"]
    return out


def planted_recall(lengths, places, seed):
    """Share of items found with no more edits than were made, as many as are allowed, at places(n, edits, rng)."""
    rng = random.Random(seed)
    items = [[f"w{rng.randint(0, 2000)}" for _ in range(n)] for n in lengths]
    noise = lambda: [f"f{rng.randint(0, 999)}" for _ in range(rng.randint(0, 30))]
    made = [int(len(item) * decontaminate.MAX_EDITS) for item in items]
    texts = [" ".join(noise() + edited(item, places(len(item), e, rng), rng) + noise()) for item, e in zip(items, made)]
    hits = {(i, k): edits for i, k, edits, *_ in decontaminate._leaks(decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items]), pa.array(texts))}
    return sum(hits.get((i, i), e + 1) <= e for i, e in enumerate(made)) / len(items)


@pytest.mark.parametrize("where", ["start", "middle", "end"])
def test_leaks_edited_at_one_place_are_found(where):
    def places(n, e, rng):
        return range({"start": 0, "middle": (n - e) // 2, "end": n - e}[where], {"start": e, "middle": (n + e) // 2, "end": n}[where])

    assert planted_recall([n for n in (15, 20, 30, 40, 59) for _ in range(40)], places, 7) == 1


def test_leaks_are_exact_at_the_most_edits():
    """Every leak, its edits and its stretch as by brute force, with edits at any place."""
    rng = random.Random(9)
    items = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(8, 40))] for _ in range(30)]
    texts = [[f"w{rng.randint(0, 60)}" for _ in range(20)] + edited(x, rng.sample(range(len(x)), min(len(x), int(len(x) * 0.1) + rng.randint(0, 1))), rng) + [f"w{rng.randint(0, 60)}" for _ in range(20)] for x in items for _ in range(4)]
    got = decontaminate._leaks(decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items]), pa.array([" ".join(t) for t in texts]))
    want = {(i, k): d for i, t in enumerate(texts) for k, item in enumerate(items) if (d := distance(t, item)) <= int(len(item) * decontaminate.MAX_EDITS)}
    assert {(i, k): d for i, k, d, *_ in got} == want
    assert all(distance(texts[i][a:b], items[k]) == d for i, k, d, a, b in got)


@pytest.mark.parametrize("n", [60, 250, 500, 1000])
def test_leaks_of_any_size_are_found(n):
    assert planted_recall([n] * 40, lambda n, e, rng: rng.sample(range(n), e), n) == 1


def test_one_word_items_are_found():
    """Each of many words, at the start, in the middle and at the end of a text, and nowhere else."""
    items = [f"w{i}" for i in range(50)]
    texts = [t for w in items for t in (f"{w} x y z", f"x y {w} z", f"x y z {w}")] + ["x y z"]
    got = decontaminate._leaks(decontaminate.Items(list(range(50)), items), pa.array(texts))
    assert got == [(3 * k + j, k, 0, at, at + 1) for k in range(50) for j, at in enumerate((0, 2, 3))]


def test_leak_query_and_blocks(spark):
    bench = spark.createDataFrame([(1, "One two three four five six."), (2, None), (None, "x"), (3, "!!"), (4, "one TWO three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "so: one, two three\nfour five six, end"), (11, "one two three"), (None, "one two three four five six"), (12, None), (12, "")], DOCS)
    got = decontaminate.find_leaks(docs, bench)
    assert rows(got) == sorted([(10, 1, 0, 1, 7), (10, 4, 0, 1, 7), (None, 1, 0, 0, 6), (None, 4, 0, 0, 6)], key=repr)
    assert rows(decontaminate.drop_leaking(docs, bench)) == sorted([(11, "one two three"), (12, None), (12, "")], key=repr)
    assert [len(b.rows) for b in decontaminate.item_blocks(bench, 2)] == [1, 1]
    assert decontaminate.find_leaks(docs, bench.where("false")).collect() == [] == decontaminate.find_leaks(empty(spark), bench).collect()


# 3: near duplicates


def classes(docs, similarity=0.8):
    """Brute force: connected components over shingle sets, equal texts and equal ids."""
    sets = {}
    for i, t in docs:
        w = t.lower().split()
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    keys = list(sets)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(keys):
        for b in keys[:n]:
            both = len(sets[a] & sets[b])
            if a[1] == b[1] or a[0] == b[0] or (both and both >= similarity * (len(sets[a]) + len(sets[b]) - both)):
                root[find(a)] = find(b)
    least = {}
    for k in keys:
        least[find(k)] = min(least.get(find(k), 1 << 60), k[0])
    return sorted((i, least[find((i, t))]) for i, t in docs)


def test_near_duplicate_classes_equal_brute_force(spark):
    rng = random.Random(3)
    words = [str(rng.randint(0, 99999)) for _ in range(3000)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((rng.randint(0, 10**6), "  ".join(w)))
    docs += [(300, ""), (301, ""), (302, " "), (5, "x y"), (6, "X  y\n"), (7, "x y"), (7, "another text of the same id entirely"), (8, "another text of the same id entirely")] + docs[:20]
    got = near_dup.near_duplicates(spark.createDataFrame([*docs, (None, "x y"), (None, None)], DOCS).repartition(5))
    with_id = sorted((r.doc_id, r.class_id) for r in got.collect() if r.doc_id is not None)
    assert with_id == classes(docs)
    assert [r.class_id for r in got.where("doc_id is null").collect()] == [None, None]
    kept = near_dup.keep_one_each(spark.createDataFrame([*docs, (None, "x y")], DOCS))
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in classes(docs)}) and ids.count(None) == 1
    assert near_dup.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("n, common, weighted", [(50, 40, False), (3, 2, False), (1500, 1100, False), (60, 50, True)])
def test_dart_sketch_estimates_similarity(n, common, weighted):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, n).astype(np.uint64)
    b = a.copy()
    b[common:] = rng.integers(0, 2**63, n - common)
    wa = rng.integers(1, 9, n) if weighted else np.ones(n, int)
    wb = np.maximum(1, wa + rng.integers(-1, 2, n)) if weighted else wa
    x, y = dict(zip(a.tolist(), wa.tolist())), dict(zip(b.tolist(), wb.tolist()))
    real = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    s = near_dup.dart_sketch(np.repeat([0, 1], n), np.concatenate([a, b]), np.concatenate([wa, wb]), 2, k=1200)
    assert abs((s[0] == s[1]).mean() - real) < 0.06 and (s != 0).all()


def test_dart_sketch_does_not_depend_on_the_block_of_darts(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 0, 400, 3000]
    of = np.repeat(np.arange(len(sizes)), sizes)
    h, w = rng.integers(0, 2**63, len(of)).astype(np.uint64), rng.integers(1, 20, len(of))
    want = near_dup.dart_sketch(of, h, w, len(sizes))
    for block in (1, 100):
        monkeypatch.setattr(near_dup, "DARTS", block)
        assert np.array_equal(near_dup.dart_sketch(of, h, w, len(sizes)), want)
    monkeypatch.undo()
    alone = [near_dup.dart_sketch(np.zeros(n, int), h[of == i], w[of == i], 1)[0] for i, n in enumerate(sizes)]
    assert np.array_equal(np.array(alone), want)
    assert not want[3].any()


@pytest.mark.parametrize("width", [1, 2, 5])
def test_shingles_are_those_of_a_plain_loop(width):
    rng = np.random.default_rng(3)
    texts = ["", " ", "a", "A  b", "a b c d", "a b c d e", "a b c d e a b c d e"] + [" ".join(rng.choice(list("abc"), n)) for n in (3, 7, 40, 200)]
    of, h, n = near_dup.shingles(pa.array(texts), width)
    name = {}
    for i, text in enumerate(texts):
        words = text.lower().split()
        starts = range(max(1, len(words) - width + 1)) if words else []
        want = Counter(tuple(words[k : k + width]) for k in starts)
        got = dict(zip(h[of == i].tolist(), n[of == i].tolist()))
        assert list(got) == sorted(got) and sorted(got.values()) == sorted(want.values())
        for value, shingle in ((naive_shingle(s), s) for s in want):
            assert got[value] == want[shingle] and name.setdefault(value, shingle) == shingle


def naive_shingle(words):
    value = np.zeros(1, np.uint64)
    for word in words:
        value = near_dup.mix(value * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(xxhash.xxh64_intdigest(word)))
    return int(value[0])


# 4: media


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: (b * 64)[: len(b) * 64]), min_size=1, max_size=4), st.integers(0, 3))
def test_flac_goes_back(payloads, partition_order):
    data, offsets = np.frombuffer(b"".join(payloads), np.uint8), np.cumsum([0, *map(len, payloads)])
    streams = flac.encode(data, offsets, partition_order=partition_order)
    out, at, _ = flac.decode(streams)
    assert out.tobytes() == data.tobytes() and at.tolist() == offsets.tolist()


def signals():
    t = np.arange(9000)
    rng = np.random.default_rng(0)
    return [np.zeros(64, np.uint8), rng.integers(0, 256, 5056).astype(np.uint8), (np.sin(t / 20) * 100 + 128).astype(np.uint8)[:8960], np.append(np.zeros(1023), 255).astype(np.uint8), np.repeat([0, 255], 32).astype(np.uint8)]


def test_flac_kinds_walking_and_damage():
    for x in signals():
        (stream,) = flac.encode(x, np.array([0, len(x)]))
        bare = stream[:4] + b"\x80" + stream[5:42] + stream[46 + int.from_bytes(stream[43:46], "big") :]  # without its seek table
        assert flac.decode([bare])[0].tobytes() == x.tobytes()
        for at in (len(stream) - 1, len(stream) - 5, 30):
            bad = bytearray(stream)
            bad[at] ^= 4
            with pytest.raises(ValueError):
                flac.decode([bytes(bad)])
    blocks = flac.pcm_blocks(bytes(range(256)) * 50)
    assert flac.read_samples(blocks, 5000, 300) == (bytes(range(256)) * 50)[5000:5300] and flac.read_samples(blocks, 10**6, 5) == b"" and flac.read_samples(flac.pcm_blocks(b""), 0, 5) == b""


def test_media_features_come_from_the_stored_blocks(monkeypatch):
    """What is described is what the table of the blocks leads to."""
    docs, write = MagicMock(), flac.pcm_blocks

    def two_blocks_swapped(pcm):
        """128 samples in blocks of 64, stored in turned order, with the table to match."""
        blocks = write(bytes(pcm), 64)
        return blocks[:16] + struct.pack("<QQQQ", 0, 112, 64, 48) + blocks[48 + 64 :] + blocks[48 : 48 + 64]

    batch = pa.record_batch([pa.array([1]), pa.array(["a" * 64 + "b" * 64])], names=["doc_id", "text"])
    flac.text_media_features(docs)
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    (plain,) = run(iter([batch]))
    monkeypatch.setattr(flac, "pcm_blocks", two_blocks_swapped)
    (same,) = run(iter([batch]))
    assert plain.equals(same)
    monkeypatch.setattr(flac, "pcm_blocks", lambda pcm: write(bytes(pcm)[:-1] + b"c"))
    got = next(run(iter([batch]))).to_pylist()[0]
    want = b"a" * 64 + b"b" * 63 + b"c"
    assert got["payload_sha256"] == hashlib.sha256(want).hexdigest() and got["tail_crc32"] == zlib.crc32(want[-64:])
    assert got["feature"] != plain.to_pylist()[0]["feature"] and got["media_sha256"] == plain.to_pylist()[0]["media_sha256"]


def test_flac_escaped_partition():
    # A frame by hand: fixed order 0, one partition without Rice codes, five raw bits a sample.
    bits = "".join(f"{v:08b}" for v in (0xFF, 0xF8, 0x60, 0x02, 0x00, 63))
    head = np.frombuffer(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)), np.uint8)
    check = int(flac.crc(head, np.array([0]), np.array([6]), flac.CRC8, 8)[0])
    values = [(i * 7) % 32 - 16 for i in range(64)]
    body = f"{check:08b}" + "00010000" + "00" + "0000" + "1111" + f"{5:05b}" + "".join(f"{v & 31:05b}" for v in values)
    bits += body + "0" * (-len(bits + body) % 8)
    raw = np.frombuffer(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)), np.uint8)
    crc = int(flac.crc(raw, np.array([0]), np.array([len(raw)]), flac.CRC16, 16)[0])
    x, n, number, end = flac.decode_frames(np.append(raw, [crc >> 8, crc & 255]).astype(np.uint8), np.array([0]))
    assert x[0].tolist() == values and (n[0], number[0], end[0]) == (64, 0, len(raw) + 2)


def test_media_rows(spark):
    got = flac.text_media_features(odd(spark)).collect()
    assert len(got) == len(ODD)
    for r in got:
        texts = [(t or "").encode() for i, t in ODD if i == r.doc_id]
        padded = [t + bytes(max(64, -(-len(t) // 64) * 64) - len(t)) for t in texts]
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) in [(hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p)) for p in padded]
    same = {(r.feature, r.media_sha256, r.media_bytes) for r in got if r.doc_id in (2, 1)}
    assert len(same) == 1 and flac.text_media_features(empty(spark)).collect() == []
    media = flac.encode_texts(odd(spark))
    pcm = {r.doc_id: bytes(r.pcm) for r in flac.decode_media(media).collect()}
    assert flac.read_samples(pcm[4], 100, 50) == b"x" * 50 and flac.decode_media(media.selectExpr("doc_id", "cast(null as binary) as media")).where("pcm is not null").count() == 0


# 5: urls


def test_url_rules(spark, monkeypatch):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "Example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "a.b.c")]
    urls = ["http://example.org/es/1", "https://x.EXAMPLE.org/en/12?q", "http://notexample.org/es/1", "ftp://com/de/", "http://x.com/dex", "http://a.b.c", "http://z.a.b.c/#/", None, "no scheme", "http://", "x://y#://z/de/", "http://x.com/de/?a://b", "http://É.org/"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string"), rules).collect()}
    assert got == {
        0: ("example.org", "/es/1", "example.org/es/", "block"), 1: ("x.example.org", "/en/12", "example.org/en/1", "block"), 2: ("notexample.org", "/es/1", "org/", "allow"), 3: ("com", "/de/", "com/de/", "block"), 4: ("x.com", "/dex", None, "allow"),
        5: ("a.b.c", "", None, "allow"), 6: ("z.a.b.c", "/", "a.b.c/", "block"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("y", "", None, "allow"), 11: ("x.com", "/de/", "com/de/", "block"), 12: ("É.org", "/", "org/", "allow"),
    }
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), []).collect() == []


def test_url_keys_that_collide(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda raw: 7)
    (tmp_path / "i").write_bytes(url_filter.index_bytes([("block", "b.org/x"), ("allow", "a.org/")]))
    index = url_filter.Index(str(tmp_path / "i"))
    assert [index.rule(j) if j >= 0 else None for j in index.find([b"b.org/x", b"a.org/", b"c.org/"])] == [("b.org/x", "block"), ("a.org/", "allow"), None]


# 7: quality


def test_trees_learn_and_constants_hold(spark, sf):
    rng = np.random.default_rng(0)
    x = rng.random((4000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(int)
    trees = quality.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97
    again = quality.fit(x[:3000][::-1], y[:3000][::-1])
    assert np.array_equal(again.score(x), trees.score(x))
    assert set(quality.fit(x[:0], y[:0]).score(x[:3])) == {0.5}
    assert quality.features(pa.array(["", "A b\nA b", "é"])).shape == (3, len(quality.FEATURES))


def test_held_out_quality(spark):
    from pathlib import Path

    where = Path("/root/testdata/sf0.1")
    if not where.is_dir():
        pytest.skip("the given tables aren't here")
    docs, labels = (spark.read.parquet(str(where / f"{t}.parquet")) for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.98


def test_quality_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(1, 8)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality.score_quality(empty(spark), labels.where("false")).collect() == []
    kept = quality.keep_good(odd(spark), labels.where("false"))
    assert rows(kept) == rows(odd(spark))  # without labels all score 0.5; null texts stay null


# 8: repeated strings


def removed(docs):
    first, out = {}, []
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_removed_strings_equal_brute_force(spark):
    rng = random.Random(0)
    passages = ["".join(rng.choice("abcde é\n") for _ in range(n)) for n in (49, 50, 60, 120, 300, 800)]
    docs = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            p, a = rng.choice(passages), rng.randint(0, 20)
            t += rng.choice([p, p[a:], p[: len(p) - a], "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 80)))])
        docs.append((i * 3 % 97, t))
    docs += [(5, "a" * 300), (500, "a" * 200), (501, "a" * 49), (502, ""), (503, None), (7, "a" * 120), (7, "a" * 120), (-4, passages[3])]
    df = spark.createDataFrame([(i, t, i) for i, t in docs], DOCS + ", blob long").repartition(3)
    assert rows(suffix_dedup.dedup(df)) == sorted(removed(docs), key=repr)
    none = spark.createDataFrame([(None, "a" * 300), (None, None), (9, "a" * 60)], DOCS)
    assert sorted((str(r.doc_id), r.n_removed) for r in suffix_dedup.dedup(none).collect()) == [("9", 0), ("None", 0), ("None", 0)]
    assert suffix_dedup.dedup(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=150).map(lambda b: bytes(97 + x % 3 if x < 250 else x for x in b)), st.data())
def test_suffix_array(data, draw):
    d = np.frombuffer(data, np.uint8)
    order = suffix_dedup.suffix_array(d)
    want = sorted(range(len(data)), key=lambda i: data[i : i + 50])
    assert sorted(order.tolist()) == list(range(len(data))) and [data[i : i + 50] for i in order] == [data[i : i + 50] for i in want]
    prefix = suffix_dedup.common_prefixes(d, order)
    for k in range(1, len(order)):
        a, b = data[order[k - 1] :][:50], data[order[k] :][:50]
        assert prefix[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    wanted = np.array(draw.draw(st.lists(st.booleans(), min_size=len(d), max_size=len(d))))
    some = suffix_dedup.suffix_array(d, wanted=wanted)
    assert [data[i : i + 50] for i in some[wanted[some]]] == [data[i : i + 50] for i in want if wanted[i]] and wanted.sum() == wanted[some].sum()


# 9: personal data

BASE = [re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def base_spans(t):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(t):
            digits = re.sub(r"[^0-9]", "", m[0])
            fine = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and pii._luhn(digits), 10 <= len(digits) <= 15][k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


PARTS = st.sampled_from(["@", "+", "a", "B.", "1", "22", "000", "0", "255", "256", ".", "-", " ", "(", ")", "4111 1111 1111 1111", "4111111111111111", "é", "%", "_", "://", "x:y@", "iban ", "token=", "user", "\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_base_spans_are_the_patterns(t):
    assert [s for s in pii._finder().spans(t) if s[1] < pii.BASE] == base_spans(t)


def test_cues_before_very_long_blanks_take_linear_time():
    began = time.process_time()
    assert pii._finder().spans("iban" + " \t" * 500_000 + "!") == []
    assert [k for _, k, _ in pii._finder().spans("iban" + " " * 100_000 + "DE89370400440532013000")] == [5]
    assert time.process_time() - began < 5


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "gb82west12345698765432", "GB82-WEST-1234-5698-7654-32"])
def test_pii_ends_ibans_where_their_check_digits_hold(iban):
    for before, after in (("IBAN: ", ""), ("my iban no. ", " and so on 12"), ("Iban ", " 1234 5678."), ("iban=", "-")):
        t = before + iban + after
        assert pii._finder().spans(t.replace("8", "\u017f")) is not None
        assert [t[a:b] for a, k, b in pii._finder().spans(t) if k == 5] == [iban]


def test_added_kinds_and_redaction(spark):
    t = "see ftp://bob:pw1@h.org/x, IBAN DE89 3704 0044 0532 0130 00. password=b7db7aa4a5; account number: 12-345678 x@y.zz"
    names = {(pii.KINDS[k], t[a:b]) for a, k, b in pii._finder().spans(t)}
    assert {("login_url", "bob:pw1@h.org"), ("secret", "b7db7aa4a5"), ("account", "12-345678"), ("email", "x@y.zz")} <= {(k, v.removeprefix("ftp://")) for k, v in names}
    assert "pw1" not in pii.redact_text(t, pii._finder()) and "[EMAIL]" in pii.redact_text(t, pii._finder()) and pii.redact_text("clean text, 12 words", pii._finder()) == "clean text, 12 words"
    assert {r.doc_id: r.text for r in pii.redact(odd(spark)).collect()}[7] == "mail [EMAIL] now"
    got = pii.find_pii(odd(spark)).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.spans for r in got}[7] == "email:5:11" and pii.find_pii(empty(spark)).collect() == []


# shared


def test_slices_are_bounded_and_whole():
    texts = ["a" * n for n in (0, 5, 30, 3, 3, 100, 1)] + [None]
    batch = pa.record_batch([pa.array(range(8)), pa.array(texts)], names=["i", "t"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), limit=10))
    assert [r for p in parts for r in p.column(1).to_pylist()] == [t or "" for t in texts] and all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 10 for p in parts)


@pytest.mark.parametrize("n", [1, 5, 10, 14, 20, 28, 40, 59, 60, 150, 1000])
@pytest.mark.parametrize("where", ["start", "middle", "end", "any"])
def test_recall_of_sampled_walks_by_size_and_place(n, where):
    """At the most edits; exact copies, which items under ten words have to be, are always found."""
    def places(n, e, rng):
        return rng.sample(range(n), e) if where == "any" else range({"start": 0, "middle": (n - e) // 2, "end": n - e}[where], {"start": e, "middle": (n + e) // 2, "end": n}[where])

    assert planted_recall([n] * (300 if n < 100 else 30), places, 100 + n) >= (0.95 if n >= 10 else 1)


def test_walks_of_windows_that_meet_are_those_of_single_windows():
    """Collisions of the joint walk against walks of every window by itself."""
    rng = random.Random(3)
    items = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(n)) for n in (1, 4, 12, 25, 39, 70) for _ in range(4)]
    it = decontaminate.Items(list(range(len(items))), items)
    words, offsets = decontaminate.word_sequences(pa.array([" ".join(f"w{rng.randint(0, 30)}" for _ in range(400)) + " " + items[9], items[20] + " x", "", "w1"]))
    end = decontaminate._END
    seq = np.concatenate([[end], np.insert(words, offsets[1:], end)])
    vocabulary, code = np.unique(seq, return_inverse=True)
    for walk, classes in enumerate(it.walks):
        own = code[::-1] if walk % 2 else code
        start = np.flatnonzero(vocabulary[own] != end).astype(np.int32)
        got = {(id(r), int(w)) for r, window, where in it._collisions(classes, walk, vocabulary, own, start) for w in window} if classes else set()
        want = set()
        for r in classes:
            for steps, (keys, order) in zip(r.steps, r.of):
                key = np.zeros(len(start), np.uint64)
                for at in decontaminate._pointers(vocabulary[own], start.astype(np.int64), walk, steps):
                    key = decontaminate.mix(key ^ vocabulary[own][at])
                want |= {(id(r), int(w)) for k, w in zip(keys, order) if k in set(key.tolist())}
        assert got == want and (want or not classes)
