"""Runs, languages and conversations against brute force, other ways to compute the same, and held-out labels."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelflow.llm import conversations, language, runs
from parcelflow.llm.queries import QUERIES

WORD = r"[^\x20\x09-\x0D]+"
ODD = [(1, None), (None, "a a a a a a"), (None, None), (2, ""), (2, ""), (3, " \t"), (4, "x y " * 20_000), (5, "\x85　é é é é é é"), (5, "\x85　é é é é é é"), (10, "a b\na b\ta b a b")]
CLASHING = "doc_id long, text string, lang string, start string, score int, n_runs int, period_2 string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# runs


def plain_runs(words):
    seen = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > s and i - s + q >= max(6, 4 * q):
                seen.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in seen.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text, damage):
    words = re.findall(WORD, text or "")
    n = len(words)
    if damage and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    drop = {k for s, c, q in found for k in range(s + q, s + c)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{c},{q}\n" for s, c, q in found)), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


PERIODIC = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)), max_size=5).map(lambda parts: [w for block, n in parts for w in block * n])


@settings(max_examples=300, deadline=None)
@given(st.lists(PERIODIC, min_size=1, max_size=4))
def test_runs_of_all_texts_are_those_of_a_plain_loop(texts):
    codes, offsets = np.array([w for t in texts for w in t], np.int32), np.cumsum([0, *map(len, texts)])
    assert [tuple(r) for r in runs.text_runs(codes, offsets).tolist()] == [(i, *r) for i, t in enumerate(texts) for r in plain_runs(t)]


def test_grammar_derives_the_words_and_looks_at_each_rule_once():
    rng = np.random.default_rng(1)
    for words in (np.zeros(500, np.int64), rng.integers(0, 3, 2000), np.tile(rng.integers(0, 40, 37), 20)):
        stretch = np.repeat([0, 1], [len(words) // 3, len(words) - len(words) // 3])
        g = runs.re_pair(words, stretch)
        expand = {}

        def derive(s):
            if s < g.base:
                return [int(s)]
            if s not in expand:
                expand[s] = derive(g.left[s - g.base]) + derive(g.right[s - g.base])
            return expand[s]

        assert len(g.roots) == 2 and [w for s in g.roots.tolist() for w in derive(s)] == words.tolist()
        assert len(set(zip(g.left.tolist(), g.right.tolist()))) == len(g.size)  # one rule a pair
        for r in range(len(g.size)):
            assert derive(g.base + r) == words[g.first[r] : g.first[r] + g.size[r]].tolist()
        assert g.size.sum() <= len(words) * len(g.rounds)


def test_long_periodic_texts_take_little():
    tile = np.random.default_rng(0).integers(0, 50, 20_000).astype(np.int32)
    assert runs.text_runs(np.zeros(100_000, np.int32), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 1]]
    assert [0, 0, 100_000, 20_000] in runs.text_runs(np.tile(tile, 5), np.array([0, 100_000])).tolist()
    fib, last = [0, 1], [0]
    while len(fib) < 50_000:
        last, fib = fib, fib + last
    assert len(runs.text_runs(np.array(fib, np.int32), np.array([0, len(fib)]))) == 0  # no exponent of 4 in it


@pytest.mark.parametrize("damage", [False, True])
def test_run_digests_of_odd_rows(spark, damage):
    many = [(i, " ".join(random.Random(i).choices("abc", k=i % 50))) for i in range(20, 120)]
    docs = spark.createDataFrame([(*r, "x", "x", 1, 2, None) for r in ODD + many], CLASHING)
    got = runs.run_digests(runs.repeat_tails(docs) if damage else docs).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    want = [plain_digest(i, t, damage) if t is None or len(t) < 5_000 else None for i, t in ODD + many]
    long = [r for r in rows(got) if r[0] == 4]
    assert len(long) == 1 and damage or long[0][1:6] == (1, 0, 40_000, 2, 20_000_000)
    assert [r for r in rows(got) if r[0] != 4] == sorted((w for w in want if w), key=repr)
    assert runs.run_digests(docs.where("false")).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "go on on on on on on  now", 5), (2, "a b " * 4, 5), (3, "once  only", 5), (4, None, 5)], "doc_id long, text string, length int")
    assert rows(runs.find_runs(docs)) == [(1, 1, 6, 1), (2, 0, 8, 2)]
    assert rows(runs.collapse(docs)) == [(1, "go on now", 5), (2, "a b", 5), (3, "once  only", 5), (4, None, 5)]


def test_op11_on_the_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: r for r in map(tuple, QUERIES["op11_periodic_runs"](spark, sf).collect())}
    assert len(got) == len(docs)
    short = [d for d in docs if len(re.findall(WORD, d.text or "")) < 1200]
    assert sum(got[d.doc_id][1] for d in short) > 5
    for d in short:
        assert got[d.doc_id][:8] == plain_digest(d.doc_id, d.text, True)


# languages


def test_language_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_language_id"](spark, sf).collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def _model(spark, sf):
    return language.Model.of(language.count_trigrams(spark.read.parquet(f"{sf}/documents.parquet")))


def test_trigram_counts_are_those_of_a_plain_loop(spark):
    texts = [("en", "The the, É-é 12 a"), ("en", "the"), ("fr", "é &&& été"), ("fr", None), (None, "x"), ("de", "1 2 &")]
    want = Counter()
    for lang, text in texts:
        for chunk in (text or "").split(" ") if lang else []:
            clean = re.sub(r"[\W\d_]+", " ", chunk).lower().strip(" ")
            framed = f" {clean} ".encode() if clean else b""
            for i in range(len(framed) - 2):
                code = framed[i] << 16 | framed[i + 1] << 8 | framed[i + 2]
                want[lang, (code * 0x9E3779B1 & 0xFFFFFFFF) >> 14] += 1
    got = {(r.lang, r.cell): r.n for r in language.count_trigrams(spark.createDataFrame(texts, "lang string, text string")).collect()}
    assert got == dict(want)


def test_mixtures_are_those_of_a_plain_expectation_maximisation(spark, sf):
    model = _model(spark, sf)
    by = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) between 600 and 3000").collect():
        by[r.lang].append(" ".join(r.text.split()[:90]))
    mixed = [f"{by['en'][k]} {by[other][k]}" for k in range(4) for other in ("fr", "de", "es")]
    names, score, shares = model.predict(pa.array(mixed + by["en"][:6] + ["", "12 34", "the"]))
    for k, text in enumerate(mixed):
        other = ("fr", "de", "es")[k % 3]
        assert {s["lang"] for s in shares[k]} == {"en", other}, text[:50]
        # The same proportions by plain loops over words.
        w = language.words_of(pa.array([text]))
        like = [[float(np.exp(model.log_share[w.cells[w.begin[c] : w.begin[c + 1]], model.langs.index(lang)].astype(float).sum())) for lang in ("en", other)] for c in w.codes if w.begin[c + 1] > w.begin[c]]
        theta = [0.5, 0.5]
        for _ in range(500):
            parts = [[t * p for t, p in zip(theta, word)] for word in like]
            theta = [sum(p[j] / sum(p) for p in parts) / len(parts) for j in range(2)]
        assert abs({s["lang"]: s["share"] for s in shares[k]}["en"] - theta[0]) < 0.02
    assert names[len(mixed) : -3] == ["en"] * 6 and all(len(s) == 1 for s in shares[len(mixed) : -3])
    assert names[-3:-1] == ["und", "und"] and score[-3] == score[-2] == 0 and shares[-3] == []


def test_a_fit_never_lowers_the_likelihood(spark, sf):
    model, rng = _model(spark, sf), np.random.default_rng(2)
    each = np.log(rng.dirichlet([0.3] * len(model.langs), 200)).astype(np.float32)
    begin = np.array([0, 5, 60, 61, 400])
    codes = rng.integers(0, 200, 400)
    theta = model._mixtures(each, codes, begin)
    assert np.allclose(theta.sum(axis=1), 1)
    for k in range(4):
        p = np.exp(each[codes[begin[k] : begin[k + 1]]].astype(float))
        n = begin[k + 1] - begin[k]
        own = np.log(p @ theta[k]).sum() - (language.AT_LEAST + language.PENALTY * np.log1p(n)) * ((theta[k] > 0).sum() - 1)
        assert own >= max(np.log(p[:, j]).sum() for j in range(p.shape[1])) - 1e-3


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(*r, None if r[0] is None else "en", "x", 1, 2, None) for r in ODD] + [(7, "été où ça", "fr", "x", 1, 2, None)], CLASHING)
    got = language.identify(docs).collect()
    assert len(got) == len(ODD) + 1 and sum(r.lang_pred == "und" for r in got) == 5
    assert all((r.score == 0) == (r.lang_pred == "und") for r in got)
    assert language.identify(docs.where("false")).count() == 0
    nothing = language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}


# conversations

PATTERN = re.compile(r"(s?(ua)+)?\Z")


def every_repair(codes):
    """The least (cost, audit) of all choices of edits, with up to two insertions between rows."""
    options = []
    for c in codes:
        extra = 5 if c.isupper() else 0
        options.append([("", 2, "D")] + ([] if c == "f" else [(c.lower(), extra, "K"), ("u", 1 + extra, "R"), ("a", 1 + extra, "R")]))
    best = None
    for chosen in itertools.product(*options):
        for gaps in itertools.product(["", "u", "a", "ua", "au"], repeat=len(codes) + 1):
            shape = gaps[0] + "".join(r + g for (r, _, _), g in zip(chosen, gaps[1:]))
            cost = 5 * sum(map(len, gaps)) + sum(c for _, c, _ in chosen)
            audit = "I" * len(gaps[0]) + "".join(m + "I" * len(g) for (_, _, m), g in zip(chosen, gaps[1:]))
            if (best is None or (cost, audit) < best) and PATTERN.match(shape):
                best = (cost, audit)
    return best


def test_cells_are_the_least_of_all_edits():
    rng = random.Random(2)
    shapes = ["".join(c) for n in range(3) for c in itertools.product("fsuaxSUAX", repeat=n)] + ["".join(rng.choices("fsuaxSUAX", k=3)) for _ in range(60)]
    for codes in shapes:
        assert conversations.best(conversations.span_cell(codes)) == every_repair(codes), codes


def test_one_split_of_a_span_is_as_good_as_all():
    rng = random.Random(3)
    for _ in range(15):
        codes = "".join(rng.choices("fsuaxSUAX", k=rng.randint(1, 12)))
        chart = {(i, i + 1): conversations.row_cell(c) for i, c in enumerate(codes)}
        for length in range(2, len(codes) + 1):
            for i in range(len(codes) - length + 1):
                cell = {}
                for k in range(i + 1, i + length):
                    for key, value in conversations.combine(chart[i, k], chart[k, i + length]).items():
                        cell[key] = min(value, cell.get(key, value))
                chart[i, i + length] = cell
        assert conversations.span_cell(codes) == chart[0, len(codes)]


def plain_report(given):
    """The report by a shortest-path search over (row, state), from rows (conv_id, turn, role, text) after damage."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    by = defaultdict(list)
    for conv, turn, role, text in given:
        by[conv].append((turn, role, text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, done = [(0, "", 0, 0, ())], set()
        while heap:
            cost, audit, i, state, kept = heapq.heappop(heap)
            if i == len(turns) and state in (0, 3):
                break
            if (i, state) in done:
                continue
            done.add((i, state))
            moves = [(r[0], r, 5, "I", "", 0) for r in ("user", "assistant")]
            if i < len(turns):
                _, role, text = turns[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, kept))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 5 * (faults[i] == "truncated")
                    moves += [(role[:1], role, extra, "K", text, 1), *((r[0], r, 1 + extra, "R", text, 1) for r in ("user", "assistant"))]
            for initial, role, price, mark, text, on in moves:
                if (state, initial) in step:
                    heapq.heappush(heap, (cost + price, audit + mark, i + on, step[state, initial], (*kept, f"{role}:{text}")))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[conv] = (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def plain_damage(given):
    for conv, turn, role, text in given:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            yield from [row] * (1 + (kind == 3))


NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_report(spark, given, damage):
    df = spark.createDataFrame([(*r, 1, "x") for r in given], "conv_id long, turn long, role string, text string, copies int, cost string")
    got = conversations.report(conversations.damaged(df) if damage else df, df).select(*REPORT).collect()
    want = plain_report(plain_damage(given) if damage else [(c, t, r or " ", " " if x is None else x) for c, t, r, x in given])
    assert sorted(map(tuple, got), key=repr) == sorted((want.get(c, (c, *NOTHING)) for c in {r[0] for r in given}), key=repr)


@pytest.mark.parametrize("damage", [False, True])
def test_reports_of_odd_conversations(spark, damage):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "Well", "", " \t", None, "Why? ", "Ok.\n ", "é　"]
    given = [(c, rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "tool", "unit", None]), rng.choice(texts)) for c in [*range(60), None] for _ in range(rng.randint(1, 9))]
    check_report(spark, given + given[:20], damage)
    check_report(spark, [], damage)


def test_a_conversation_of_many_blocks(spark):
    rng = random.Random(6)
    turns = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"Turn {rng.randint(0, 3000)}{rng.choice('.!?,')}") for t in range(9000)]
    turns += [(2, None, "user", "Hm.")] * 3000 + [(2, 1, "assistant", "Hm.")] + [(3, 7, "user", "x" * 2_000_000 + "."), (3, 8, "assistant", "y" * 1_500_000 + "!")]
    check_report(spark, turns, False)


def test_repaired_rows(spark):
    given = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "tool", "So?"), (2, 0, "assistant", "No one asked."), (3, 0, "user", " "), (4, None, "system", "Be kind."), (4, 1, "user", "A long question?"), (4, 2, "assistant", "Yes!")]
    got = rows(conversations.repair(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")))
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "So?"), (4, 0, "K", "system", "Be kind."), (4, 1, "K", "user", "A long question?"), (4, 2, "K", "assistant", "Yes!")]


def test_op13_on_the_given_table(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = plain_report(plain_damage(given))
    got = QUERIES["op13_conversation_repair"](spark, sf).select(*REPORT).collect()
    assert sorted(map(tuple, got)) == sorted(want.get(c, (c, *NOTHING)) for c in {r[0] for r in given})
    assert sum(r.cost for r in got) > 0
