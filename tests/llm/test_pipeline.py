"""The pipeline's stages against brute-force versions of what each has to do to its own input."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from parcelflow.llm import decontaminate, pii, quality

from test_llm_operators import base_spans, classes, distance

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, _id string, lost_id bigint"


def corpus():
    """Rows with columns whose names operators use within."""
    rng = random.Random(11)
    words = [f"wörd{rng.randint(0, 9999)}" for _ in range(2000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += [t.replace(t.split()[0], "other", 1) for t in texts[:15]] + texts[:10]
    texts += ["", None, " ", *(f"BUY!!! $$$ {i} NOW!! @@{i} " * (i + 5) for i in range(60)), "mail to a.b@c.org or +1 (555) 010-9999, card 4111 1111 1111 1111", "one two three four five six seven eight nine ten, and so on", "x " * 5000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[4] + " and more of it"), (None, texts[0]), (None, None), (7, None)]
    return [(i, t, "en", "s", len(t or ""), "h", "id", 1) for i, t in docs]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.repartition(4).write.parquet(f"{at}/documents.parquet")
    good = [(i, int("!" not in (t or "") and "@@" not in (t or "")), 0) for i, t, *_ in rows if i is not None]
    spark.createDataFrame(good * 12, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, None), (None, "wörd"), (3, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages_in_turn(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "personal_data", "byte_bpe"]

    # Quality: each text scored by itself, walking one tree after the other, node by node.
    trees = quality.train(docs, spark.read.parquet(f"{given}/labels.parquet"))

    def score(text):
        x, total = quality.features(pa.array([text or ""]))[0], trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = trees.left[node] if x[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return 1 / (1 + np.exp(-total))

    kept = stages["quality"](spark, docs, given)
    assert kept.columns == docs.columns
    assert listed(kept) == sorted((tuple(r) for r in docs.collect() if score(r.text) >= quality.THRESHOLD), key=repr)
    assert 0 < kept.count() < docs.count()

    # Near duplicates, on the whole input of this stage.
    once = stages["near_duplicates"](spark, docs, given)
    pairs = [(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None]
    stay = {i for i, c in classes(pairs) if i == c}
    want = {(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id in stay}
    got = [(r.doc_id, r.text or "") for r in once.collect()]
    assert once.columns == docs.columns and sorted(x for x in got if x[0] is not None) == sorted(want) and sum(i is None for i, _ in got) == 2

    clean = stages["decontamination"](spark, once, given)
    item = "one two three four five six seven eight nine ten".split()
    leaks = lambda t: distance((t or "").lower().replace(",", " ").split(), item) <= int(len(item) * decontaminate.MAX_EDITS)
    assert clean.columns == docs.columns and listed(clean) == sorted((tuple(r) for r in once.collect() if not leaks(r.text)), key=repr)
    assert clean.count() == once.count() - 1

    redacted = stages["personal_data"](spark, clean, given)
    assert redacted.columns == docs.columns and redacted.dtypes == docs.dtypes and redacted.count() == clean.count()
    before = {(r.doc_id, r.text) for r in clean.collect()}
    for r in redacted.collect():
        assert r.n_chars == (None if r.text is None else len(r.text)) and not base_spans(r.text or "")
        assert (r.doc_id, r.text) in before or "[EMAIL]" in r.text and "[CARD]" in r.text and "[PHONE]" in r.text

    final = stages["byte_bpe"](spark, redacted, given)
    model = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted(((r.doc_id, len(x := model.encode_ordinary(r.text or "")), np.array(x, "<u4").tobytes()) for r in redacted.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids)) for r in final.collect()), key=repr) == want

    # All in turn.
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, given)
    whole = corpus_pipeline.run(spark, given)
    assert listed(whole) == listed(step) and whole.columns == ["doc_id", "n_tokens", "ids"] and zlib.crc32(b"") == 0


def test_no_documents(spark, given):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, given).collect() == [], name
    assert pii.redact(none).columns == none.columns
