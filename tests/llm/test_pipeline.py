"""The corpus pipeline on whole small tables."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from strataquery.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from strataquery.llm.common import stash

    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], SF), "test-stage"))
    return out


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for s in stages[1:-1]:
        assert s.columns == stages[0].columns
    counts = [s.count() for s in stages]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]


def test_quality_goes_by_labels(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = stages[1].select("doc_id")
    good = labels.where("quality = 1").join(kept, "doc_id", "left_anti").count()
    bad = labels.where("quality = 0").join(kept, "doc_id", "left_semi").count()
    assert good <= 5 and bad <= 3


def test_no_text_stays_twice(stages):
    assert stages[2].count() == stages[2].select("text").distinct().count()
    assert stages[1].select("text").distinct().count() >= stages[2].count()


def slow_views(text):
    """The fingerprints that link in the pipeline: three-word shingles with repeats, and distinct words under three seeds."""
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    out = []
    for grams, seed in ((shingles, 42), (set(words), 1), (set(words), 2), (set(words), 3)):
        h = [xxhash.xxh64_intdigest(g, seed) for g in grams]
        out.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return out


def test_one_of_each_group_by_all_pairs(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    label = np.arange(len(rows))
    for view in zip(*(slow_views(r.text) for r in rows), strict=True):
        fps = np.array(view, np.uint64)
        for i in range(len(fps)):
            hit = np.unique(label[np.bitwise_count(fps ^ fps[i]) <= 3])
            label[np.isin(label, hit)] = hit[0]
    assert {rows[i].doc_id for i in set(label.tolist())} == {r.doc_id for r in stages[2].collect()}


def test_passages_by_all_windows(stages):
    n = corpus_pipeline.PASSAGE_BYTES
    texts = {r.doc_id: (r.text or "").encode() for r in stages[2].collect()}
    seen = Counter(hash(t[i : i + n]) for t in texts.values() for i in range(len(t) - n + 1))
    cut = 0
    for r in stages[3].collect():
        data = texts[r.doc_id]
        gone = bytearray(len(data))
        for i in range(len(data) - n + 1):
            if seen[hash(data[i : i + n])] > 1:
                gone[i : i + n] = b"\1" * n
        assert r.text == bytes(x for x, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert r.n_chars == len(r.text)
        cut += any(gone)
    assert cut


def test_leaks_by_all_windows_of_words(spark, stages):
    """A document that holds an item's words in a row goes; one that shares no word pair with any item stays."""
    items = [toxicity.words_of(r.text).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {tuple(w[i : i + 12]) for w in items for i in range(len(w) - 11)}
    pairs = {tuple(w[i : i + 2]) for w in items for i in range(len(w) - 1)}
    stay = {r.doc_id for r in stages[4].collect()}
    whole = 0
    for r in stages[3].collect():
        words = toxicity.words_of(r.text).split()
        if not any(tuple(words[i : i + 2]) in pairs for i in range(len(words) - 1)):
            assert r.doc_id in stay
        text = b" ".join(words)
        if any(tuple(words[i : i + 12]) in grams for i in range(len(words) - 11)) and any(b" ".join(w) in text for w in items if len(w) >= 12):
            assert r.doc_id not in stay
            whole += 1
    assert whole


def test_tokens_are_the_librarys(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in stages[5].collect():
        assert r.token_ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.token_ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run_sweeps_what_it_no_longer_needs(spark):
    from strataquery.llm import common

    before = common.stashes()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0 and len(common.stashes() - before) == 1  # the last stage's input
    common.sweep(spark, before)
    assert common.stashes() == before


def test_run_gives_the_stages_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens) for r in got.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, messy, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, SF).count() == 0
    assert 0 < stage(spark, messy, SF).count() <= messy.count()


class Caught:
    """Takes the function that goes to the workers."""

    sparkSession = None

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("how", ["map_arrow", "in_arrow"])
def test_a_worker_drops_what_another_operator_kept(monkeypatch, how):
    from pyspark import cloudpickle

    from strataquery.llm import common

    monkeypatch.setattr(common, "bounded", lambda spark: None, raising=False)
    run = common.map_arrow(Caught(), lambda: lambda b: b, "x long") if how == "map_arrow" else common.in_arrow(Caught(), lambda batches: batches, "x long")
    sent = cloudpickle.dumps(run)
    common.worker_state("another's", list)
    assert list(cloudpickle.loads(sent)(iter([]))) == [] and not common._STATE


def test_batches_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from strataquery.llm import common

    df = spark.range(3000).select(F.repeat(F.lit("x"), 20_000).alias("text")).coalesce(1)
    sizes = common.map_arrow(df, lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) * 20_000 <= 5_000_000
