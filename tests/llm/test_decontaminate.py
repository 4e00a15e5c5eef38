"""Operator 5: planted leaks, paraphrases and clean documents, against brute force."""

import random

import numpy as np
import pytest

from strataquery.llm import decontaminate as D
from strataquery.llm import queries
from strataquery.llm.toxicity import words_of

SF = "/root/testdata/sf0.01"


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 25))] for _ in "ab")
        assert D.common_subsequence(a, b) == brute_lcs(a, b)


def test_latent_space_is_the_svds(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(30, 8)) @ rng.normal(size=(8, 40))
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in m], "w array<int>, x array<double>").repartition(3)
    basis = D.latent_space(rows, 40, rank=12)
    _, s, vt = np.linalg.svd(m)
    assert np.abs(basis[:, :8].T @ vt[:8].T) == pytest.approx(np.eye(8), abs=1e-6)


def test_query_finds_exactly_the_leaks(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").collect(), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [b" ".join(words_of(r.text).split()) for r in bench]
    want = {r.doc_id for r in docs if any(i in b" ".join(words_of(r.text).split()) for i in items)}
    got = queries.op5_decontamination(spark, SF).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got if r.contaminated} == want and want


def test_paraphrases(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(rng.choice([8, 20, 45, 120]))] for _ in range(30)]
    docs, leaky = [], set()
    for i in range(90):
        text = [word() for _ in range(rng.randint(60, 400))]
        if i % 3 == 0:
            leak = list(items[i // 3])
            for _ in range(len(leak) // 5):
                leak[rng.randrange(len(leak))] = word()
            text[30:30] = leak
            leaky.add(i)
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    rows = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    found = {r.doc_id for r in rows if r.contaminated}
    assert not found - leaky and len(found & leaky) >= 0.9 * len(leaky)
    assert all(r.item_id == r.doc_id // 3 for r in rows if r.contaminated)
    in_blocks = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench, block=7).collect()
    assert {r.doc_id for r in in_blocks if r.contaminated} == found


def test_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items = [[word() for _ in range(36)] for _ in range(5)]
    docs = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(60, 200))]
        text[30:30] = items[0] if i % 3 == 0 else []
        docs.append((i, " ".join(text)))
    bench = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    rows = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in rows if r.contaminated} == {i for i in range(60) if i % 3 == 0}


def test_recall_does_not_fall_with_the_size_of_the_corpus(spark, monkeypatch):
    rng = random.Random(6)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = [type("Item", (), {"id": r.item_id, "text": r.text}) for r in bench]
    others = [w for r in docs.limit(400).collect() for w in (r.text or "").split()]
    planted = []
    for r in bench:
        leak = r.text.split()
        for _ in range(len(leak) // 4):
            leak[rng.randrange(len(leak))] = rng.choice(others)
        at = rng.randrange(len(others) - 200)
        planted.append(" ".join(others[at : at + 70] + leak + others[at + 70 : at + 140]))
    count = D.frequencies
    recall = {}
    for times in (1, 1000):
        monkeypatch.setattr(D, "frequencies", lambda *a, n=times: tuple(x * n for x in count(*a)))
        index = D.build(items, False, docs, "text")
        recall[times] = sum(index.search(x)[0] for x in planted) / len(planted)
    print("recall of planted items", recall)
    assert min(recall.values()) >= 0.97 and abs(recall[1] - recall[1000]) <= 0.02


def test_more_items_than_directions(spark):
    rng = np.random.default_rng(8)
    odds = 1 / (np.arange(20_000) + 20)
    draw = lambda n: [f"w{x}" for x in rng.choice(20_000, n, p=odds / odds.sum())]
    texts = [x.tolist() for x in np.array(draw(48 * 2100)).reshape(2100, 48)]
    items = [type("Item", (), {"id": i, "text": " ".join(x)}) for i, x in enumerate(texts[: D.ITEMS])]
    docs = spark.createDataFrame([(i, " ".join(draw(200))) for i in range(300)], "doc_id long, text string")
    index = D.build(items, False, docs, "text")
    lost = [i for i, x in enumerate(texts[: D.ITEMS]) if not index.search(" ".join(draw(20) + x + draw(20)))[0]]
    print("verbatim items lost", len(lost), "of", D.ITEMS)
    assert not lost
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "item_id long, text string")
    leaks = spark.createDataFrame([(i, " ".join(draw(20) + texts[i] + draw(20))) for i in range(0, 2100, 30)], "doc_id long, text string")
    assert all(r.contaminated for r in D.contamination(leaks, bench).collect())


def test_edges(spark, messy, empty):
    bench = spark.createDataFrame([(1, None, "x"), (None, "", "x"), (2, "don't we'll I'm 123 4567", "x"), (2, "one two", "x"), (3, "!!", "x")], "item_id long, text string, contaminated string")
    out = D.contamination(messy, bench)
    assert out.columns == [c for c in messy.columns if c != "contaminated"] + ["contaminated", "item_id", "item_share", "cosine"]
    hit = {r.text for r in out.collect() if r.contaminated}
    assert "don't we'll I'm 123 4567" in hit and None not in hit and "" not in hit
    assert D.contamination(empty, bench).count() == 0
    assert D.contamination(messy, bench.where("false")).where("contaminated").count() == 0


def test_of_equally_good_items_the_smallest_id_is_named(spark):
    text = " ".join(f"word{i}" for i in range(40))
    items = spark.createDataFrame([(7, text), (3, text), (None, text), (9, "quite other words altogether in this one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "nothing of the kind")], "doc_id long, text string")
    for block in (2000, 1):
        got = {r.doc_id: (r.contaminated, r.item_id) for r in D.contamination(docs, items, block=block).collect()}
        assert got == {1: (True, 3), 2: (False, None)}
