"""Operators 4 and 7 against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from strataquery.llm import queries, simhash, suffix_dedup
from strataquery.llm.components import components


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), hashlib.sha256(kept).hexdigest()))
    return out


def check_dedup(df, length, hot=2048):
    rows = df.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, brute_removed([r.text for r in rows], length), strict=True))
    got = suffix_dedup.dedup(df, length=length, keep=["doc_id"], outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), hot=hot)
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize("which", ["messy", "corpus"])
def test_contract_length(request, which):
    check_dedup(request.getfixturevalue(which), 400)


@pytest.mark.parametrize("hot", [2048, 1])
def test_passages_edits_and_periods(spark, hot):
    rng = random.Random(4)
    passage = "".join(rng.choice("abc ") for _ in range(90))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 200))) for _ in range(40)]
    for i in range(0, 40, 2):
        cut = rng.randint(0, 60)
        texts[i] += passage[cut : cut + rng.randint(10, 90)] + texts[i + 1][:30]
    texts += ["ab" * 70, "z" * 150, "z" * 149, texts[3], texts[3][:50] + "!" + texts[3][50:], "é" * 60, "xé" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length in (16, 33, 64) if hot > 1 else (33,):
        check_dedup(df, length, hot)


def test_large_group_of_near_copies(spark):
    rng = random.Random(6)
    alphabet = "abcdefghijklmnop  "
    base = "".join(rng.choice(alphabet) for _ in range(700))
    texts = [base, base]
    for _ in range(150):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2, 5])):
            t[rng.randrange(len(t))] = rng.choice("XYZ")
        texts.append("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) + "".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_dedup(df, 64, 5)


def test_halves_share_out_all_windows():
    rng = random.Random(3)
    for _ in range(300):
        length = rng.randint(8, 60)
        lo = rng.randint(0, length - 4)
        hi = lo + rng.randint(1, length - lo)
        n = rng.randint(max(length, hi), lo + length)
        windows = [s for s in range(n - length + 1) if s <= lo and hi <= s + length]
        pieces = suffix_dedup.halves(bytes(n), lo, hi, length)
        assert sorted(s for a, z, _, _ in pieces for s in range(a, z + 1)) == windows
        assert all(s <= f and t <= s + length for a, z, f, t in pieces for s in range(a, z + 1))
        assert all(t - f > hi - lo for _, _, f, t in pieces) or hi - lo == length


def test_dedup_columns_and_empty(messy, empty):
    assert suffix_dedup.dedup(empty).count() == 0
    out = suffix_dedup.dedup(messy, outputs=("n_removed", "kept", "kept_text"))
    assert out.columns == [c for c in messy.columns if c != "kept"] + ["n_removed", "kept", "kept_text"]
    for r in out.collect():
        assert r.kept_text == (None if r.text is None else bytes(r.kept).decode("utf-8", "ignore"))
        assert r.n_removed or r.kept_text == r.text


def test_query_returns_documents_without_planted_passages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghéñ") for _ in range(rng.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(68)
    assert len(passage.encode()) >= 400
    own = [(text(rng.randint(0, 90)), text(rng.randint(20, 90))) for _ in range(30)]
    # bytes that differ, so that a match ends with the passage
    planted = [f"{a}<{chr(65 + i)}{passage}{chr(65 + i)}>{b}" for i, (a, b) in enumerate(own)]
    rows = list(enumerate(planted + [text(150) for _ in range(30)] + ["", None]))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op4_suffix_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_chars"]
    found = {r.doc_id: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        r, want = found[i], t.replace(passage, "") if i < 30 else t
        data = (want or "").encode()
        assert (r.text, r.n_chars) == (want, None if want is None else len(want))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len((t or "").encode()), len((t or "").encode()) - len(data), int(i < 30))
        assert r.kept_sha256 == hashlib.sha256(data).hexdigest()


def test_refinement_of_random_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    for length in (1, 3, 8, 11, 20):
        s = data.tobytes()
        seen = Counter(s[i : i + length] for i in range(len(s) - length + 1))
        want = [i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1]
        assert suffix_dedup.repeated(data, np.full(3000, 3000), length).tolist() == want


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [] if not w else [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    fps = np.array(fps, np.uint64)
    label = np.arange(len(fps))
    for i in range(len(fps)):
        hit = np.unique(label[np.bitwise_count(fps ^ fps[i]) <= 3])
        label[np.isin(label, hit)] = hit[0]
    least = defaultdict(list)
    for i, x in zip(ids, label.tolist(), strict=True):
        if i is not None:
            least[x].append(i)
    return [min(least[x], default=None) for x in label.tolist()]


@pytest.mark.parametrize("which", ["messy", "corpus"])
def test_near_duplicates(request, which):
    df = request.getfixturevalue(which)
    rows = df.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = Counter((r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components(fps, [r.doc_id for r in rows]), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(df, keep=["doc_id"]).collect())) == want


def near_fingerprints(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            out.add(x)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    return sorted(out | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})


@pytest.mark.parametrize("limit", [4096, 60, 4])
def test_no_link_is_lost(spark, limit):
    fps = near_fingerprints(600, 8)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit)).collect()}
    want = brute_components(fps, list(range(len(fps))))
    got = defaultdict(set)
    for i, x in enumerate(signed):
        got[nodes.get(x, x)].add(i)
    groups = defaultdict(set)
    for i, w in enumerate(want):
        groups[w].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_golay_is_perfect():
    g, rng = simhash.Golay(), random.Random(1)
    v = np.array([rng.getrandbits(23) for _ in range(500)])
    word = v ^ g.leader[g.syndrome(v)]
    assert (g.syndrome(word) == 0).all() and (np.bitwise_count(v ^ word) <= 3).all()
    idx, ok = g.indices(v, 23)
    assert ok.sum(axis=1).max() <= 6 and (idx[:, 0] == g.index(v)).all()


def test_columns_root_and_empty(messy, empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    out = simhash.near_duplicates(messy, root="group")
    assert out.columns == [c for c in messy.columns if c != "fingerprint"] + ["fingerprint", "component_id", "group"]


def test_one_of_each(messy, corpus, spark):
    kept = simhash.one_of_each(messy)
    assert kept.columns == messy.columns
    texts = [r.text for r in kept.collect()]
    assert sum(not (t or "").strip() for t in texts) == 1 and texts.count("a b c d") == 1
    base = [r.text for r in corpus.where("length(text) > 2000").limit(20).collect()]
    near = []
    for i, t in enumerate(base):
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        near += [(i, t), (100 + i, " ".join(w)), (200 + i, t)]
    stay = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert len(stay) <= 22 and min(stay) < 20


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 701)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {700: 700, 701: 700}
