"""Operators 6, 9 and 10 against the libraries themselves."""

import base64
import hashlib
import random
from zlib import compress, crc32

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strataquery.llm import byte_bpe, token_counts, token_files

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
TOKENIZER = Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def bpe(df, **kw):
    return byte_bpe.encode_decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, **kw)


@pytest.mark.parametrize("which", ["messy", "corpus"])
def test_bpe_is_the_librarys(request, which):
    df = request.getfixturevalue(which)
    for r in bpe(df, keep=["doc_id", "text"], outputs=("token_ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect():
        want = LIBRARY.encode_ordinary(r.text or "")
        assert r.token_ids == want and r.n_tokens == len(want)
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_bpe_columns_and_empty_tables(messy, empty):
    assert bpe(empty).count() == 0
    out = bpe(messy, outputs=("n_tokens",))
    assert out.count() == messy.count() and out.columns == [c for c in messy.columns if c != "N_TOKENS"] + ["n_tokens"]


CODEC = byte_bpe.TextBpe(RANKS, P.PATTERN)


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=80) | st.text(alphabet="ab \n'st", max_size=200) | st.integers(1, 400).map(lambda n: "a" * n) | st.integers(1, 300).map(lambda n: " " * n + "x"))
def test_tree_reduction_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = CODEC.encode(text).tolist()
    assert ids == LIBRARY.encode_ordinary(text) and CODEC.bpe.decode(ids) == text.encode()


@settings(deadline=None, max_examples=60)
@given(st.binary(min_size=1, max_size=200), st.data())
def test_join_is_a_monoids(data, draw):
    bpe_ = CODEC.bpe
    whole = bpe_._encode(data)
    assert whole == bpe_.merged(data)
    cut = draw.draw(st.integers(0, len(data)))
    assert bpe_.join(bpe_._encode(data[:cut]), bpe_._encode(data[cut:])) == whole


@pytest.mark.parametrize("which", ["messy", "corpus"])
def test_counts_are_the_librarys(request, which):
    df = request.getfixturevalue(which)
    for args in ({}, {"table_size": 5, "sample_docs": 3}):
        for r in token_counts.token_counts(df, P.path("piece_bpe_32k.model"), keep=["doc_id", "text"], **args).collect():
            assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(PIECES.encode(r.text or ""))), r.text


def test_counts_give_way_to_no_clashing_column(messy):
    out = token_counts.token_counts(messy, P.path("piece_bpe_32k.model"))
    assert out.columns == [c for c in messy.columns if c.lower() != "n_tokens"] + ["n_bytes", "n_tokens"] and out.count() == messy.count()


def test_table_is_bounded_and_of_the_commonest(spark):
    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(200) if n % (i + 1) == 0),) for n in range(400)], "text string")
    table = token_counts.frequent(docs, P.path("piece_bpe_32k.model"), table_size=20)
    assert 10 <= len(table) <= 20 and set(table) <= {f"w{i}" for i in range(24)}


def test_counts_of_an_empty_table(empty):
    assert token_counts.token_counts(empty, P.path("piece_bpe_32k.model")).count() == 0


COUNTS = token_counts.Counts(P.path("piece_bpe_32k.model"))


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60) | st.text(alphabet="ab \n▁.", max_size=60))
def test_pre_tokens_add_up(text):
    text = text.encode("utf-8", "ignore").decode()
    table = dict(zip(["a", "b", "\na"], COUNTS.lengths(["a", "b", "\na"]), strict=True))
    assert COUNTS.count(text, table) == len(PIECES.encode(text))


@pytest.mark.parametrize("which", ["messy", "corpus"])
def test_files_give_back_what_went_in(request, which):
    df = request.getfixturevalue(which)
    files = token_files.write(df, P.path("byte_bpe_50k.json"))
    got, digests = token_files.read(files).orderBy("start").collect(), {r.start: r for r in token_files.digests(files).collect()}
    want = sorted((r.doc_id is not None, r.doc_id or 0, TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in df.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.token_ids, "<u4").tolist()) for r in got) == want
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in got if r.doc_id is not None)
    at = 0
    for r in got:
        d = digests[at]
        assert (r.start, d.doc_id, d.n_tokens, d.ids_crc32) == (at, r.doc_id, r.n_tokens, crc32(bytes(r.token_ids)))
        at += r.n_tokens
    assert len(digests) == len(got)


def test_files_of_an_empty_table(empty):
    assert token_files.read(token_files.write(empty, P.path("byte_bpe_50k.json"))).count() == 0


@settings(deadline=None, max_examples=30)
@given(st.lists(st.lists(st.integers(0, 65535) | st.integers(0, 9), max_size=300), max_size=12))
def test_blocks_round_trip(blocks):
    arrays = [np.array(b, np.uint16) for b in blocks]
    back = token_files.decode_blocks(token_files.encode_blocks(arrays))
    assert [b.tolist() for b in back] == blocks


def test_more_blocks_than_lanes_and_ids_of_all_sizes(monkeypatch):
    monkeypatch.setattr(token_files, "LANES", 8)
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 65_536, n).astype(np.uint16) for n in rng.integers(0, 3000, 30)] + [np.arange(65_536, dtype=np.uint16)]
    back = token_files.decode_blocks(token_files.encode_blocks(blocks))
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))


def test_each_block_is_coded_from_the_same_fresh_model():
    ids = np.arange(50, dtype=np.uint16).repeat(4)
    payload = token_files.encode_blocks([ids, ids[::-1], ids])
    _, at = token_files.Table.unpack(payload)
    codes = []
    while at < len(payload):
        _, size, _ = token_files._header(payload, at)
        codes.append(payload[at : at + token_files.HEADER.size + size])
        at += token_files.HEADER.size + size
    assert len(codes) == 3 and codes[0] == codes[2] != codes[1]
    (alone,) = token_files.decode_blocks(token_files.encode_blocks([ids, ids[::-1], ids])[: -sum(map(len, codes))] + codes[1])
    assert (alone == ids[::-1]).all()


def test_blocks_beat_order_0_and_deflate(corpus):
    """Bytes a token on the corpus's own texts, with the chunk's table."""
    ids = np.concatenate([token_files.load(P.path("byte_bpe_50k.json")).encode(r.text) for r in corpus.select("text").collect()])
    blocks = [ids[i : i + token_files.BLOCK] for i in range(0, len(ids), token_files.BLOCK)]
    count = np.bincount(ids)[np.bincount(ids) > 0]
    entropy = -(count * np.log2(count / len(ids))).sum() / 8 / len(ids)
    deflated = sum(len(compress(b.astype("<u2").tobytes(), 9)) for b in blocks) / len(ids)
    own = len(token_files.encode_blocks(blocks)) / len(ids)
    assert own < min(entropy, deflated), (own, entropy, deflated)


def test_blocks_shrink_and_check():
    rng = random.Random(1)
    ids = np.array([rng.choice([5, 77, 300, 41_000]) for _ in range(token_files.BLOCK)], np.uint16)
    code = token_files.encode_blocks([ids])
    assert len(code) < len(ids)  # half of the raw size
    for i in (0, 13, 20, len(code) // 2):
        bad = bytearray(code)
        bad[i] ^= 1
        with pytest.raises(ValueError):
            token_files.decode_blocks(bytes(bad))


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60) | st.text(alphabet="ab \n'1é", max_size=40) | st.text(alphabet="ab \n\t日\xa0.", max_size=40))
def test_pieces_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    encoder = token_files.load(P.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert encoder.encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_caches_turn_over(monkeypatch):
    monkeypatch.setattr(token_files, "CACHE_SIZE", 8)
    encoder, rng = token_files.Encoder(P.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "bee", "see,", "(dee)", "e.\nFx", "x" * 60, "über"]) + rng.choice(["", "s", "'s", "1"]) for _ in range(rng.randint(1, 12)))
        assert encoder.encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_wide_ids_are_refused():
    with pytest.raises(ValueError, match="65,536"):
        token_files._short([65_536])
