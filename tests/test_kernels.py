import json

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataquery.functions import columns as C
from strataquery.functions import kernels as K


def test_fingerprint_golden():
    assert K.fingerprint(b"") == "H1" + "0" * 68
    assert K.fingerprint(b"gitkeep123") == "H17f1c0000000030000000c00000000c0000000000030ccc000000000c000000000000"
    a, b = K.fingerprint(b"gitkeep123"), K.fingerprint(b"0123456789")
    assert K.fingerprint_distance(a, b) == 85
    assert K.fingerprint_distance(a, "nonsense") == K.fingerprint_distance(None, a) == 801
    assert K.fingerprint_distance(a, a) == 0


@given(st.lists(st.binary(max_size=300), min_size=1, max_size=6))
def test_distances_match_one_by_one(contents):
    prints = [K.fingerprint(c) for c in contents] + ["bad", None]
    a, b = pd.Series(prints), pd.Series(prints[::-1])
    assert K.distances(a, b).tolist() == [K.fingerprint_distance(x, y) for x, y in zip(a, b, strict=True)]


def test_confidence_is_size_aware(spark):
    df = spark.createDataFrame([(85, 10, 10), (0, 10, 10), (900, 5000, 5000), (47, 1080, 1130)], "d long, a long, b long")
    got = [r[0] for r in df.select(C.confidence(F.col("d"), C.most_distance(F.col("a"), F.col("b")))).collect()]
    assert got == pytest.approx([0.34108527, 1.0, 0.0, 0.9413233458177278])


def test_ids_count_up_within_a_millisecond():
    m = K.IdMinter(now=lambda: 1_700_000_000_000, chance=lambda: (1 << 80) - 2)
    ids = [m.mint() for _ in range(4)]
    assert ids == sorted(set(ids)) and all(map(K.is_id, ids))
    assert [K.id_millis(i) for i in ids] == [1_700_000_000_000] * 2 + [1_700_000_000_001] * 2
    assert not K.is_id("I" * 26) and not K.is_id("0" * 25)
    with pytest.raises(ValueError):
        K.id_millis("x")


def test_json_is_found_in_prose():
    assert K.extract_json('```json\n[{"a": 1}]\n```') == [{"a": 1}]
    assert K.extract_json("none here") is None and K.extract_json("[1, 2") is None
    assert K.extract_json('so {"a": [1]} it is') == {"a": [1]}


def test_descriptions_are_clamped():
    d = K.clean_description({"title": " " + "x" * 99, "description": "y" * 3000, "concepts": [" A ", 1, "", "b", "c", "d", "e", "f"]}, "f.py")
    assert len(d["title"]) == 80 and len(d["description"]) == 2000 and json.loads(d["concepts"]) == ["a", "b", "c", "d", "e"]
    assert K.clean_description({}, "f.py")["title"] == "f.py" and K.clean_description([], "f") is None
    assert K.utf16_left("a😀b", 2) == "a" and K.utf8_left("aé", 2) == "a"


def test_answers_by_id_or_place():
    assert K.match_answers([{"id": "b", "t": 1}], ["a", "b"]) == {"b": {"id": "b", "t": 1}}
    assert list(K.match_answers([{"t": 1}, {"t": 2}], ["a", "b"])) == ["a", "b"]
    assert K.match_answers([{"t": 1}], ["a", "b"]) == {} and K.match_answers("x", ["a"]) == {}


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [
        ("*.log", "a/b.log", True), ("/x", "a/x", False), ("/x", "x/y", True), ("dist/", "dist/app.js", True), ("dist/", "dist", None), ("a/**/b", "a/x/y/b", True), ("a/**/b", "a/b", True),
        ("*.log\n!keep.log", "keep.log", False), ("# c\n\n", "c", None), ("\\#x", "#x", True), ("?.md", "ab.md", None), ("?.md", "a.md", True), ("**/**/**/z", "q/z", True), ("a.b", "axb", None),
    ],
)
def test_ignore_rules(rules, path, ignored):
    got = K.decide(K.ignore_rules(rules), path)
    assert got is ignored or (ignored is False and not got)


def test_deeper_rules_win():
    files = {"": K.ignore_rules("*.txt"), "docs": K.ignore_rules("!a.txt")}
    assert K.decide_nested(files, "x/a.txt") and not K.decide_nested(files, "docs/a.txt")


def test_scalars(spark):
    row = spark.createDataFrame([("src/.gitignore", "A/b.TXT", "../x", "git@Host.com:Org/Repo.git", "Bearer abc, api_key=xyz ok", '["a",1,"b"]', "no")], "a string, b string, c string, u string, m string, j string, k string").select(
        C.extension(F.col("a")).alias("e0"), C.extension(F.col("b")).alias("e1"), C.is_safe_path(F.col("c")).alias("s0"), C.is_safe_path(F.col("b")).alias("s1"), C.canonical_remote(F.col("u")).alias("r"),
        C.redact(F.col("m")).alias("m"), C.parse_concepts(F.col("j")).alias("j"), C.parse_concepts(F.col("k")).alias("k"), C.sha256_hex(F.lit("abc")).alias("h"),
    ).first()
    assert (row.e0, row.e1, row.s0, row.s1, row.r) == ("", "txt", False, True, "host.com/org/repo")
    assert row.m == "[REDACTED], [REDACTED] ok" and row.j == ["a", "b"] and row.k == []
    assert row.h == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_limits():
    assert [C.clamp_limit(x) for x in (None, float("nan"), 0, 50, 999, 2.9, True)] == [20, 20, 20, 50, 200, 2, 20]


def test_origin_url():
    assert K.origin_url('[core]\n a = b\n[remote "origin"]\n\turl = git@x:y.git\n[remote "up"]\nurl = z') == "git@x:y.git"
    assert K.origin_url("[core]\nurl = z") == ""


def test_outer_limits(spark):
    assert C.checked_limit(None) == 20 and C.checked_limit(999) == 200
    for bad in (0, -1, 1.5, "3", True):
        with pytest.raises(ValueError):
            C.checked_limit(bad)
    assert spark.createDataFrame([("a\n" * 60,)], "t string").select(C.truncate_cell(F.col("t"))).first()[0].endswith("…")
