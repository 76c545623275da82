import json

import pytest

from quillmesh.operators import flatten as f

S = "manifest_id long, raw string, record_id string, value string"


def sections(spark, *raws):
    df = spark.createDataFrame([(i, r, "clash", None) for i, r in enumerate(raws)], S)
    return sorted(tuple(r) for r in f.manifest_sections(df).collect())


def test_spellings(spark):
    sec = {"id": "a", "sections": [None, {"id": 31, "sections": {"x": {}, "y": {"id": None}}}, "see", {"id": 1.50}]}
    m = {"title": "t", "sections": [sec]}
    want = [("0", "", "a"), ("0.1", "0", "31"), ("0.1.0", "0.1", "x"), ("0.1.1", "0.1", "y"), ("0.3", "0", "1.5")]
    text = json.dumps(m)
    raws = [text, "﻿" + text, json.dumps(text), json.dumps({"manifest": m}), json.dumps({"title": "t", "sections": json.dumps([sec])})]
    assert sections(spark, *raws) == [(i, *w) for i in range(5) for w in want]
    assert sections(spark, '{"sections": {"id": "one", "heading": "h"}}', '{"sections": {"k": {"heading": "h"}}}') == [(0, "0", "", "one"), (1, "0", "", "k")]
    assert sections(spark, '{"sections": [{"id": 1.50e3}, {"id": true}, {"id": "\\ud83d"}]}') == [(0, "0", "", "1.50e3"), (0, "1", "", "true"), (0, "2", "", "�")]


def test_no_records(spark):
    assert sections(spark, None, "", "{", "null", "[]", "3", '{"title": "t"}', '{"a": {"sections": []}, "b": 1}', '{"sections": NaN}', '{"sections": {}}', '{"sections": 5}') == []
    assert sections(spark) == []


def test_layout_and_foreign_keys(spark):
    m = {"title": "t", "meta": {"by": "x"}, "tags": ["p"], "sections": [{"id": "a", "tags": ["q", "r"], "links": [{"node_id": "n"}], "sections": [{"id": "b", "links": []}]}]}
    df = spark.createDataFrame([(7, json.dumps(m))], "manifest_id long, raw string")
    plan = f.layout(df, "raw", "manifest", "sections")
    assert plan.tables == {"manifest": "root", "sections": "recursive", "tags": "repeated", "links": "repeated"}
    rows = f.shred(df, "manifest_id", "raw", plan)
    assert [tuple(r) for r in f.flat_table(rows, "manifest", ["title", "meta_by"]).select("pos_path", "parent_path", "title", "meta_by").collect()] == [("", None, "t", "x")]
    assert {tuple(r) for r in f.flat_table(rows, "tags", []).select("pos_path", "parent_table", "parent_path", "value").collect()} == {("0", "manifest", "", "p"), ("0.0", "sections", "0", "q"), ("0.1", "sections", "0", "r")}
    assert [tuple(r) for r in f.flat_table(rows, "links", ["node_id"]).select("parent_path", "node_id").collect()] == [("0", "n")]


def test_long_record(spark):
    m = {"sections": [{"id": str(i), "content": "x" * 1000} for i in range(25_000)]}
    assert len(sections(spark, json.dumps(m))) == 25_000


def test_no_cap_on_nesting(spark):
    deep = '{"sections": ' + '[{"id": "x", "sections": ' * 60_000 + "[]" + "}]" * 60_000 + "}"
    wrapped = json.dumps({"sections": [{"id": "w"}]})
    for _ in range(11):
        wrapped = json.dumps(wrapped)
    wide = json.dumps({"sections": [{"id": "a", "content": {"deep": json.loads("[" * 50 + "1.50" + "]" * 50, parse_float=str)}}]})
    got = sections(spark, wrapped, wide)
    assert got == [(0, "0", "", "w"), (1, "0", "", "a")]
    ok, value = f.parse_json(deep)
    assert ok and f.as_text(value) == deep
    assert not f.parse_json(deep[:-1])[0]
    assert f.as_text(f.parse_json('{"a": [1.50, "x", null, true]}')[1]) == '{"a": [1.50, "x", null, true]}'


def test_too_many_fields_are_refused(spark):
    df = spark.createDataFrame([(1, json.dumps({"sections": [], **{f"k{i}": {} for i in range(30)}}))], "manifest_id long, raw string")
    assert f.layout(df, "raw", "manifest", "sections", 100).tables["sections"]
    with pytest.raises(ValueError):
        f.layout(df, "raw", "manifest", "sections", 10)
