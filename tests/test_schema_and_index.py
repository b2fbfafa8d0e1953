"""The compiled report schema, and the index that is rewritten by buckets."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.functions import jsonschema
from lectern.operators import quality, report, views
from lectern.plans import adapters, catalogue
from lectern.sources import sinks
from lectern.streaming import reports as index

GOOD = {"book": "b", "chapter": 1, "category": "c", "analysis": [{"verse": 1, "greek": "g", "translation": "t", "annotation": "a", "analysis": [{"type": "individual", "model": "m", "score": 3, "reasoning": "r"}, {"type": "debate", "score": 0, "debate_transcript": [{"role": "moderator", "agent": "M", "intervened": True, "violators": ["A"]}], "closing_statements": [{"agent": "A", "statement": "", "score": 1}]}]}]}


def found(spark, *documents):
    texts = [x if x is None or isinstance(x, str) else json.dumps(x) for x in documents]
    rows = quality.breaches(spark.createDataFrame(list(enumerate(texts)), "i int, content string"))
    return sorted((r.i, r.pointer, r.rule, r.detail, r.part) for r in rows.collect())


def test_report_breaches(spark):
    faulty = json.loads(json.dumps(GOOD))
    segment = faulty["analysis"][0]
    segment["verse"], segment["analysis"][0]["score"] = "1", 11
    segment["analysis"][1] |= {"score": 2.5, "closing_statements": {}}
    segment["analysis"][1]["debate_transcript"] += [{"role": "judge", "agent": None, "proposed_score": None, "violators": ["x", 3]}, None]
    segment["analysis"] += [{"type": "other"}, {"model": "m"}, 5]
    faulty["analysis"].append(None)
    assert found(spark, GOOD, faulty, "no json", None, {}, "[]") == [
        (1, "/analysis/0/analysis/0/score", "maximum", "11", "L3"),
        (1, "/analysis/0/analysis/1/closing_statements", "type", "object", "L4"),
        (1, "/analysis/0/analysis/1/debate_transcript/1/agent", "type", "null", "L5"),
        (1, "/analysis/0/analysis/1/debate_transcript/1/role", "enum", '"judge"', "L5"),
        (1, "/analysis/0/analysis/1/debate_transcript/1/violators/1", "type", "number", "L5"),
        (1, "/analysis/0/analysis/1/debate_transcript/2", "type", "null", "L5"),
        (1, "/analysis/0/analysis/1/score", "type", "number", "L4"),
        *((1, f"/analysis/0/analysis/{k}", "oneOf", "no branch fits", "L2") for k in (2, 3, 4)),
        (1, "/analysis/0/verse", "type", "string", "L2"),
        (1, "/analysis/1", "type", "null", "L2"),
        (2, "", "json", "no json", ""),
        *((4, f"/{k}", "required", "missing", "L1") for k in ("analysis", "book", "category", "chapter")),
        (5, "", "type", "array", "L1"),
    ]


def test_schema_keywords(spark):
    schema = {"type": "object", "properties": {"a/b~": {"type": ["integer", "null"]}, "n": {"oneOf": [{"type": "integer"}, {"type": "number"}, {"type": "string"}]}, "e": {"enum": [1, "x", None]}}, "additionalProperties": False}
    cells = ['{"a/b~": "x", "n": 1}', '{"n": 1.5, "z~/": 1}', '{"n": "s", "a/b~": null, "e": "x"}', '{"n": true, "a/b~": 2.0, "e": "y"}', '{"e": null}', None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", F.inline(jsonschema.breaches("try_parse_json(c)", schema)))
    assert sorted((r.c, r.pointer, r.rule, r.detail) for r in rows.collect()) == sorted([
        (cells[0], "/a~1b~0", "type", "string"), (cells[0], "/n", "oneOf", "2 branches fit"), (cells[1], "/z~0~1", "additionalProperties", "z~/"),
        (cells[3], "/n", "oneOf", "no branch fits"), (cells[3], "/e", "enum", '"y"'),
    ])
    with pytest.raises(ValueError, match="pattern"):
        jsonschema.breaches("x", {"pattern": "a"})
    with pytest.raises(ValueError, match="itself"):
        jsonschema.breaches("x", {"$ref": "#/definitions/a", "definitions": {"a": {"$ref": "#/definitions/a"}}})


def test_schema_of_a_type(spark):
    """What Spark writes of a type has no breach of its schema."""
    kind = T.StructType([T.StructField("n", T.IntegerType(), False), T.StructField("t", T.StringType()), T.StructField("l", T.ArrayType(T.StructType([T.StructField("b", T.BooleanType(), False)]), False))])
    rows = spark.createDataFrame([(1, None, [(True,)]), (2, "x", None)], kind).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("c"))
    assert rows.select(F.inline(jsonschema.breaches("parse_json(c)", jsonschema.of_type(kind)))).count() == 0
    assert set(schemas.ANSWERS) == {"linguist_review", "critic_review", "linguist_turn", "moderator_turn"}


@pytest.mark.parametrize("name", ["quality_violations", "schema_breaches"])
def test_one_pass(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1


def reports(spark, *files):
    rows = [(o, "b", c, "c", [(v, g, None, None, None, []) for v, g in items]) for o, c, items in files]
    return spark.createDataFrame(rows, T.StructType([T.StructField("file_ord", T.IntegerType()), *schemas.REPORT.fields]))


def state(spark, path):
    return {(r.chapter, r.verse): r.segment.greek for r in index.snapshot(spark, path).collect()}


def files(path):
    return {str(x.relative_to(path)) for x in Path(path).rglob("*.parquet")}


def test_index_rewrites_touched_buckets_only(spark, tmp_path):
    path, n = str(tmp_path / "index"), 32
    index.merge(spark, path, reports(spark, *[(c, c, [(v, f"old {c}:{v}") for v in range(1, 30)]) for c in range(1, 10)]), 0, buckets=n)
    want = {(c, v): f"old {c}:{v}" for c in range(1, 10) for v in range(1, 30)}
    first = files(path)
    assert state(spark, path) == want and len(first) == n
    touched = index.merge(spark, path, reports(spark, (1, 3, [(5, "a"), (5, "new")]), (0, 4, [(1, "late")])), 1, buckets=7)
    want |= {(3, 5): "new", (4, 1): "late"}
    assert state(spark, path) == want and len(touched) <= 2
    assert len(files(path) - first) == len(touched) and first <= files(path)  # the last batch but one is still whole
    assert {(r.chapter, r.verse): r.segment.greek for r in index.snapshot(spark, path, before=1).collect()}[3, 5] == "old 3:5"
    index.merge(spark, path, reports(spark, (1, 3, [(5, "again")])), 1)  # the same batch once more
    assert state(spark, path)[3, 5] == "again" and state(spark, path)[4, 1] == "old 4:1"
    index.merge(spark, path, reports(spark, (1, 3, [(5, "last")])), 2)
    assert state(spark, path) == want | {(3, 5): "last", (4, 1): "old 4:1"}
    assert len(files(path)) <= n + 1 and len([x for x in Path(path).iterdir() if x.name.startswith("manifest")]) == 2
    assert index.merge(spark, path, reports(spark, (1, 0, [(5, "none")])), 3) == [] and state(spark, path)[3, 5] == "last"


def test_point_lookup_reads_one_bucket(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.snapshot(spark, path) is None and index.segment_of(spark, path, 1, 1).count() == 0
    index.merge(spark, path, reports(spark, *[(c, c, [(v, f"{c}:{v}") for v in range(1, 60)]) for c in range(1, 20)]), 0, buckets=16)
    one = index.segment_of(spark, path, 7, 9)
    assert [r.segment.greek for r in one.collect()] == ["7:9"] and len(one.inputFiles()) == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(chapter), IsNotNull(verse), EqualTo(chapter,7), EqualTo(verse,9)]" in plan
    held = [(r.chapter, r.verse) for r in spark.read.parquet(one.inputFiles()[0]).collect()]
    assert held == sorted(held) and len(held) > 20


def test_report_in_parts(spark, sf, tmp_path):
    """The parts one after the other are the document; no row holds more than a segment."""
    rows, debates = adapters.individual(spark, sf), adapters.debates(spark, sf)
    parts = report.document_parts(rows, debates, "B", "C")
    assert "collect_list(struct(part" not in parts._jdf.queryExecution().toString()
    sinks.ordered_text(parts, str(tmp_path / "r"), "part", "ord")
    whole = "".join("".join(x.read_text().split("\n")) for x in sorted((tmp_path / "r").glob("part-*")))
    got = json.loads(whole)
    assert got == json.loads(report.document(rows, debates, "B", "C").first().json) and got["chapter"] == 1
    assert [s["greek"] for s in got["analysis"]] == [r.greek_text for r in report.segments(rows).orderBy("ord").collect()]
    assert json.loads(report.document(rows.limit(0), debates, "B", "C").first().json) == {"book": "B", "chapter": 1, "category": "C", "analysis": []}


def test_index_of_files_needs_no_window(spark, tmp_path):
    from lectern.sources import readers

    (tmp_path / "a.json").write_text(json.dumps(GOOD))
    plan = views.index(readers.reports(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Scan json") == 1


def test_bucketed_tables_join_where_they_are(spark, sf):
    """No exchange in a join of all verses, though nothing is broadcast."""
    keys = ["chapter", "verse"]
    verses = sinks.bucketed(adapters.truth(spark, sf).select(*keys, F.col("greek_text").alias("text")), "verses", keys, 8)
    found = sinks.bucketed(views.index(adapters.reports(spark, sf)), "index", keys, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = views.detail(verses, found)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in whole and "Exchange" not in whole and "SelectedBucketsCount: 8 out of 8" in whole
    assert [r.verse for r in views.detail(verses, found, 2, 3).collect()] == [3]
