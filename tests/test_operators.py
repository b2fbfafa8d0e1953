"""Lookups, reports, workflows, views and sources on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import schemas
from lectern.operators import lookup, quality, report, views, workflow
from lectern.plans import batch
from lectern.sources import readers, sinks
from lectern.streaming import reports as streaming


def individual(spark, *rows):
    """(chapter, verse, greek, face, score, row_ord)"""
    data = [("m", f"A{o % 2}", c, v, g, f"t{o}", f, "n", s, f"r{o}", o) for c, v, g, f, s, o in rows]
    return spark.createDataFrame(data, schemas.INDIVIDUAL)


def debate(spark, *rows):
    """(verse, greek, face, scores, row_ord)"""
    return spark.createDataFrame([(1, v, f, g, "", "[]", json.dumps(["Now we transition", *(json.dumps({"agent_name": "A", "argument": "x", "proposed_score": s}) for s in scores)]), o) for v, g, f, scores, o in rows], schemas.DEBATES)


def test_groups(spark):
    rows = individual(spark, (1, 1, "a", "f", 3, 0), (1, 1, "a", "f", 4, 1), (1, 2, "b", "f", 3, 2), *[(1, 3, "c", "f", 3, o) for o in range(3, 7)], (None, 4, "d", "f", 1, 8), (None, 4, "d", "f", 1, 9))
    assert [(r.chapter, r.verse) for r in lookup.debatable(rows).collect()] == [(1, 1)]
    assert sorted((r.verse, r.n) for r in lookup.skipped(rows).collect()) == [(2, 1), (3, 4)]
    held = workflow.debates(rows, workflow.StubScorer()).collect()
    assert len(held) == 1 and len(json.loads(held[0].debate)) == 6 and len(json.loads(held[0].closing_statements)) == 3
    assert workflow.debates(rows.filter("verse = 2"), workflow.StubScorer()).collect() == []


def test_segments_and_debates(spark):
    rows = individual(spark, (1, 1, "a", "f", 3, 5), (1, 1, " a", "f", 4, 1), (1, 1, "b", None, 4, 2), (1, 2, None, "f", 4, 3), (1, None, "z", "f", 4, 4), (1, 1, "a", "f", 6, 6))
    talks = debate(spark, (1, "a ", "f", [5, 4], 9), (1, "a", " f", [1], 10), (1, "b", None, [2], 1))
    got = {(r.greek_text, r.face_annotation): (r.ord, r.has_debate, r.consensus, [e.score for e in r.entries]) for r in report.joined(rows, talks).collect()}
    assert got == {("a", "f"): (5, True, 4, [3, 6]), (" a", "f"): (1, True, 4, [4]), ("b", "Uncategorized"): (2, False, None, [4])}


def test_no_score_is_zero(spark):
    got = report.joined(individual(spark, (1, 1, "a", "f", 3, 0)), debate(spark, (1, "a", "f", [None, None], 0))).first()
    assert got.consensus == 0 and [c.score for c in got.closings] == [None, None]


def test_document(spark):
    rows = individual(spark, (2, 1, "α \"q\"", "f", 3, 1), (2, 1, "b", None, 4, 0))
    text = report.document(rows, debate(spark, (1, "α \"q\"", "f", [5, None], 0)), "Philemon", "Letters").first().json
    got = json.loads(text)
    assert (got["book"], got["chapter"], got["category"]) == ("Philemon", 2, "Letters")
    assert [s["greek"] for s in got["analysis"]] == ["b", 'α "q"'] and "α" in text
    individual_entry, talk = got["analysis"][1]["analysis"]
    assert individual_entry == {"type": "individual", "model": "m", "score": 3, "reasoning": "r1"}
    assert talk["score"] == 5 and talk["closing_statements"][1] == {"agent": "A", "statement": "x", "score": None} and talk["debate_transcript"] == []
    empty = json.loads(report.document(individual(spark), debate(spark), "B", "C").first().json)
    assert empty == {"book": "B", "chapter": 1, "category": "C", "analysis": []}


@pytest.mark.parametrize("partitions", [1, 8])
def test_order_comes_from_row_ord(spark, partitions):
    rows = individual(spark, *[(1, i % 5, f"g{i % 7}", "f", i % 10, i) for i in range(100)]).orderBy(F.rand(partitions)).repartition(partitions)
    got = {(r.verse, r.greek_text): (r.ord, [e.row_ord for e in r.entries]) for r in report.segments(rows).collect()}
    assert all(ords == sorted(ords) and first == ords[0] for first, ords in got.values()) and len(got) == 35


class Reviewer(workflow.StubScorer):
    def __init__(self, *said):
        self.said = said

    def score(self, agent, prompt):
        return json.dumps({"score": 5, "reasoning": "v0"})

    def review(self, agent, analysis, round_):
        return self.said[round_]

    def revise(self, agent, analysis, reason, round_):
        return json.dumps({"score": 5, "reasoning": f"v{round_ + 1}"})


YES, NO = '{"accepted": "yes", "reasoning": "r"}', '{"accepted": false, "reasoning": "r"}'


@pytest.mark.parametrize(("said", "last", "outcome"), [((YES,), "v0", "accepted"), ((NO, NO, NO), "v3", "exhausted"), (("no json",), "v0", "unparsable"), ((NO, '{"accepted": "maybe", "reasoning": "r"}'), "v1", "unparsable"), ((NO, NO, YES), "v2", "accepted")])
def test_review_loop(said, last, outcome):
    analysis, revisions, got, history = workflow.reviewed_analysis(Reviewer(*said), "A", "p")
    assert (json.loads(analysis)["reasoning"], f"v{revisions}", got) == (last, last, outcome)


def test_strict_lookup(spark):
    truth = spark.createDataFrame([(1, 1, "g", "f", "n", 0), (1, 2, "g", "f", "n", 1)], schemas.GROUND_TRUTH)
    verses = spark.createDataFrame([("PHM", 1, 1, "text")], "book string, chapter int, verse int, text string")
    with pytest.raises(Exception, match="no translation of PHM 1:2"):
        lookup.with_translation(truth, verses).select("chapter").collect()
    assert lookup.with_translation(truth, verses, "skip").count() == lookup.translated(truth, verses).count() == 1
    with pytest.raises(Exception, match="chapter is no integer"):
        lookup.strict_keys(spark.createDataFrame([("x",)], "chapter string"), "chapter").collect()


def test_batch_run(spark):
    truth = spark.createDataFrame([(1, v, f"g{v}", "f", None, v) for v in (1, 2, 3)], schemas.GROUND_TRUTH)
    verses = spark.createDataFrame([("PHM", 1, v, f"text {v}") for v in (1, 2, 3)], "book string, chapter int, verse int, text string")
    opened, held, made = batch.run(truth, verses)
    assert opened.count() == 6 and held.count() == 3
    got = json.loads(made.first().json)
    assert [[e["type"] for e in s["analysis"]] for s in got["analysis"]] == [["individual", "individual", "debate"]] * 3
    reports = made.select(F.from_json("json", schemas.REPORT).alias("r")).select("r.*")
    assert quality.violations(reports).filter("rule <> 'L2'").collect() == []


def reports(spark, *rows):
    """(chapter, [(verse, greek)], file_ord)"""
    data = [("b", c, "k", items and [(v, g, "t", "a", "n", [("debate", None, 0, None, [], [])]) for v, g in items], o) for c, items, o in rows]
    return spark.createDataFrame(data, schemas.T.StructType([*schemas.REPORT.fields, schemas.T.StructField("file_ord", schemas.T.LongType())]))


def test_index(spark):
    got = views.index(reports(spark, (1, [(1, "old"), (2, "kept"), (0, "none"), (None, "none")], 0), (1, [(1, "x"), (1, "new")], 1), (0, [(3, "rejected")], 2), (2, None, 3)))
    assert {(r.chapter, r.verse): r.segment.greek for r in got.collect()} == {(1, 1): "new", (1, 2): "kept"}


def test_detail(spark):
    found = views.index(reports(spark, (1, [(1, "g")], 0)))
    verses = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "chapter int, verse int, text string")
    assert views.detail(verses, found, 1, 1).first().debate.score == 0
    board = {r.verse: (r.debate_score, r.score, r.band, r.width) for r in views.scoreboard(verses, views.index_scores(found)).collect()}
    assert board == {1: (0, None, "1", None), 2: (None, None, "none", None)}


def test_csv_files(spark, tmp_path):
    rows = individual(spark, (1, 1, 'say "a,\nb"', None, 3, 0), (1, 2, "x\\", "f", 4, 1))
    names = {c.lower(): c for c in readers.INDIVIDUAL}
    sinks.csv(rows.select(*[F.col(c).alias(names.get(c, c)) for c in rows.columns]), str(tmp_path / "a"))
    back = readers.individual(spark, str(tmp_path / "a")).orderBy("row_ord")
    assert [tuple(r) for r in back.select(*rows.columns).collect()] == [tuple(r) for r in rows.orderBy("row_ord").collect()]
    (tmp_path / "d.csv").write_text(',chapter,Verse,Face_Annotation,Greek_Text\n0,1,2,NA,α\n')
    got = readers.debates(spark, str(tmp_path / "d.csv")).first()
    assert (got.verse, got.face_annotation, got.greek_text, got.closing_statements, got.row_ord) == (2, None, "α", "[]", 0)
    with pytest.raises(ValueError, match="GreekText"):
        readers.ground_truth(spark, str(tmp_path / "d.csv"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.ground_truth(spark, str(tmp_path / "none.csv"))


def test_usfm_and_report_files(spark, tmp_path):
    (tmp_path / "58-PHM.usfm").write_text("\\c 1\n\\v 1 a\n", encoding="utf-8")
    assert [tuple(r) for r in readers.usfm_verses(spark, str(tmp_path / "58-PHM.usfm")).collect()] == [("PHM", 1, 1, "a")]
    (tmp_path / "r").mkdir()
    for name, greek in (("a", "one"), ("b", "two")):
        (tmp_path / "r" / f"{name}.json").write_text(json.dumps({"book": "b", "chapter": 1, "category": "c", "analysis": [{"verse": 1, "greek": greek}]}, indent=2))
    assert views.index(readers.reports(spark, str(tmp_path / "r"))).first().segment.greek == "two"


def test_stream(spark, tmp_path):
    source, index, state = (str(tmp_path / x) for x in ("source", "index", "state"))
    (tmp_path / "source").mkdir()
    for greek, verses in (("one", (1, 2)), ("two", (1,))):
        (tmp_path / "source" / f"{greek}.json").write_text(json.dumps({"book": "b", "chapter": 1, "category": "c", "analysis": [{"verse": v, "greek": greek} for v in verses]}))
        streaming.start(spark, source, index, state).awaitTermination(120)
    got = {r.verse: r.segment.greek for r in streaming.snapshot(spark, index).collect()}
    assert got == {1: "two", 2: "one"}


def test_markdown(spark):
    df = spark.createDataFrame([(1, "a|b\nc"), (2, None)], "n int, t string")
    assert sinks.markdown(df) == "| n | t |\n| --- | --- |\n| 1 | a\\|b c |\n| 2 |  |"


def test_rejected_report_files(spark, tmp_path):
    """A broken file is named, and the good ones stay."""
    good = {"book": "b", "chapter": 1, "category": "c", "analysis": [{"verse": 1, "greek": "one"}]}
    for name, text in (("a", json.dumps(good)), ("b", '{"chapter": 1,'), ("c", json.dumps(good | {"chapter": 0})), ("d", json.dumps(good | {"analysis": None}))):
        (tmp_path / f"{name}.json").write_text(text)
    assert {r.file: r.reason for r in readers.rejected(spark, str(tmp_path)).collect()} == {"b.json": "no JSON of a report", "c.json": "no chapter", "d.json": "no list of segments"}
    assert [r.segment.greek for r in views.index(readers.reports(spark, str(tmp_path))).collect()] == ["one"]


def test_ground_truth_keys(spark, tmp_path):
    (tmp_path / "g.csv").write_text("Chapter,Verse,GreekText,Face,Notes\n1, 2,a,f,n\n")
    assert readers.ground_truth(spark, str(tmp_path / "g.csv")).first().verse == 2
    for bad in (",2", "x,2"):
        (tmp_path / "b.csv").write_text(f"Chapter,Verse,GreekText,Face,Notes\n{bad},a,f,n\n")
        with pytest.raises(Exception, match="chapter is no integer"):
            readers.ground_truth(spark, str(tmp_path / "b.csv")).select("greek_text").collect()


def test_strict_answers(spark):
    """An analysis without a score fails the run, with the first 50 characters of the answer."""

    class Silent(workflow.StubScorer):
        def score(self, agent, prompt):
            return json.dumps({"reasoning": "r" * 80})

        def review(self, agent, history, round_):
            return "no review"

    truth = spark.createDataFrame([(1, 1, "g", "f", None, 1)], schemas.GROUND_TRUTH)
    verses = spark.createDataFrame([("PHM", 1, 1, "text")], "book string, chapter int, verse int, text string")
    with pytest.raises(Exception, match=r'no score or reasoning in: \{"reasoning": "r{35}[^r]'):
        batch.opening_statements(truth, verses, Silent()).select("score").collect()


def test_contexts_agree(spark):
    rows = individual(spark, (1, 1, "α", None, 3, 5), (1, 1, "b", "f", 4, 9))
    reviews = [r.asDict() for r in rows.orderBy("row_ord").collect()]
    assert lookup.debate_context(rows).first().context == workflow.debate_context(reviews)
