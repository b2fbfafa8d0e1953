"""What a task or a row holds doesn't grow with the input."""

import json

import pyarrow as pa
import pytest

from lectern import session
from lectern.functions import usfm
from lectern.operators import lookup, report, workflow
from lectern.plans import adapters, catalogue
from lectern.sources import readers, sinks
from tests.oracle import same


def plan(df):
    return df._jdf.queryExecution().toString()


def test_report_is_read_by_lines(spark, sf, tmp_path):
    """Over many splits; equal to the one document. No row holds more than a segment."""
    rows, debates = adapters.individual(spark, sf), adapters.debates(spark, sf)
    sinks.ordered_text(report.document_parts(rows, debates, "B", "C"), str(tmp_path / "r"), "part", "ord")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = readers.report_of_parts(spark, str(tmp_path / "r")).orderBy("pos").collect()
        assert spark.read.text(str(tmp_path / "r")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = json.loads(report.document(rows, debates, "B", "C").first().json)
    assert [r.pos for r in got] == list(range(len(want["analysis"]))) and {(r.book, r.chapter, r.category) for r in got} == {("B", 1, "C")}
    assert [(r.segment.verse, r.segment.greek, r.segment.notes, len(r.segment.analysis)) for r in got] == [(s["verse"], s["greek"], s["notes"], len(s["analysis"])) for s in want["analysis"]]
    assert "collect_list(struct(file" not in plan(catalogue.report_whole(spark, sf))


@pytest.mark.parametrize("lines", [['{"verse":1}', "]}"], ['{"book":"B","analysis":[', '{"verse":1}', '{"verse":2}', "]}"], ['{"book":"B","analysis":[', '{"verse":1}', ',{"verse":2}'], ['{"book":"B","analysis":[', '{"verse":1}', "]}", ',{"verse":2}', "]}"]])
def test_parts_that_are_no_report(spark, tmp_path, lines):
    (tmp_path / "part-0").write_text("\n".join(lines) + "\n")
    with pytest.raises(Exception, match="no line of a report|MALFORMED|BAD_RECORD"):
        readers.report_of_parts(spark, str(tmp_path)).collect()


def test_report_without_segments(spark, tmp_path):
    (tmp_path / "part-0").write_text('{"book":"B","chapter":1,"category":"C","analysis":[\n]}\n')
    assert readers.report_of_parts(spark, str(tmp_path)).collect() == []


def test_large_files_are_several(spark, sf, monkeypatch):
    """A task writes a file, so files end at a size."""
    monkeypatch.setattr(catalogue, "LARGE_FILE", 64 << 10)
    got = catalogue.usfm_large_file(spark, sf)
    assert len([x for x in got.inputFiles() if "lectern-large" in x]) > 2
    same(got, catalogue.SQL["usfm_large_file"], sf)


def test_render_in_one_exchange(spark):
    rows = spark.createDataFrame([("a", 2, 1, "x"), ("a", 1, 2, "y\\z"), ("a", 1, 1, None), ("a", 1, 10, "w"), ("a", 3, 1, None), ("b", 1, 1, "v"), ("c", None, 1, "u")], "book string, chapter int, verse int, text string")
    made = usfm.render(rows, ["book"])
    assert {r.book: r.content for r in made.collect()} == {"a": "\\c 1\n\\v 2 y z\n\\v 10 w\n\\c 2\n\\v 1 x\n\\c 3\n", "b": "\\c 1\n\\v 1 v\n", "c": ""}
    assert usfm.render(rows, ["book"])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_workers_hold_few_rows():
    """Of a batch of any size; texts pass as Arrow columns."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    got = list(workflow.pieces(iter([batch, batch.slice(0, 0)])))
    assert max(b.num_rows for b in got) == workflow.ROWS and [v for b in got for v in b.column("x").to_pylist()] == list(range(1000))


def test_texts_move_once_a_verse(spark, sf):
    """Of the reviews only the first one's texts are gathered, and a session's batches are bounded by bytes."""
    rows = adapters.individual(spark, sf, multi=True)
    verses = workflow.debatable_verses(rows)
    assert verses.schema["reviews"].dataType.elementType.names == ["row_ord", "agent_name", "score", "model_analysis"]
    want = {(r.chapter, r.verse): (r["first"].greek_text, r["first"].translation, r["first"].face_annotation, r.n) for r in lookup.debatable(rows).collect()}
    assert {(r.chapter, r.verse): (r.greek_text, r.translation, r.face_annotation, len(r.reviews)) for r in verses.collect()} == want
    workflow.debates(rows, workflow.StubScorer())
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= session.BATCH_BYTES


def test_reports_are_dealt_out_once(spark, sf):
    """By chapter, each table once; segments, join and documents stay there."""
    rows = sinks.materialise(adapters.individual(spark, sf), "reviews")
    debates = sinks.materialise(adapters.debates(spark, sf), "held")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = report.documents(rows, debates, "B", "C")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert made.count("Exchange hashpartitioning") == 2
    assert all(".zstd." in x for x in rows.inputFiles())


def test_files_are_judged_where_they_are_read(spark, sf):
    """Folders are written by many tasks, and files are read once, without an exchange."""
    got = catalogue.usfm_files_rejected(spark, sf)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    written = [x for x in got.inputFiles() if "lectern-rejected" in x]
    assert len({x.split("/part-")[1][:5] for x in written}) > 1
