"""USFM files that are split, files without verses, and ordinals over many parts."""

from pyspark.sql import functions as F

from lectern.operators import order
from lectern.sources import readers


def verses(df):
    return sorted((r.book, r.chapter, r.verse, r.text) for r in df.collect())


def test_split_files_are_whole_files(spark, tmp_path):
    """Chapters that come again, markers that begin like a chapter's, spans, several files, many tasks."""
    chapter = lambda k, extra="": f"\\c {k}\n\\cl Part {k}\n\\p\n" + "".join(f"\\v {v} text {k}:{v}{extra} \\f + note {v}\\f* \\cd day\n\\q1 more\n" for v in range(1, 40))
    (tmp_path / "58-PHM.usfm").write_text("\\id PHM\n" + chapter(3, " old") + "".join(map(chapter, range(1, 300))) + "\\c 7\n\\v 1 last\n")
    (tmp_path / "59-HEB.usfm").write_text("no chapter \\cl x" + chapter(2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = readers.usfm_verses_of_large_files(spark, str(tmp_path))
        assert spark.read.option("lineSep", "\\c").text(str(tmp_path)).rdd.getNumPartitions() > 5
        assert verses(got) == verses(readers.usfm_verses(spark, str(tmp_path))) and got.count() == 298 * 39 + 1 + 39
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_without_verses(spark, tmp_path):
    for name, text in (("a", ""), ("b", " \n"), ("c", "\\v 1 text"), ("d", "\\c 1\n\\v 1 \\p"), ("e", "\\c 1\n\\v 1 text")):
        (tmp_path / f"{name}.usfm").write_text(text)
    got = {r.file: r.reason for r in readers.unreadable_usfm(spark, str(tmp_path)).collect()}
    assert got == {"b.usfm": "empty", "c.usfm": "no chapter", "d.usfm": "no verse with text"} | ({"a.usfm": "empty"} if "a.usfm" in got else {})


def test_ordinals(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("third"))
    got = order.numbered(rows.repartition(7), "third", F.desc("k"), name="n", first=1)
    want = {(r.third, r.k): i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r.third, -r.k)))}
    assert {(r.third, r.k): r.n for r in got.collect()} == want and got.columns == ["k", "third", "n"]
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert order.numbered(rows.limit(0), "k").count() == 0
