"""CSV, JSON and USFM readers. Every schema is stated; nothing is inferred.

A CSV file's rows keep their order in row_ord: with multi-line cells a file is one partition, and several files are
ordered by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import usfm
from lectern.functions.text import JS_SPACE, PY_CHARS, fail_if, missing_to_null, strict_keys
from lectern.schemas import REPORT, SEGMENT
from lectern.sources.sinks import materialise

# The columns of the files, as they are named there.
GROUND_TRUTH = {"Chapter": "int", "Verse": "int", "GreekText": "string", "Face": "string", "Notes": "string"}
INDIVIDUAL = {"Model": "string", "Agent_Name": "string", "Chapter": "int", "Verse": "int", "Greek_Text": "string", "Translation": "string", "Face_Annotation": "string", "Notes": "string", "Score": "int", "Model_Analysis": "string"}
DEBATES = {"Chapter": "int", "Verse": "int", "Face_Annotation": "string", "Greek_Text": "string", "Translation": "string", "Debate": "string", "Closing_Statements": "string"}
#: What a column that the file doesn't have holds; cells that are merely empty stay null.
ABSENT = {"Translation": "", "Notes": "", "Model": "Unknown", "Score": 0, "Model_Analysis": "", "Debate": "[]", "Closing_Statements": "[]"}


def _csv(spark: SparkSession, path: str, columns: dict[str, str], strict: tuple[str, ...] = ()) -> DataFrame:
    """Columns by header name, in any case; an unnamed index column and unknown ones are left out. The strict ones stay
    strings, for strict_keys()."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    have = {c.lower(): c for c in raw.columns}
    out = []
    for name, kind in columns.items():
        if name.lower() in have:
            c = missing_to_null(F.col(f"`{have[name.lower()]}`"))
        elif name in ABSENT:
            c = F.lit(ABSENT[name])
        else:
            raise ValueError(f"{path} has no column {name}")
        out.append((c if name in strict else c.cast(kind)).alias("greek_text" if name == "GreekText" else name.lower()))
    ordered = raw.select(*out, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("id"))
    first = ordered.groupBy("file").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = first.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(before, "file").withColumn("row_ord", F.col("before") + F.col("id") - F.col("first")).drop("file", "id", "first", "n", "before")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Rows without a chapter or verse fail the job, as those do whose chapter or verse is no integer."""
    return strict_keys(_csv(spark, path, GROUND_TRUTH, ("Chapter", "Verse")), "chapter", "verse")


def individual(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, INDIVIDUAL)


def debates(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, DEBATES)


def usfm_verses(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, verse, text. The book is the file name's part after the last dash: 58-PHM.usfm is PHM."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"([^-/.]+)\.[^./]*$", 1).alias("book"), F.col("value").alias("content"))
    return usfm.parse(files, ["book"])


def _report_files(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*REPORT.fields, T.StructField("broken", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "broken").json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Report documents, one a file, with file_ord, the file's name, by which they are ordered. Files that are no report (see
    rejected()) are left out. One read, no exchange."""
    raw = _report_files(spark, path)
    return raw.filter("broken is null").drop("broken").withColumnRenamed("file", "file_ord")


def report_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, content: report files as they are, for quality.breaches()."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", "[^/]*$", 0).alias("file"), F.col("value").alias("content"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """file, reason: the files under path that are no report: no JSON, no chapter (or 0), no list of segments."""
    raw = _report_files(spark, path)
    reason = F.when(F.col("broken").isNotNull(), "no JSON of a report").when(F.coalesce("chapter", F.lit(0)) == 0, "no chapter").when(F.col("analysis").isNull(), "no list of segments")
    return raw.select(F.regexp_extract("file", "[^/]*$", 0).alias("file"), reason.alias("reason")).filter("reason is not null")


def report_of_parts(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, category, pos, segment: the one report that sinks.ordered_text() wrote of report.document_parts(), a
    row a segment. Lines are parsed where they are read, so the report may be larger than a row or a task. A line's place
    is its number in its split and what the splits before it hold, a row a split. Lines that don't make up one document (a
    head, segments parted by commas, an end) fail the job."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    head = F.max(F.when(F.col("value").endswith('"analysis":['), F.col("value")))
    splits = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), head.alias("head"))
    all_, before = Window.partitionBy(), Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(all_).alias("total"), F.max("head").over(all_).alias("head"))
    lines = raw.join(F.broadcast(splits), ["file", "block"]).withColumn("place", F.col("before") + F.col("id") - F.col("first"))
    first, last = F.col("place") == 0, F.col("place") == F.col("total") - 1
    right = F.when(first, (F.col("value") == F.col("head")) & ~last).when(last, F.col("value") == "]}").otherwise(F.col("value").startswith(",") == (F.col("place") > 1))
    lines = lines.filter(fail_if(~F.coalesce(right, F.lit(False)), F.concat(F.lit("no line of a report at its place: "), F.left("value", F.lit(50))))).filter(~first & ~last)
    strict = {"mode": "FAILFAST"}
    told, segment = F.from_json(F.concat("head", F.lit("]}")), REPORT, strict), F.from_json(F.regexp_replace("value", "^,", ""), SEGMENT, strict)
    return lines.select(told.alias("r"), (F.col("place") - 1).cast("int").alias("pos"), segment.alias("segment")).select("r.book", "r.chapter", "r.category", "pos", "segment")


def usfm_verses_of_large_files(spark: SparkSession, path: str) -> DataFrame:
    """book, chapter, verse, text as usfm_verses() has them, of files that are too large for a task: files are split at
    chapter markers, and each chapter is parsed where it was read. A chapter marker counts wherever it stands, also inside a
    footnote. What moves is the place of each chapter; texts move only where other markers begin like a chapter's (\\cl), whose
    pieces are put together again, or where there are more than a million chapters."""
    marker = "\\c"
    raw = spark.read.option("lineSep", marker).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    at = F.struct("block", "id").alias("at")
    begins = F.col("value").rlike(f"^{JS_SPACE}+[0-9]")
    pieces = raw.select("file", at, begins.alias("begins"), F.col("value").alias("text"))
    others = pieces.filter(~F.col("begins")).select("file", "at")
    firsts = pieces.groupBy("file").agg(F.min("at").alias("at"))
    if others.join(firsts, ["file", "at"], "left_anti").head(1):
        pieces = _put_together(pieces, marker)
    chapters = pieces.filter("begins").select("file", "at", F.regexp_extract(F.left("text", F.lit(64)), f"^{JS_SPACE}+([0-9]+)", 1).cast("int").alias("chapter"), "text")
    last, n = chapters.groupBy("file", "chapter").agg(F.max("at").alias("at")), Observation()
    last = materialise(last.observe(n, F.count(F.lit(1)).alias("n")), "chapters")
    chapters = chapters.join(F.broadcast(last) if n.get["n"] <= MANY else last, ["file", "chapter", "at"], "left_semi")
    book = F.regexp_extract("file", r"([^-/.]+)\.[^./]*$", 1).alias("book")
    return usfm.parse(chapters.select(book, F.concat(F.lit(marker), "text").alias("content")), ["book"])


#: Chapters whose places a broadcast may hold.
MANY = 1_000_000


def _put_together(pieces: DataFrame, marker: str) -> DataFrame:
    """Pieces that begin no chapter follow the one before them. The window holds places, not texts."""
    order = Window.partitionBy("file").orderBy("at")
    seen = pieces.select("file", "at", F.max(F.when(F.col("begins"), F.col("at"))).over(order).alias("of"))
    joined = pieces.join(seen, ["file", "at"]).filter("of is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), marker)
    return joined.groupBy("file", F.col("of").alias("at")).agg(text.alias("text")).withColumn("begins", F.lit(True))


def unreadable_usfm(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), path, reason: the files under path that hold no verse: empty, without a chapter, or without a verse
    with text. Each file is read once and judged where it is read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    none = F.size(F.expr(usfm.verses_sql("content"))) == 0
    chapter = F.col("content").rlike(rf"\\c{JS_SPACE}+[0-9]")
    reason = F.when(F.trim("content", F.lit(PY_CHARS)) == "", "empty").when(~chapter, "no chapter").otherwise("no verse with text")
    return files.filter(none).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "path", reason.alias("reason"))
