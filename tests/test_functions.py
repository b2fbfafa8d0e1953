"""Edge cases of text, JSON and USFM rules."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import bands, jsonx, text, usfm


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("cell", "items", "objects"),
    [
        (None, 0, 0), ("{", 0, 0), ('{"a":1}', 0, 0), ("1", 0, 0), ("null", 0, 0), ('"x"', 0, 0), ("[]", 0, 0), ("[1,null,[2]]", 0, 0),
        (json.dumps(['{"a":1}', {"b": 2}, 3, None, ["x"], "{broken", "   "]), 2, 2), (json.dumps(["Now we transition to {}", {"x": "Now we transition"}]), 1, 1), (json.dumps(["5", "[1]", "null", '"s"']), 4, 0),
    ],
)
def test_decoding(spark, cell, items, objects):
    assert one(spark, cell, F.size(jsonx.decoded_items("c"))) == items
    assert one(spark, cell, F.size(jsonx.decoded_objects("c"))) == objects


def test_closings(spark):
    cell = json.dumps(["Now we transition", '{"agent_name":"A","argument":"x","proposed_score":"7"}', {"proposed_score": 7.9}, {"agent_name": None, "argument": None}])
    got = [tuple(r) for r in one(spark, cell, jsonx.closings("c"))]
    assert got == [("A", "x", 7), ("Unknown", "", 7), (None, None, None)]
    with pytest.raises(Exception, match="7.5"):
        one(spark, json.dumps([{"proposed_score": "7.5"}]), jsonx.closings("c"))


def test_turns(spark):
    cell = json.dumps([{"agent_name": None, "intervene": True}, {"intervene": False}, {"intervene": True, "violators": None, "feedback": None}, {"other": 1}, {"agent_name": "B", "argument": "y", "proposed_score": None}])
    got = [r.asDict() for r in one(spark, cell, jsonx.turns("c"))]
    assert [x["role"] for x in got] == ["linguist", "moderator", "moderator", "linguist"]
    assert got[1]["violators"] == [""] and got[1]["feedback"] == "" and got[1]["agent"] == "Moderator" and got[1]["intervened"] is False
    assert got[2]["violators"] is None and got[2]["feedback"] is None
    assert got[3]["agent"] == "B" and got[3]["proposed_score"] is None


@pytest.mark.parametrize(("said", "accepted"), [("true", True), ('"YES"', True), ("1", True), ("1.0", True), ("0", False), ('"off"', False), ('"NO"', False), ('"on"', True), ('"t"', True), ('"maybe"', None), ("null", None), ("2", None)])
def test_review(spark, said, accepted):
    got = one(spark, f' {{"accepted": {said}, "reasoning": "r"}} ', jsonx.review("c"))
    assert (got and got.accepted) == accepted
    assert one(spark, f'{{"accepted": {said}, "reasoning": 5}}', jsonx.review("c")) is None


@pytest.mark.parametrize(("value", "score", "band", "badge"), [(None, None, "none", "gray"), ("x", None, "none", "gray"), ("0", 0, "1", "red"), ("-3", -3, "1", "red"), (" 6.9 of", 6, "6", "yellow"), ("8", 8, "8", "green"), ("12", 12, "10", "green")])
def test_bands(spark, value, score, band, badge):
    assert one(spark, value, text.js_int("c")) == score
    assert one(spark, value, bands.verse_band("c")) == band
    assert one(spark, value, bands.badge_band("c")) == badge


def test_text(spark):
    assert one(spark, "  \x1f a b　\n", text.py_strip("c")) == "a b"
    assert one(spark, "n/a", text.missing_to_null("c")) is None and one(spark, "n/b", text.missing_to_null("c")) == "n/b"
    df = spark.createDataFrame([(1,), (None,)], "c int").filter(text.fail_if(F.col("c").isNull(), "no c"))
    with pytest.raises(Exception, match="no c"):
        df.select(F.lit(1)).collect()


USFM = "\\id PHM\n\\c 1\n\\s1 Heading\n\\p\n\\v 1 Paul, a \\nd Lord\\nd* man\\f + \\ft note\\f* here\n\\v 2-3 two \\w word|x\\w* end\n\\v 4 \n\\pi leak\n\\v 5 first\n\\v 5 \n\\c 2\n\\v 1 old\n\\v 2 gone\n\\c 2\n\\v 1 new\n"


def test_usfm(spark):
    got = {(r.chapter, r.verse): r.text for r in usfm.parse(spark.createDataFrame([("PHM", USFM)], "book string, content string"), ["book"]).collect()}
    assert got == {(1, 1): "Paul, a Lord * man here", (1, 2): "-3 two end", (1, 4): "i leak", (1, 5): "first", (2, 1): "new"}


def test_usfm_in_sql(spark):
    """The session's function gives what parse() gives, for null and odd texts too, and no Python runs."""
    from lectern.functions import sql

    sql.register(spark)
    texts = [USFM, None, "", "\\c 1", "no marker", "\\c 1\n\\v 99999999999 far\n\\v 3 it's \\f + a\\f* \\\\n x\n\\c 1\n\\v 2 \\\\pp last \u00a0\u2028end", "\\v 1 outside \\c 2 \\v 1 a \\v 1 b \\c 10 \\v 12 c"]
    files = spark.createDataFrame(list(enumerate(texts)), "n int, content string")
    want = usfm.parse(files, ["n"])
    got = spark.sql("select n, inline(said) from (select n, usfm_verses(content) as said from {files})", files=files)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {(r.n, r.chapter, r.verse, r.text) for r in want.collect() if r.n == 6} == {(6, 2, 1, "b"), (6, 10, 12, "c")}
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_usfm_empty_last_chapter(spark):
    got = usfm.parse(spark.createDataFrame([("A", "\\c 1\n\\v 1 x\n\\c 1\n"), ("B", None)], "book string, content string"), ["book"]).collect()
    assert got == []


def test_sql_functions(spark):
    """They give what the column functions give."""
    from lectern.functions import sql
    from lectern.functions.text import js_int, missing_to_null, py_strip

    assert {"js_int", "py_strip", "decoded_items", "debate_turns"} <= set(sql.register(spark))
    cells = [" 12px", "\u00a0-0x1F", "x", "", None, "NaN", "n/a", "\x1c it's \\ \u3000", "4294967299", "0x", "99999999999999999999"]
    rows = spark.createDataFrame([(c,) for c in cells], "s string")
    got = rows.selectExpr("js_int(s)", "py_strip(s)", "missing_to_null(s)").collect()
    assert got == rows.select(js_int("s"), py_strip("s"), missing_to_null("s")).collect()
    plan = rows.selectExpr("size(decoded_objects(s))")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_python_json(spark):
    """What Python's parser takes, decodes as it does, but NaN and Infinity are null."""
    import json

    from lectern.functions.jsonx import parsed
    from lectern.session import python_json

    python_json(spark)
    cells = ['{"a": 1, "a": 2, "b": NaN}', "[NaN, Infinity, -Infinity, -1]", '"NaN"', '{"NaN": "x \\" NaN \\\\", "k": NaN}', '{"a": "open NaN', "NaNa", "", '["' + "\\\\" * 50000 + '", NaN]', '{"a": {"x": 1, "x": [NaN]}}']
    rows = spark.createDataFrame([(c,) for c in cells], "s string").selectExpr(f"to_json({parsed('s')}) as v").collect()
    for cell, row in zip(cells, rows, strict=True):
        try:
            want = json.loads(cell, parse_constant=lambda _: None)
        except ValueError:
            want = "broken"
        assert (json.loads(row.v) if row.v is not None else "broken") == want
