"""The library's rules as functions of a session's SQL.

They are SQL functions, so a query that uses them is planned as if the expressions were written out: no Python runs.
`usfm_verses` reads a file's text where it stands: `select path, inline(said) from (select path, usfm_verses(content) as said
from files)` is one row a verse."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lectern import session
from lectern.functions import jsonx, usfm
from lectern.functions.text import JS_SPACE, MISSING, PY_CHARS, sql_text
from lectern.schemas import CLOSING, TURN


def _functions() -> dict[str, str]:
    """Of each function what follows its name. The argument is s."""
    closings, turns = (f"array<{kind.simpleString()}>" for kind in (CLOSING, TURN))
    hexed = f"regexp_extract(s, {sql_text(f'^{JS_SPACE}*[+-]?0[xX]([0-9a-fA-F]+)')}, 1)"
    number = f"try_cast(conv({hexed}, 16, 10) as bigint) * if(s rlike {sql_text(f'^{JS_SPACE}*-')}, -1, 1)"
    plain = f"try_cast(nullif(regexp_extract(s, {sql_text(f'^{JS_SPACE}*([+-]?[0-9]+)')}, 1), '') as bigint)"
    return {
        "js_int": f"(s string) returns bigint return coalesce(if(length({hexed}) between 1 and 15, {number}, null), {plain})",
        "py_strip": f"(s string) returns string return trim(both {sql_text(PY_CHARS)} from s)",
        "missing_to_null": f"(s string) returns string return if(s in ({', '.join(map(sql_text, MISSING))}), null, s)",
        "python_json": f"(s string) returns variant return {jsonx.parsed('s')}",
        "decoded_items": f"(s string) returns array<variant> return {jsonx.items_sql('s')}",
        "decoded_objects": f"(s string) returns array<variant> return {jsonx.objects_sql('s')}",
        "debate_closings": f"(s string) returns {closings} return {jsonx.closings_sql('s')}",
        "debate_turns": f"(s string) returns {turns} return {jsonx.turns_sql('s')}",
        "consensus": f"(s {closings}) returns int return coalesce(array_min(transform(s, x -> x.score)), 0)",
        "usfm_verses": f"(s string) returns array<struct<chapter: int, verse: int, text: string>> return {usfm.verses_sql('s')}",
        "verse_band": "(s int) returns string return if(s is null, 'none', string(greatest(1, least(10, s))))",
    }


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    session.python_json(spark)
    for name, rest in _functions().items():
        spark.sql(f"create or replace temporary function {name}{rest}")
    return list(_functions())
