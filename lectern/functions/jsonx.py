"""Lenient JSON: lists whose items may be JSON inside strings, and model answers with loose types.

Values stay VARIANT until a field is asked for, so an item's type decides what becomes of it and a missing key differs
from an explicit null. Unlike a Python parser, Spark's takes neither NaN nor a repeated key: such a text is invalid
here. An outer value that is no list has no items, whatever it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import PY_CHARS, PY_SPACE

# Fixed value: what marks an item as an instruction to the speakers rather than a statement.
TRANSITION = "Now we transition"
_BLANK = f"^{PY_SPACE}*$".replace("\\", "\\\\")
_OBJECT = "startswith(schema_of_variant(x), 'OBJECT')"


# A JSON string, or what stands between strings; possessive, so that long strings need no stack.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]+|"'.replace("\\", "\\\\")


def parsed(text: str) -> str:
    """SQL: a JSON text as a VARIANT, null where it is none."""
    plain = f"array_join(transform(regexp_extract_all({text}, '(?s){_TOKEN}', 0), t -> if(startswith(t, '\"'), t, regexp_replace(t, '-?\\\\bInfinity\\\\b|\\\\bNaN\\\\b', 'null'))), '')"
    return f"coalesce(try_parse_json({text}), if({text} rlike 'NaN|Infinity', try_parse_json({plain}), null))"


def items_sql(column: str) -> str:
    said = "variant_get(x, '$', 'string')"
    inner = f"case when contains({said}, '{TRANSITION}') or {said} rlike '{_BLANK}' then null else {parsed(said)} end"
    each = f"case when schema_of_variant(x) = 'STRING' then {inner} when {_OBJECT} then x end"
    items = f"coalesce(try_variant_get({parsed(column)}, '$', 'array<variant>'), array())"
    return f"filter(transform({items}, x -> {each}), x -> x is not null)"


def objects_sql(column: str) -> str:
    return f"filter({items_sql(column)}, x -> {_OBJECT})"


def decoded_items(column: str) -> Column:
    """array<variant>: the items of a JSON list. String items are parsed (blank ones, instructions and broken JSON are
    dropped), objects kept, others dropped. Never null."""
    return F.expr(items_sql(column))


def decoded_objects(column: str) -> Column:
    """The decoded items that are objects."""
    return F.expr(objects_sql(column))


def has_key(x: str, key: str) -> str:
    """SQL: the object x has the key, if only with null."""
    return f"variant_get({x}, '$.{key}', 'variant') is not null"


def text_at(x: str, key: str, absent: str) -> str:
    """SQL: the key's value as a string; absent only where there is no such key."""
    return f"case when {has_key(x, key)} then variant_get({x}, '$.{key}', 'string') else {absent} end"


def closings(column: str) -> Column:
    """array<struct<agent, statement, score>>: closing statements; score is an integer, null where none was given. A
    score that is no integer in a string fails, as it would anywhere else."""
    return F.expr(closings_sql(column))


def closings_sql(column: str) -> str:
    fields = f"named_struct('agent', {text_at('x', 'agent_name', repr('Unknown'))}, 'statement', {text_at('x', 'argument', repr(''))}, 'score', variant_get(x, '$.proposed_score', 'int'))"
    return f"transform({objects_sql(column)}, x -> {fields})"


def turns(column: str) -> Column:
    """array<struct>: the transcript. Items with agent_name are a linguist's turns, others with intervene the
    moderator's, and the rest is dropped. Fields of the other role are null."""
    return F.expr(turns_sql(column))


def turns_sql(column: str) -> str:
    linguist = has_key("x", "agent_name")
    none = "cast(null as {})".format
    fields = ", ".join(
        f"'{name}', case when {linguist} then {own} else {other} end"
        for name, own, other in (
            ("role", "'linguist'", "'moderator'"),
            ("agent", "variant_get(x, '$.agent_name', 'string')", "'Moderator'"),
            ("argument", "variant_get(x, '$.argument', 'string')", none("string")),
            ("proposed_score", "variant_get(x, '$.proposed_score', 'int')", none("int")),
            ("violators", none("array<string>"), f"case when {has_key('x', 'violators')} then variant_get(x, '$.violators', 'array<string>') else array('') end"),
            ("intervened", none("boolean"), "variant_get(x, '$.intervene', 'boolean')"),
            ("feedback", none("string"), text_at("x", "feedback", "''")),
        )
    )
    return f"transform(filter({objects_sql(column)}, x -> {linguist} or {has_key('x', 'intervene')}), x -> named_struct({fields}))"


# What the lax boolean of a validated model answer takes as true and as false.
TRUE = ("true", "t", "yes", "y", "on", "1", "1.0")
FALSE = ("false", "f", "no", "n", "off", "0", "0.0")


def lax_bool(c: Column) -> Column:
    """Null where the text is neither."""
    c = F.lower(c)
    return F.when(c.isin(*TRUE), True).when(c.isin(*FALSE), False)


def review(column: str) -> Column:
    """struct<accepted, reasoning>: a reviewer's JSON answer; null where it isn't one (accepted loosely a boolean,
    reasoning a string)."""
    listed = "".join(f"\\u{ord(c):04x}" for c in PY_CHARS)
    stripped = f"try_parse_json(trim(BOTH '{listed}' FROM {column}))"
    accepted = lax_bool(F.expr(f"try_variant_get({stripped}, '$.accepted', 'string')"))
    good = F.expr(f"schema_of_variant(try_variant_get({stripped}, '$.reasoning', 'variant')) = 'STRING'") & accepted.isNotNull()
    return F.when(good, F.struct(accepted.alias("accepted"), F.expr(f"try_variant_get({stripped}, '$.reasoning', 'string')").alias("reasoning")))


def json_text(c: Column) -> Column:
    """JSON with explicit nulls."""
    return F.to_json(c, {"ignoreNullFields": "false"})
