"""USFM scripture text to verses, as expressions over whole files.

The rules are a viewer's, quirks included: footnotes, cross-references and glossary spans go with the words in them;
some markers go as mere prefixes, so a longer marker that starts like one leaves its other letters; a heading's text
stays with the verse before it; a chapter that comes twice is the last one alone; of a verse that comes twice in a
chapter the last non-empty text stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import JS_SPACE, sql_text

# What is deleted from the text, in this order. A span doesn't cross the end of a line.
SPANS = ("f", "x", "w")
PREFIXES = ("\\r", "\\s[0-9]", "\\p", "\\q[0-9]?", "\\b", "\\m", "\\nb")
_IN_LINE = r"[^\n\r  ]"
#: Where deleting one thing may make another out of what stands around it: a marker's beginning right before a marker.
_JOINS = r"\\[nsq]?\\"


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _without_span(text: str, marker: str) -> str:
    span = rf"\\{marker}{JS_SPACE}{_IN_LINE}+?\\{marker}\*"
    return f"if(contains({text}, {sql_text(f'\\{marker}')}), regexp_replace({text}, {sql_text(span)}, ''), {text})"


def _without_spans(text: str) -> str:
    """SQL: one kind after the other, where the text has any."""
    for marker in SPANS:
        text = _without_span(text, marker)
    return text


def _without_prefixes(text: str) -> str:
    """SQL: in one pass, unless one's deletion may make another."""
    one_by_one = text
    for prefix in PREFIXES:
        one_by_one = f"regexp_replace({one_by_one}, {sql_text(f'\\{prefix}')}, '')" if "[" in prefix else f"replace({one_by_one}, {sql_text(prefix)}, '')"
    at_once = f"regexp_replace({text}, {sql_text('|'.join(f'\\{prefix}' for prefix in PREFIXES))}, '')"
    return f"if({text} rlike {sql_text(_JOINS)}, {one_by_one}, {at_once})"


def _parts(text: str, marker: str) -> str:
    """SQL: array<struct<number, at, body>>, the text cut once before each numbered marker. What stands before the first,
    and what has a number beyond 32 bits, has none."""
    number = "regexp_extract(left(x, 24), '^[0-9]+', 0)"
    part = f"named_struct('number', if(i > 0, try_cast({number} as int), null), 'at', i, 'body', substring(x, length({number}) + 1, length(x)))"
    return f"transform(split({text}, {sql_text(rf'\\{marker}{JS_SPACE}+(?=[0-9])')}), (x, i) -> {part})"


def _lasts(parts: str) -> str:
    """SQL: of parts that share a number the last one, in order of numbers: each sorted part is met with the one behind it.
    Parts without a number are left out."""
    met = "zip_with(s, slice(s, 2, size(s)), (x, y) -> if(y is null or y.number <> x.number, x, null))"
    return f"array_compact({_bound(f'array_sort(filter({parts}, x -> x.number is not null))', 's', met)})"


def _chapters(text: str) -> str:
    """SQL: array<struct<number, at, body>> of a text without spans."""
    return _lasts(_parts(_without_prefixes(text), "c"))


def _verses(body: str) -> str:
    """SQL: array<struct<number, at, text>> of a chapter's body."""
    text = f"trim(regexp_replace(x.body, {sql_text(rf'(?:\\[a-z0-9]+|{JS_SPACE})+')}, ' '))"
    said = f"transform({_parts(body, 'v')}, x -> named_struct('number', x.number, 'at', x.at, 'text', {text}))"
    return _lasts(f"filter({said}, x -> x.text <> '')")


def verses_sql(text: str) -> str:
    """SQL: array<struct<chapter, verse, text>> of a file's text."""
    each = "transform(c_verses, v -> named_struct('chapter', c.number, 'verse', v.number, 'text', v.text))"
    chapters = f"transform({_chapters('file_text')}, c -> {_bound(_verses('c.body'), 'c_verses', each)})"
    for marker in SPANS:
        text = _bound(text, "t", _without_span("t", marker))
    return _bound(text, "file_text", f"flatten({chapters})")


def parse(files: DataFrame, by: list[str], content: str = "content") -> DataFrame:
    """by, chapter, verse, text: the verses of each file, a row of files. by names the columns to keep. Nothing is moved: a
    file's chapters and verses are found, and the last of each chosen, in the row that holds it."""
    found = files.select(*by, F.expr(_without_spans(f"`{content}`")).alias("text")).select(*by, F.expr(f"inline({_chapters('text')})"))
    said = found.select(*by, F.col("number").alias("chapter"), F.expr(f"inline({_verses('body')})"))
    return said.select(*by, "chapter", F.col("number").alias("verse"), "text")


def render(verses: DataFrame, by: list[str]) -> DataFrame:
    """by, content: one USFM text for each value of by, of verses (by, chapter, verse, text), in order. One
    exchange: a file's lines are gathered at once, and the first of each chapter carries its marker."""
    line = F.concat(F.lit("\\v "), F.col("verse").cast("string"), F.lit(" "), F.translate("text", "\\", " "), F.lit("\n"))
    said = F.when(F.col("chapter").isNotNull(), F.struct(F.col("chapter").alias("of"), "verse", line.alias("line")))
    files = verses.groupBy(*by).agg(F.array_sort(F.collect_list(said)).alias("lines"))

    def with_head(x: Column, i: Column) -> Column:
        head = F.concat(F.lit("\\c "), x["of"].cast("string"), F.lit("\n"))
        return F.concat(F.when(F.get("lines", i - 1)["of"] == x["of"], "").otherwise(head), F.coalesce(x["line"], F.lit("")))

    return files.select(*by, F.array_join(F.transform("lines", with_head), "").alias("content"))
