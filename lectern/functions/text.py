"""Text rules of other languages, as Spark expressions.

Spark trims only the space character and Java's \\s is ASCII; the functions here name their white space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of JavaScript's \s and trim(), and of Python's str.strip().
JS_SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
PY_SPACE = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The characters of PY_SPACE, for trim().
PY_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# The cells that the usual data-frame CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def sql_text(x: str) -> str:
    """x as a literal of SQL."""
    return "'" + "".join(c if " " <= c <= "~" and c not in "'\\" else f"\\u{ord(c):04x}" for c in x) + "'"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    return F.trim(_column(c), F.lit(PY_CHARS))


def js_squeeze(c: Column | str) -> Column:
    """Runs of white space to one space, none at either end."""
    return F.trim(F.regexp_replace(_column(c), f"{JS_SPACE}+", " "))


def js_int(c: Column | str) -> Column:
    """The leading integer of a string after white space, decimal or hexadecimal (0x1F), as a double would hold it: null
    where JavaScript's parseInt gives NaN. Beyond 64 bits it is null as well."""
    said = _column(c).cast("string")
    hex_ = F.regexp_extract(said, rf"^{JS_SPACE}*[+-]?0[xX]([0-9a-fA-F]+)", 1)
    minus = F.when(said.rlike(rf"^{JS_SPACE}*-"), -1).otherwise(1)
    number = F.when(F.length(hex_).between(1, 15), F.conv(hex_, 16, 10).try_cast("long") * minus)
    return F.coalesce(number, F.regexp_extract(said, rf"^{JS_SPACE}*([+-]?[0-9]+)", 1).try_cast("long"))


def missing_to_null(c: Column | str) -> Column:
    c = _column(c)
    return F.when(~c.isin(*MISSING), c)


def reference_key(book: Column | str, chapter: Column | str, verse: Column | str) -> Column:
    book = F.lit(book) if isinstance(book, str) else book
    return F.format_string("%s %d:%d", book, _column(chapter), _column(verse))


def strict_keys(rows: DataFrame, *columns: str) -> DataFrame:
    """Columns cast to int; a null or no integer fails the job."""
    out = rows
    for c in columns:
        out = out.filter(fail_if(F.col(c).try_cast("int").isNull(), f"{c} is no integer")).withColumn(c, F.col(c).cast("int"))
    return out


def fail_if(bad: Column, message: Column | str) -> Column:
    """A filter that keeps every row and fails the job on a bad one. As a filter it can't be pruned away, as a checked
    column could."""
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(bad, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
