"""Score bands of the review views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import js_int


def verse_band(score: Column | str) -> Column:
    """'none' without a number, else the score held to 1..10: ten bands from lowest to highest."""
    s = js_int(score)
    return F.when(s.isNull(), "none").otherwise(F.greatest(F.lit(1), F.least(F.lit(10), s)).cast("string"))


def badge_band(score: Column | str) -> Column:
    s = js_int(score)
    return F.when(s.isNull(), "gray").when(s >= 8, "green").when(s >= 6, "yellow").otherwise("red")


def card_band(score: Column | str) -> Column:
    """Null where the card shows no score."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score.isNotNull(), F.when(score >= 8, "green").otherwise("yellow"))


def bar_width(score: Column | str) -> Column:
    """Per cent of the bar's full width; null without a score."""
    score = F.col(score) if isinstance(score, str) else score
    return F.when(score.isNotNull(), F.least(score * 10, F.lit(100)))


def shown(score: Column | str) -> Column:
    """The score where views show one: a score of 0 counts as none."""
    score = F.col(score) if isinstance(score, str) else score
    return F.nullif(score, F.lit(0))
