"""The batch pipeline: ground truth and translation to reviews, debates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import lookup, report, rounds, workflow
from lectern.sources.sinks import materialise

AGENTS = [{"name": "LINGUIST_A", "model": "model-a"}, {"name": "LINGUIST_B", "model": "model-b"}]
#: Fields: book, chapter, verse, source text, goal, notes, translation.
PROMPT = 'Review a translation of %s %d:%d.\nSource text: "%s"\nGoal to keep: "%s"\nExpert notes: "%s"\nTranslation: "%s"\nGive a score from 1 to 10 and name the wording that earns or costs it.'


def prompt(book: str = "Philemon", template: str = PROMPT) -> Column:
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.format_string(template, F.lit(book), "chapter", "verse", blank("greek_text"), blank("face"), blank("notes"), blank("translation"))


def opening_statements(truth: DataFrame, verses: DataFrame, scorer: workflow.Scorer | None = None, agents: list[dict[str, str]] | None = None, on_missing: str = "error", book: str = "Philemon", answers: str | None = None) -> DataFrame:
    """INDIVIDUAL: a reviewed score for each annotated row and agent. An analysis that is no JSON with score and
    reasoning fails the job. answers: a folder of answers; with it the reviews go by rounds."""
    agents, scorer = agents or AGENTS, scorer or workflow.StubScorer()
    rows = lookup.fan_out(lookup.with_translation(truth, verses, on_missing), agents).withColumn("prompt", prompt(book))
    if answers:
        rows = materialise(rows.withColumn("key", F.monotonically_increasing_id()), "prompts")
        scored = rows.join(rounds.review_rounds(rows, rounds.by_scorer(scorer, f"{answers}/reviews")).select("key", "analysis"), "key")
    else:
        scored = workflow.score_rows(rows, scorer)
    got = F.expr("from_json(analysis, 'score int, reasoning string', map('mode', 'FAILFAST'))")
    got = F.struct(got["score"].alias("got_score"), got["reasoning"].alias("got_reasoning"))
    scored = scored.select("*", F.inline(F.array(got)))  # parsed once: expressions aren't moved past a generator
    scored = scored.filter(lookup.fail_if(F.col("got_score").isNull() | F.col("got_reasoning").isNull(), F.concat(F.lit("no score or reasoning in: "), F.left("analysis", F.lit(50)))))
    order = (F.col("row_ord") * len(agents) + F.col("agent_idx")).alias("row_ord")
    return scored.select("model", "agent_name", "chapter", "verse", "greek_text", "translation", F.col("face").alias("face_annotation"), "notes", F.col("got_score").alias("score"), F.col("got_reasoning").alias("model_analysis"), order)


def run(truth: DataFrame, verses: DataFrame, scorer: workflow.Scorer | None = None, book: str = "Philemon", category: str = "Pauline Epistles", on_missing: str = "error", answers: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviews, debates, reports): each written once; reports has a row, chapter and json, for each chapter. With answers, a
    folder, model calls go by rounds and turns, and what is in the folder isn't asked again."""
    scorer = scorer or workflow.StubScorer()
    individual = materialise(opening_statements(truth, verses, scorer, on_missing=on_missing, book=book, answers=answers), "individual")
    held = rounds.debates(individual, rounds.by_scorer(scorer, f"{answers}/debates"), f"{answers}/turns") if answers else workflow.debates(individual, scorer)
    debates = materialise(held, "debates")
    return individual, debates, report.documents(individual, debates, book, category)
