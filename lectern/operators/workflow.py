"""Model-call workflows: scoring with a bounded review loop, and a moderated debate for each verse.

Every row and every verse starts without memory, so tasks can be repeated and run anywhere. A Scorer answers; the
default one answers from its inputs alone. The loops here run inside one call and suit answers that cost nothing; for real
providers operators/rounds runs the same loops round by round behind a table of answers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.jsonx import FALSE, TRANSITION, TRUE
from lectern.operators.lookup import CONTEXT, OPENING, TASK
from lectern import session
from lectern.session import importable

#: Reviews after which a revision is taken as it is.
MAX_REVIEWS = 3
#: Rounds in which every linguist and the moderator speak.
ROUNDS = 2
CLOSING_TASK = f"{TRANSITION} to closing statements. Each participant gives a closing statement with the details that justify the final score."

#: What was said so far: the task first, then analyses and reviews in turn.
MESSAGES = "array<struct<speaker: string, content: string>>"
REVIEWED = f"analysis string, revisions int, outcome string, history {MESSAGES}"
DEBATED = "chapter int, verse int, face_annotation string, greek_text string, translation string, debate string, closing_statements string, row_ord long"
DEBATED_ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in DEBATED.split(", "))])


class Scorer(Protocol):
    """Answers are JSON texts: an analysis is {score, reasoning}, a review {accepted, reasoning}, a turn {agent_name,
    argument, proposed_score}, a moderation {intervene, violators, feedback}. Reviewers and revisers are given MESSAGES: the
    task with its texts (speaker task), the agent's analyses and the reviews (speaker critic) so far, the last one the
    analysis to review or the review to answer."""

    def score(self, agent: str, prompt: str) -> str: ...
    def review(self, agent: str, history: list[dict], round_: int) -> str: ...
    def revise(self, agent: str, history: list[dict], reason: str, round_: int) -> str: ...
    def argue(self, agent: str, score: int, context: str, history: list[dict], round_: int) -> dict: ...
    def moderate(self, context: str, history: list[dict]) -> dict: ...
    def close(self, agent: str, score: int, context: str, history: list[dict]) -> dict: ...


def prompt_score(prompt: str) -> int:
    """1 to 10, from the prompt's MD5."""
    return 1 + int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % 10


def prompt_score_column(prompt: Column) -> Column:
    return (F.conv(F.substring(F.md5(prompt), 1, 8), 16, 10).cast("long") % 10 + 1).cast("int")


class StubScorer:
    """Deterministic answers without any model. It accepts an analysis whose score is odd, or at the last review; a
    revision lowers the score by one. In a debate each side gives way by one a round and closes at the lower of its
    own and its peers' last scores; the moderator steps in when a round's scores add up to an odd number."""

    def score(self, agent: str, prompt: str) -> str:
        return json.dumps({"score": prompt_score(f"{agent}\n{prompt}"), "reasoning": f"{agent} weighed the wording"})

    def review(self, agent: str, history: list[dict], round_: int) -> str:
        return json.dumps({"accepted": json.loads(history[-1]["content"])["score"] % 2 == 1, "reasoning": f"review {round_ + 1}"})

    def revise(self, agent: str, history: list[dict], reason: str, round_: int) -> str:
        before = json.loads(history[-2]["content"])
        return json.dumps({"score": max(1, before["score"] - 1), "reasoning": f"{before['reasoning']}; revised after {reason}"})

    def argue(self, agent: str, score: int, context: str, history: list[dict], round_: int) -> dict:
        return {"agent_name": agent, "argument": f"{agent} holds {score} in round {round_ + 1}", "proposed_score": max(1, score - round_)}

    def moderate(self, context: str, history: list[dict]) -> dict:
        spoken = [x for x in history if "agent_name" in x][-2:]
        odd = sum(x["proposed_score"] for x in spoken) % 2 == 1
        return {"intervene": odd, "violators": [spoken[-1]["agent_name"]] if odd else [], "feedback": "Argue from the text." if odd else ""}

    def close(self, agent: str, score: int, context: str, history: list[dict]) -> dict:
        last = {x["agent_name"]: x["proposed_score"] for x in history if "agent_name" in x}
        return {"agent_name": agent, "argument": f"{agent} closes", "proposed_score": min(last.values(), default=score)}


def parsed_review(text: str) -> tuple[bool, str] | None:
    """(accepted, reasoning); None where the answer is no review."""
    try:
        got = json.loads(text.strip())
        said = str(got["accepted"]).lower()
        accepted = True if said in TRUE else False if said in FALSE else None
        if accepted is None or not isinstance(got["reasoning"], str):
            return None
        return accepted, got["reasoning"]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def reviewed_analysis(scorer: Scorer, agent: str, prompt: str) -> tuple[str, int, str, list[dict]]:
    """(analysis, revisions, outcome, messages): accepted, unparsable (the review was no review: the analysis is taken as it
    is) or exhausted (rejected each time: the last revision is taken unreviewed)."""
    analysis = scorer.score(agent, prompt)
    history = [{"speaker": "task", "content": prompt}, {"speaker": agent, "content": analysis}]
    for round_ in range(MAX_REVIEWS):
        said = scorer.review(agent, history, round_)
        history.append({"speaker": "critic", "content": said})
        verdict = parsed_review(said)
        if verdict is None:
            return analysis, round_, "unparsable", history
        if verdict[0]:
            return analysis, round_, "accepted", history
        analysis = scorer.revise(agent, history, verdict[1], round_)
        history.append({"speaker": agent, "content": analysis})
    return analysis, MAX_REVIEWS, "exhausted", history


#: Rows that a worker holds as Python objects at a time.
ROWS = 64


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, ROWS rows at a time: what a worker makes of them is not larger than they are."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def score_rows(rows: DataFrame, scorer: Scorer, agent: str = "agent_name", prompt: str = "prompt") -> DataFrame:
    """rows with REVIEWED: one review loop a row, rows of a batch one after the other."""
    importable(rows.sparkSession)
    session.small_batches(rows.sparkSession)
    history = pa.list_(pa.struct([("speaker", pa.string()), ("content", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            done = [reviewed_analysis(scorer, a, p) for a, p in zip(batch.column(agent).to_pylist(), batch.column(prompt).to_pylist(), strict=True)]
            made = [pa.array([x[k] for x in done], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string(), history))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "analysis", "revisions", "outcome", "history"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kept}, {REVIEWED}")


def debate_once(scorer: Scorer, reviews: list[dict], context: str) -> tuple[list[str], list[str]]:
    """(debate, closing statements), each a list of JSON texts; the closing ones begin with the task itself."""
    history: list[dict] = []
    for round_ in range(ROUNDS):
        for review in reviews:
            history.append(scorer.argue(review["agent_name"], int(review["score"]), context, history, round_))
        history.append(scorer.moderate(context, history))
    closing = [CLOSING_TASK]
    for review in reviews:
        closing.append(json.dumps(scorer.close(review["agent_name"], int(review["score"]), context, history), ensure_ascii=False))
    return [json.dumps(x, ensure_ascii=False) for x in history], closing


def debate_context(reviews: list[dict], first: dict | None = None) -> str:
    """lookup.debate_context() of one verse. first: what has FIRST, where the first review hasn't."""
    text, first = lambda x: "" if x is None else x, first or reviews[0]
    heads = [h.format(text(first[c])) for h, c in zip(CONTEXT, ("greek_text", "translation", "face_annotation"), strict=True)]
    return "\n".join([*heads, *(OPENING.format(r["agent_name"], r["score"], text(r["model_analysis"])) for r in reviews), TASK])


#: What of a verse's first review a debate begins with.
FIRST = ("face_annotation", "greek_text", "translation")


def debatable_verses(individual: DataFrame, expected: int = 2) -> DataFrame:
    """chapter, verse, row_ord, FIRST (of the first review), reviews (row_ord, agent_name, score, model_analysis, in row
    order): the verses with exactly the expected number of reviews. The other verses' rows are counted by a window, which
    spills, and leave before any are gathered, so a gathered row holds that many. Texts move once a verse: of reviews that
    a task has of one verse only the first one's leave it."""
    columns, keys = ["row_ord", "agent_name", "score", "model_analysis"], ["chapter", "verse"]
    known = individual.filter("chapter is not null and verse is not null")
    ready = known.select(*keys, *columns, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n")).filter(F.col("n") == expected)
    reviews = ready.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("reviews"))
    firsts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*columns, *FIRST)).alias("first")).filter(F.col("n") == expected)
    return firsts.join(reviews, keys).select(*keys, *[F.col(f"first.{c}").alias(c) for c in ("row_ord", *FIRST)], "reviews")


def debates(individual: DataFrame, scorer: Scorer, expected: int = 2) -> DataFrame:
    """DEBATED: a debate for each of debatable_verses(); without any the result is empty. One exchange by verse, then batches
    of verses, whose texts pass a worker as they are."""
    importable(individual.sparkSession)
    session.small_batches(individual.sparkSession)
    verses = debatable_verses(individual, expected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            held = [debate_once(scorer, verse["reviews"], debate_context(verse["reviews"], verse)) for verse in batch.to_pylist()]
            made = {name: pa.array([json.dumps(x[k], ensure_ascii=False) for x in held], pa.string()) for k, name in enumerate(("debate", "closing_statements"))}
            yield pa.RecordBatch.from_arrays([(made.get(f.name) if f.name in made else batch.column(f.name)).cast(f.type) for f in DEBATED_ARROW], schema=DEBATED_ARROW)

    return verses.mapInArrow(run, DEBATED)


def review_outcome(verdicts: list[Column]) -> tuple[Column, Column]:
    """(revisions, outcome) as expressions, for a reviewer whose verdict in each round is a column: true, false, or
    null for an answer that is no review."""
    revisions, outcome = F.lit(len(verdicts)), F.lit("exhausted")
    for k, verdict in reversed(list(enumerate(verdicts))):
        revisions = F.when(verdict.isNull() | verdict, F.lit(k)).otherwise(revisions)
        outcome = F.when(verdict.isNull(), "unparsable").when(verdict, "accepted").otherwise(outcome)
    return revisions, outcome
