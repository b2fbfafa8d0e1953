"""The review loop and the debates by rounds: each round is one table of what is still open, with the messages so far in it.

A round asks for one answer a row, all rows at once, and writes what came out before the next begins: a lost executor costs
tasks of one round, and only rejected analyses go on. Where answers come from is a Source: a scorer behind an answer table
(each distinct request once, however often the run is stopped), or a table of recorded answers. The rows equal those of
the loops in operators/workflow, which run a whole loop inside one call."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import jsonx
from lectern.operators import answers, lookup, workflow
from lectern.operators.workflow import CLOSING_TASK, DEBATED, MAX_REVIEWS, MESSAGES, ROUNDS, Scorer
from lectern.sources.sinks import materialise, scratch
from lectern.streaming.reports import _Folder

#: (rows with key and request, what is asked, the round) to rows with answer.
Source = Callable[[DataFrame, str, int], DataFrame]


def answered(scorer: Scorer, request: str) -> str:
    """The scorer's answer to a request, as JSON text."""
    r = json.loads(request)
    said = lambda: [json.loads(x["content"]) for x in r["history"]]
    match r["kind"]:
        case "score":
            return scorer.score(r["agent"], r["history"][0]["content"])
        case "review":
            return scorer.review(r["agent"], r["history"], r["round"])
        case "revise":
            return scorer.revise(r["agent"], r["history"], r["reason"], r["round"])
        case "argue":
            return json.dumps(scorer.argue(r["agent"], r["score"], r["context"], said(), r["round"]), ensure_ascii=False)
        case "moderate":
            return json.dumps(scorer.moderate(r["context"], said()), ensure_ascii=False)
        case "close":
            return json.dumps(scorer.close(r["agent"], r["score"], r["context"], said()), ensure_ascii=False)
    raise ValueError(f"nothing answers {r['kind']}")


def by_scorer(scorer: Scorer, path: str, salt: str = "", in_flight: int = answers.IN_FLIGHT) -> Source:
    """Answers are kept under path, a table for each kind and round."""

    def ask(rows: DataFrame, kind: str, round_: int) -> DataFrame:
        asked = rows.withColumn("id", answers.request_id("request", salt))
        got = answers.ask(asked.select("id", "request"), f"{path}/{kind}-{round_}", lambda x: answered(scorer, x), in_flight)
        return asked.join(got, "id").drop("id")

    return ask


def by_record(record: DataFrame) -> Source:
    """Answers of an earlier run: record has key, kind, round, answer. A row without one fails the job."""

    def ask(rows: DataFrame, kind: str, round_: int) -> DataFrame:
        got = record.filter((F.col("kind") == kind) & (F.col("round") == round_)).select("key", "answer")
        return rows.join(got, "key", "left").filter(lookup.fail_if(F.col("answer").isNull(), f"no recorded answer of {kind} {round_}"))

    return ask


def _message(speaker: Column | str, content: Column | str) -> Column:
    return F.array(F.struct(F.col(speaker).alias("speaker") if isinstance(speaker, str) else speaker.alias("speaker"), F.col(content).alias("content") if isinstance(content, str) else content.alias("content")))


def _said(state: DataFrame, speaker: Column | str) -> DataFrame:
    """The answer as the last message."""
    return state.withColumn("history", F.concat("history", _message(speaker, "answer")))


def review_rounds(rows: DataFrame, source: Source) -> DataFrame:
    """key, analysis, revisions, outcome, history of rows (key, unique; agent_name; prompt): workflow.score_rows by rounds."""

    def step(state: DataFrame, kind: str, round_: int, **more: Column) -> DataFrame:
        request = jsonx.json_text(F.struct(F.lit(kind).alias("kind"), F.col("agent_name").alias("agent"), F.lit(round_).alias("round"), "history", *[c.alias(n) for n, c in more.items()]))
        return source(state.withColumn("request", request), kind, round_).drop("request")

    state = rows.select("key", "agent_name", _message(F.lit("task"), "prompt").cast(MESSAGES).alias("history"))
    open_ = materialise(_said(step(state, "score", 0), "agent_name").withColumnRenamed("answer", "analysis"), "scored")
    closed = []
    done = lambda of, revisions, outcome: of.select("key", "analysis", F.lit(revisions).alias("revisions"), outcome.alias("outcome"), "history")
    for k in range(MAX_REVIEWS):
        seen = _said(step(open_, "review", k), F.lit("critic"))
        seen = materialise(seen.withColumn("verdict", jsonx.review("answer")).drop("answer"), f"reviewed-{k}")
        accepted = F.col("verdict.accepted")
        closed.append(done(seen.filter(F.col("verdict").isNull() | accepted), k, F.when(accepted, "accepted").otherwise("unparsable")))
        rejected = seen.filter(~accepted)
        revised = step(rejected.withColumn("reason", F.col("verdict.reasoning")), "revise", k, reason=F.col("reason"))
        open_ = materialise(_said(revised.drop("analysis", "verdict", "reason"), "agent_name").withColumnRenamed("answer", "analysis"), f"revised-{k}")
    closed.append(done(open_, MAX_REVIEWS, F.lit("exhausted")))
    out = closed[0]
    for x in closed[1:]:
        out = out.unionByName(x)
    return out


TURNS = "chapter int, verse int, turn int, speaker string, content string"


def _verses(individual: DataFrame, expected: int) -> DataFrame:
    """chapter, verse, reviews, context of the verses that are debated."""
    verses = workflow.debatable_verses(individual, expected)
    blank = lambda c: F.coalesce(c, F.lit(""))
    heads = [F.concat(F.lit(h.split("{}")[0]), blank(F.col(c)), F.lit(h.split("{}")[1])) for h, c in zip(lookup.CONTEXT, ("greek_text", "translation", "face_annotation"), strict=True)]
    a, b, c, d = (*lookup.OPENING.split("{}"), "")[:4]
    lines = F.transform("reviews", lambda r: F.concat(F.lit(a), r["agent_name"], F.lit(b), r["score"].cast("string"), F.lit(c), blank(r["model_analysis"]), F.lit(d)))
    return verses.withColumn("context", F.concat_ws("\n", *heads, F.array_join(lines, "\n"), F.lit(lookup.TASK)))


def _schedule(expected: int) -> list[tuple[str, int, int]]:
    """(what is asked, the round, which review's agent speaks; -1: the moderator) of each turn."""
    turns = [(("argue", r, k) if k < expected else ("moderate", r, -1)) for r in range(ROUNDS) for k in range(expected + 1)]
    return [*turns, *(("close", 0, k) for k in range(expected))]


def debate_turns(individual: DataFrame, source: Source, path: str, expected: int = 2, upto: int | None = None) -> DataFrame:
    """TURNS of all debates, at path, one folder a turn, all of them or the first upto. Turns that are there whole are kept,
    so a run that is stopped goes on with the turn that it was writing. Closing statements see the debate but not each
    other."""
    spark = individual.sparkSession
    folder = _Folder(spark, path)
    verses = materialise(_verses(individual, expected), "verses")
    turns = _schedule(expected)[:upto]
    key = F.concat_ws(":", "chapter", "verse").alias("key")
    for k, (kind, round_, who) in enumerate(turns):
        if "_SUCCESS" in folder.names(f"turn={k}"):
            continue
        said = _log(spark, path, [t for t in range(k) if turns[t][0] != "close"])
        history = said.groupBy("chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "content"))).alias("told"))
        state = verses.join(history, ["chapter", "verse"], "left").withColumn("history", F.coalesce(F.transform("told", lambda t: F.struct(t["speaker"].alias("speaker"), t["content"].alias("content"))), F.array().cast(MESSAGES)))
        review = F.get("reviews", F.lit(who))
        speaker = F.lit("moderator") if who < 0 else review["agent_name"]
        asked = [F.lit(kind).alias("kind"), speaker.alias("agent"), *([] if who < 0 else [review["score"].alias("score")]), F.lit(round_).alias("round"), F.col("context"), F.col("history")]
        rows = state.select("chapter", "verse", key, speaker.alias("speaker"), jsonx.json_text(F.struct(*asked)).alias("request"))
        source(rows, kind, k).select("chapter", "verse", "speaker", F.col("answer").alias("content")).write.mode("overwrite").parquet(f"{path}/turn={k}")
    return _log(spark, path, list(range(len(turns))))


def _log(spark: SparkSession, path: str, turns: list[int]) -> DataFrame:
    out = spark.createDataFrame([], TURNS)
    if turns:
        columns = ", ".join(x for x in TURNS.split(", ") if not x.startswith("turn "))
        out = spark.read.schema(f"{columns}, turn int").option("basePath", path).parquet(*[f"{path}/turn={t}" for t in turns])
    return out.select(*[x.split()[0] for x in TURNS.split(", ")])


def debates(individual: DataFrame, source: Source, path: str | None = None, expected: int = 2) -> DataFrame:
    """DEBATED: workflow.debates by turns."""
    path = path or scratch(individual.sparkSession, "turns")
    n = ROUNDS * (expected + 1)
    log = debate_turns(individual, source, path, expected)
    told = lambda some: F.transform(F.filter("told", some), lambda t: t["content"])
    held = log.groupBy("chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("told"))
    closing = F.concat(F.array(F.lit(CLOSING_TASK)), told(lambda t: t["turn"] >= n))
    held = held.select("chapter", "verse", F.to_json(told(lambda t: t["turn"] < n)).alias("debate"), F.to_json(closing).alias("closing_statements"))
    out = held.join(workflow.debatable_verses(individual, expected), ["chapter", "verse"])
    return out.select(*[x.split()[0] for x in DEBATED.split(", ")])
