"""Answer tables, review rounds and debate logs: what is asked, how often, and what a stopped run goes on with."""

import json
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lectern.operators import answers, report, rounds, workflow
from lectern.plans import adapters


class Counting(workflow.StubScorer):
    """Notes each call in a folder that all workers share; fails on the calls that are told to."""

    def __init__(self, folder, fails=()):
        self.folder, self.fails = str(folder), fails

    def note(self, *what):
        with open(f"{self.folder}/calls", "a") as f:
            f.write(json.dumps(what) + "\n")
        if any(str(x) in json.dumps(what) for x in self.fails):
            raise ConnectionError("gone")

    def score(self, agent, prompt):
        self.note("score", agent, prompt)
        return super().score(agent, prompt)

    def review(self, agent, history, round_):
        self.note("review", agent, history)
        if "odd" in history[0]["content"] and round_ == 1:
            return "no review"
        return super().review(agent, history, round_) if "never" not in history[0]["content"] else json.dumps({"accepted": "no", "reasoning": f"r{round_}"})

    def revise(self, agent, history, reason, round_):
        self.note("revise", agent, history, reason)
        return super().revise(agent, history, reason, round_)

    def argue(self, agent, score, context, history, round_):
        self.note("argue", agent, context, len(history), round_)
        return super().argue(agent, score, context, history, round_)


def calls(folder):
    path = Path(folder, "calls")
    return Counter(path.read_text().splitlines()) if path.exists() else Counter()


def prompts(spark, n=30):
    rows = [(f"k{i}", "AB"[i % 2], f"{('plain', 'odd', 'never')[i % 3]} prompt {i // 4}") for i in range(n)]
    return spark.createDataFrame([*rows, ("again", *rows[0][1:])], "key string, agent_name string, prompt string")


def test_answers_are_asked_once(spark, tmp_path):
    """Repeated requests, a run whose calls fail in part, and the run after it."""
    path, notes = str(tmp_path / "answers"), tmp_path / "n"
    notes.mkdir()
    texts = [f"ask {i % 40}" for i in range(100)]
    requests = spark.createDataFrame([(x,) for x in texts], "request string").withColumn("id", answers.request_id("request")).repartition(5)

    def reply(fails):
        def f(request):
            with open(notes / "calls", "a") as out:
                out.write(request + "\n")
            if request in fails:
                raise OSError("busy")
            return request.upper()

        return f

    with pytest.raises(RuntimeError, match="2 of 40 requests failed, one with OSError: busy"):
        answers.ask(requests, path, reply({"ask 3", "ask 5"}), wave=15)
    assert answers.known(spark, path).count() == 38 and calls(notes) == Counter(f"ask {i}" for i in range(40))
    got = answers.ask(requests, path, reply(()), in_flight=2)
    assert {r.answer for r in got.collect()} == {f"ASK {i}" for i in range(40)}
    assert calls(notes) == Counter([*(f"ask {i}" for i in range(40)), "ask 3", "ask 5"])
    answers.ask(requests, path, reply(()))
    assert sum(calls(notes).values()) == 42


def test_review_rounds(spark, tmp_path):
    """Rows, messages included, equal those of the loop; each distinct request is asked once, by a run that fails and by the
    one that follows it."""
    rows = prompts(spark)
    plain = workflow.score_rows(rows, Counting(tmp_path)).select("key", "analysis", "revisions", "outcome", "history")
    want = sorted(map(str, plain.collect()))
    assert {r.outcome for r in plain.collect()} == {"accepted", "unparsable", "exhausted"}
    distinct = set(calls(tmp_path))
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    with pytest.raises(RuntimeError, match="ConnectionError"):
        rounds.review_rounds(rows, rounds.by_scorer(Counting(tmp_path / "a", fails=["never prompt 2"]), str(tmp_path / "answers")))
    got = rounds.review_rounds(rows, rounds.by_scorer(Counting(tmp_path / "a"), str(tmp_path / "answers")))
    assert sorted(map(str, got.collect())) == want
    seen = calls(tmp_path / "a")
    assert set(seen) == distinct and all(n == 1 or "never prompt 2" in x for x, n in seen.items())
    assert sorted(map(str, rounds.review_rounds(rows, rounds.by_scorer(Counting(tmp_path / "b"), str(tmp_path / "answers"))).collect())) == want
    assert not calls(tmp_path / "b")
    assert rounds.review_rounds(rows.limit(0), rounds.by_scorer(Counting(tmp_path), str(tmp_path / "none"))).count() == 0


def decoded(held):
    return sorted(map(str, report.decoded_debates(held).select("chapter", "verse", "face_annotation", "greek_text", "translation", "row_ord", "turns", "closings", "consensus").collect()))


def test_debate_goes_on_where_it_stopped(spark, sf, tmp_path):
    rows = adapters.individual(spark, sf, multi=True).filter("chapter = 1")
    log = str(tmp_path / "log")
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
    rounds.debate_turns(rows, rounds.by_scorer(Counting(tmp_path / "a"), str(tmp_path / "answers")), log, upto=3)
    assert sorted(x.name for x in Path(log).iterdir()) == ["turn=0", "turn=1", "turn=2"]
    written = {str(x): x.stat().st_mtime_ns for x in Path(log).rglob("*.parquet")}
    got = rounds.debates(rows, rounds.by_scorer(Counting(tmp_path / "b"), str(tmp_path / "other")), log)
    assert decoded(got) == decoded(workflow.debates(rows, workflow.StubScorer())) and len(decoded(got)) > 20
    assert all(Path(x).stat().st_mtime_ns == at for x, at in written.items())
    assert {json.loads(x)[4] for x in calls(tmp_path / "a")} == {0} and {json.loads(x)[4] for x in calls(tmp_path / "b")} == {1}


def test_record_must_be_whole(spark):
    rows = prompts(spark, 3)
    record = spark.createDataFrame([("k0", "score", 0, "{}")], "key string, kind string, round int, answer string")
    with pytest.raises(Exception, match="no recorded answer of score 0"):
        rounds.review_rounds(rows, rounds.by_record(record))


def test_batch_by_rounds(spark, sf, tmp_path):
    """The whole run behind a folder of answers equals the run of loops; run again, it asks nothing."""
    from lectern.plans import batch

    truth = adapters.truth(spark, sf).drop("n_chars").filter("row_ord < 40")
    verses = truth.select(F.lit("PHM").alias("book"), "chapter", "verse", F.col("greek_text").alias("text")).filter("text is not null")
    made = lambda **more: batch.run(truth, verses, Counting(tmp_path), on_missing="skip", **more)
    plain, held = made(), made(answers=str(tmp_path / "answers"))
    assert sorted(map(str, plain[0].collect())) == sorted(map(str, held[0].collect()))
    assert decoded(plain[1]) == decoded(held[1]) and sorted(map(str, plain[2].collect())) == sorted(map(str, held[2].collect()))
    before = calls(tmp_path)
    assert sorted(map(str, made(answers=str(tmp_path / "answers"))[2].collect())) == sorted(map(str, plain[2].collect())) and calls(tmp_path) == before
