import json
import urllib.error

import pytest

from lectern.operators import workflow
from lectern.operators.providers import ChatScorer, from_settings, response_format, settings


class Service:
    def __init__(self, fail=0, accepts=True):
        self.bodies, self.fail, self.accepts = [], fail, accepts

    def __call__(self, url, body, key, timeout):
        assert url == "http://model/v1/chat/completions" and key == "secret"
        if self.fail:
            self.fail -= 1
            raise urllib.error.URLError("busy")
        self.bodies.append(body)
        kind = body["response_format"]["json_schema"]["name"]
        value = {"integer": 4, "string": "s", "boolean": kind == "critic_review" and self.accepts, "array": []}
        fields = body["response_format"]["json_schema"]["schema"]["properties"]
        return {"choices": [{"message": {"content": json.dumps({n: value[t["type"]] for n, t in fields.items()})}}]}


def scorer(monkeypatch, service):
    monkeypatch.setenv("KEY", "secret")
    monkeypatch.setattr("time.sleep", lambda s: None)
    return ChatScorer({"A": "m-a", "B": "m-b"}, "m-r", "m-m", base_url="http://model/v1", key_variable="KEY", send=service)


def test_review_loop_and_debate(monkeypatch):
    service = Service()
    s = scorer(monkeypatch, service)
    analysis, revisions, outcome, _ = workflow.reviewed_analysis(s, "A", "prompt")
    assert (json.loads(analysis)["score"], revisions, outcome) == (4, 0, "accepted")
    assert [b["model"] for b in service.bodies] == ["m-a", "m-r"]
    workflow.reviewed_analysis(s, "A", "prompt")
    assert len(service.bodies) == 2  # kept by what was sent
    debate, closing = workflow.debate_once(s, [{"agent_name": "A", "score": 3}, {"agent_name": "B", "score": 5}], "context")
    assert len(debate) == 6 and len(closing) == 3 and json.loads(closing[1])["proposed_score"] == 4


def test_retries(monkeypatch):
    assert json.loads(scorer(monkeypatch, Service(fail=2)).score("A", "p"))["score"] == 4
    with pytest.raises(urllib.error.URLError):
        scorer(monkeypatch, Service(fail=3)).score("A", "p")


def test_reviewer_and_reviser_see_the_texts(monkeypatch):
    """All that was said so far, in order, their own words as their own."""
    service = Service(accepts=False)
    *_, outcome, history = workflow.reviewed_analysis(scorer(monkeypatch, service), "A", "prompt with texts")
    assert outcome == "exhausted" and [m["speaker"] for m in history] == ["task", "A", *["critic", "A"] * 3]
    analysis, review = (json.dumps(x) for x in ({"score": 4, "reasoning": "s"}, {"accepted": False, "reasoning": "s"}))
    bodies = [b["messages"][1:] for b in service.bodies]
    assert [m["content"] for m in bodies[1]] == ["prompt with texts", f"Analysis by A:\n{analysis}", "Give your review 1 of the last analysis."]
    assert [(m["role"], m["content"]) for m in bodies[2][:2]] == [("user", "prompt with texts"), ("assistant", analysis)] and "s" in bodies[2][2]["content"]
    assert [m["role"] for m in bodies[5]] == ["user", "user", "assistant", "user", "assistant", "user", "user"] and bodies[5][2]["content"] == review


def test_response_format():
    """From the answers' Spark types."""
    got = response_format("moderator_turn")["json_schema"]["schema"]
    assert got == {"type": "object", "properties": {"intervene": {"type": "boolean"}, "violators": {"type": "array", "items": {"type": "string"}}, "feedback": {"type": "string"}}, "required": ["intervene", "violators", "feedback"], "additionalProperties": False}


def test_refusals_are_not_repeated(monkeypatch):
    calls = []

    def refuse(*_):
        calls.append(1)
        raise urllib.error.HTTPError("u", 401, "no", {}, None)

    s = scorer(monkeypatch, refuse)
    with pytest.raises(urllib.error.HTTPError):
        s.score("A", "p")
    assert len(calls) == 1


def test_settings(tmp_path, monkeypatch):
    """A settings file, the environment before it, and a model of another service with its own key."""
    (tmp_path / "s").write_text("# agents\nexport LECTERN_AGENTS=A=m-a,B=m-b\nLECTERN_REVIEWER = 'm-r'\nLECTERN_MODERATOR=m-m\nLECTERN_BASE_URL=http://one/v1\nLECTERN_SERVICES=m-b=http://two/v1=OTHER\nnot a setting\n")
    monkeypatch.setenv("LECTERN_MODERATOR", "m-x")
    monkeypatch.setenv("OTHER", "two's key")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    s, sent = from_settings(settings(str(tmp_path / "s"))), []
    s.send = lambda url, body, key, timeout: sent.append((url, body["model"], key)) or {"choices": [{"message": {"content": "{}"}}]}
    s.score("A", "p")
    s.score("B", "p")
    s.moderate("c", [])
    assert sent == [("http://one/v1/chat/completions", "m-a", None), ("http://two/v1/chat/completions", "m-b", "two's key"), ("http://one/v1/chat/completions", "m-x", None)]
