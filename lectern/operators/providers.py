"""A scorer that asks an OpenAI-compatible chat service.

Nothing here runs unless it is asked for. The key is read from the environment of the executor that calls, never from
a DataFrame. operators/answers keeps answers in a table that all tasks and later runs share, and bounds the calls in
flight; the cache here is one scorer's own, which a task unpickles empty."""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, field

from lectern.functions import jsonschema
from lectern.schemas import ANSWERS


def response_format(kind: str) -> dict:
    """The JSON Schema that the service must answer with: that of the answer's Spark type."""
    return {"type": "json_schema", "json_schema": {"name": kind, "strict": True, "schema": jsonschema.of_type(ANSWERS[kind])}}


def post(url: str, body: dict, key: str | None, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


#: Texts of the requests. {agent}, {task}, {analysis}, {reason} and {round} are filled in.
TEXTS = {
    "linguist": "You are {agent}, a linguist who compares how languages express politeness and intent. {task}",
    "reviewer": "You review analyses of translations. Accept one only if it argues from language alone and quotes words that are in the texts; otherwise say what to revise.",
    "analysis": "Analysis by {agent}:\n{analysis}",
    "review": "Give your review {round} of the last analysis.",
    "revise": "It was rejected: {reason}\nRevise it on linguistic grounds that can be checked.",
    "debater": "You debate the score with others; aim at a consensus and prefer the lower score.",
    "argue": "Round {round}: give your argument.",
    "moderator": "You moderate a debate between linguists. Step in only where one argues from anything but language, or about words that are not in the texts.",
}


@dataclass
class ChatScorer:
    """models: the model of each agent; reviewer and moderator have their own. texts replaces some of TEXTS. services: of
    models that another service than base_url has, its address and the variable with its key."""

    models: dict[str, str]
    reviewer: str
    moderator: str
    base_url: str = "https://api.openai.com/v1"
    key_variable: str = "OPENAI_API_KEY"
    task: str = "Score translations from 1 to 10 by how well they keep the stated goal of the source text. Judge wording, grammar and rhetoric only, be critical, and write in English."
    timeout: float = 120.0
    tries: int = 3
    texts: dict[str, str] = field(default_factory=dict)
    services: dict[str, tuple[str, str]] = field(default_factory=dict)
    send: Callable[[str, dict, str | None, float], dict] = post
    cache: MutableMapping[str, str] = field(default_factory=dict)

    def _ask(self, model: str, kind: str, system: str, *messages: str | dict) -> str:
        said = [m if isinstance(m, dict) else {"role": "user", "content": m} for m in messages]
        body = {"model": model, "messages": [{"role": "system", "content": system}, *said], "response_format": response_format(kind)}
        url, variable = self.services.get(model, (self.base_url, self.key_variable))
        name = hashlib.sha256(json.dumps([url, body], sort_keys=True).encode()).hexdigest()
        if name not in self.cache:
            for k in range(self.tries):
                try:
                    got = self.send(f"{url}/chat/completions", body, os.environ.get(variable), self.timeout)
                    self.cache[name] = got["choices"][0]["message"]["content"]
                    break
                except (urllib.error.URLError, TimeoutError) as e:
                    refused = isinstance(e, urllib.error.HTTPError) and 400 <= e.code < 500 and e.code not in (408, 429)
                    if refused or k == self.tries - 1:
                        raise
                    time.sleep(2**k)
        return self.cache[name]

    def _text(self, name: str, **values: object) -> str:
        return (TEXTS | self.texts)[name].format(task=self.task, **values)

    def score(self, agent: str, prompt: str) -> str:
        return self._ask(self.models[agent], "linguist_review", self._text("linguist", agent=agent), prompt)

    def review(self, agent: str, history: list[dict], round_: int) -> str:
        """The reviewer sees the task with its texts, and all analyses and reviews so far."""
        told = [{"role": "assistant", "content": m["content"]} if m["speaker"] == "critic" else m["content"] if m["speaker"] == "task" else self._text("analysis", agent=agent, analysis=m["content"]) for m in history]
        return self._ask(self.reviewer, "critic_review", self._text("reviewer"), *told, self._text("review", round=round_ + 1))

    def revise(self, agent: str, history: list[dict], reason: str, round_: int) -> str:
        told = [{"role": "assistant", "content": m["content"]} if m["speaker"] == agent else m["content"] for m in history if m["speaker"] != "critic" or m is not history[-1]]
        return self._ask(self.models[agent], "linguist_review", self._text("linguist", agent=agent), *told, self._text("revise", reason=reason))

    def argue(self, agent: str, score: int, context: str, history: list[dict], round_: int) -> dict:
        system = f"{self._text('linguist', agent=agent)} {self._text('debater')}"
        return json.loads(self._ask(self.models[agent], "linguist_turn", system, context, _told(history), self._text("argue", round=round_ + 1)))

    def moderate(self, context: str, history: list[dict]) -> dict:
        return json.loads(self._ask(self.moderator, "moderator_turn", self._text("moderator"), context, _told(history)))

    def close(self, agent: str, score: int, context: str, history: list[dict]) -> dict:
        from lectern.operators.workflow import CLOSING_TASK

        return json.loads(self._ask(self.models[agent], "linguist_turn", self._text("linguist", agent=agent), context, _told(history), CLOSING_TASK))


def _told(history: list[dict]) -> str:
    return "\n".join(json.dumps(x, ensure_ascii=False) for x in history) or "(nobody has spoken)"


def settings(path: str) -> dict[str, str]:
    """NAME=value lines of a settings file; # begins a comment line, quotes around a value go. The environment comes first."""
    out = {}
    with open(path, encoding="utf-8") as lines:
        for line in lines:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out | {k: os.environ[k] for k in out if k in os.environ}


def from_settings(said: dict[str, str]) -> ChatScorer:
    """A scorer from LECTERN_AGENTS (name=model, comma-separated), LECTERN_REVIEWER, LECTERN_MODERATOR and, where they are
    there, LECTERN_BASE_URL, LECTERN_KEY_VARIABLE and LECTERN_SERVICES (model=address=variable with the key,
    comma-separated). Keys themselves stay in the environment of those who call."""
    models = dict(x.split("=", 1) for x in said["LECTERN_AGENTS"].split(","))
    services = {m: (url, variable) for m, url, variable in (x.split("=", 2) for x in said.get("LECTERN_SERVICES", "").split(",") if x)}
    more = {k: said[v] for k, v in (("base_url", "LECTERN_BASE_URL"), ("key_variable", "LECTERN_KEY_VARIABLE")) if v in said}
    return ChatScorer(models, said["LECTERN_REVIEWER"], said["LECTERN_MODERATOR"], services=services, **more)
