"""Generation and forecasts with a language model that the caller hands in; this package has no client of its own."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame

from lectern.operators import search, topics

# Marks of errors that pass, tries per model.
PASSING = ("429", "500", "502", "503", "504")
ATTEMPTS = 3


class Generator(Protocol):
    def __call__(self, model: str, prompt: str) -> str: ...


def call(generator: Generator | None, models: Sequence[str], prompt: str, sleep: Callable[[float], None] = time.sleep) -> str:
    """The first answer of the models in turn. Errors that pass are tried again after 1 and 2 seconds; others are raised at once."""
    if generator is None:
        raise RuntimeError("no generator was given")
    last: Exception | None = None
    for model in models:
        for attempt in range(ATTEMPTS):
            try:
                return generator(model, prompt)
            except Exception as error:
                if not any(code in str(error) for code in PASSING):
                    raise
                last = error
                if attempt < ATTEMPTS - 1:
                    sleep(2**attempt)
    raise RuntimeError("all models failed") from last


def rescue(text: str):
    """JSON of an answer that may have other text around it."""
    tries = [text]
    for a, b in ("{}", "[]"):
        lo, hi = text.find(a), text.rfind(b)
        if 0 <= lo < hi:
            tries.append(text[lo : hi + 1])
    for t in tries:
        try:
            return json.loads(t)
        except ValueError:
            continue
    raise ValueError("the answer has no JSON")


def questions_of(payload) -> list:
    """The questions of an envelope or of a bare list."""
    if isinstance(payload, dict):
        result = payload.get("result", payload)
        return list(result.get("questions", [])) if isinstance(result, dict) else []
    return payload if isinstance(payload, list) else []


def question_type(name: str | None) -> str | None:
    """Spelling of the corpus for a type as a user gives it."""
    return {"problem_of_the_day": "problem_of_day"}.get(name or "", name)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def prompt_of(task: str, rules: Sequence[str], facts: dict, profile: list[dict], examples: list[dict], answer: dict) -> str:
    """The text for a model: the task, rules, what is asked for, patterns of past papers, examples with their sources, and the form of the answer."""
    show = lambda x: json.dumps(x, ensure_ascii=False, default=str)
    lines = [task, "", "Rules:", *(f"- {r}" for r in rules), "", *(f"{k}: {v}" for k, v in facts.items()), "", "Patterns of past papers, the strongest first:"]
    lines += [f"{k}. {p['topic']}: asked {p['frequency']} times, in the years {', '.join(map(str, p['years_seen'])) or 'unknown'}, score {p['forecast_score']}" for k, p in enumerate(profile, 1)] or ["none"]
    lines += ["", "Examples from past papers:", *(show(e) for e in examples), "", "Answer with JSON alone, in this form:", show(answer)]
    return "\n".join(lines)


GENERATE_RULES = (
    "Write new questions; do not repeat or reword an example.", "Keep the level, length and manner of the examples.", "Each answer must be correct and complete, and each solution must show the steps.",
    "Spread the questions over the patterns, if no topic is given.",
)
FORECAST_RULES = ("Base each forecast on the patterns and examples, and say how.", "A likelihood is a number from 0 to 1.", "Do not claim to know a paper that is to come.")


def generate(records: DataFrame, text: Column, generator: Generator | None, models: Sequence[str], subject: str, kind: str, topic: str = "", count: int = 5, k: int = 10) -> dict:
    """records(ord, subject, topic, question_type, answer, year, ...): the best examples and the profile go into a prompt; the answer into an envelope."""
    kind = question_type(kind)
    mine = (records["subject"] == subject) & (records["question_type"] == kind)
    best = search.search(records, "ord", text, f"{subject} {kind} {topic}", k, mine)
    source = [c for c in ("sources", "source") if c in records.columns][:1]
    examples = _rows(records.join(best, "ord").orderBy(best["score"].desc(), "ord").select(text.alias("question"), "answer", "topic", *source))
    profile = _rows(topics.top_profile(topics.pattern_profile(records.where(mine))))
    facts = {"Subject": subject, "Type": kind, "Topic": topic or "the strongest patterns", "Number of questions": count}
    form = {"questions": [{"question": "", "answer": "", "solution": "", "topic": "", "difficulty": 3, "style_notes": ""}]}
    prompt = prompt_of("Write original quiz questions in the style of the examples.", GENERATE_RULES, facts, profile, examples, form)
    return {"mode": "generate", "subject": subject, "question_type": kind, "topic": topic, "historical_examples": examples, "result": rescue(call(generator, models, prompt))}


def forecast(records: DataFrame, text: Column, generator: Generator | None, models: Sequence[str], subject: str, kind: str) -> dict:
    kind = question_type(kind)
    of_subject = records.where(records["subject"] == subject)
    profile = topics.pattern_profile(of_subject.where(of_subject["question_type"] == kind))
    examples = _rows(topics.forecast_examples(of_subject.withColumn("text", text), profile).select("topic", "text", "year"))
    top = _rows(topics.top_profile(profile))
    form = {"forecast": [{"topic": "", "concept": "", "likelihood": 0.5, "reason": "", "possible_question_direction": ""}]}
    prompt = prompt_of("Forecast which topics the next paper asks for.", FORECAST_RULES, {"Subject": subject, "Type": kind}, top, examples, form)
    return {"mode": "forecast", "subject": subject, "question_type": kind, "pattern_profile": top, "result": rescue(call(generator, models, prompt))}


def write_latest(spark, envelope: dict, folder: str) -> None:
    spark.createDataFrame([(json.dumps(envelope, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest_{envelope['mode']}")
