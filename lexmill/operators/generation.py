"""Prompts, deterministic stand-in answers, and reading of model output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ledger import Ledger

LANGUAGE = {"en": "Write in English.", "vi": "Viết bằng tiếng Việt."}
HINTS = ["Ask about a key fact.", "Ask about a cause.", "Ask about a comparison.", "Ask about an application.", "Ask about a definition.", "Ask about an exception.", "Ask about a consequence."]
ANSWER_LETTERS = "ABCD"


def mark(text: Column) -> Column:
    """First eight hexadecimal digits of the text's md5."""
    return F.substring(F.md5(text), 1, 8)


# The sentences of stand-in questions below, which output has to equal.
def stand_in_question(passage: Column) -> Column:
    return F.concat(F.lit("What is the main concept in this passage? (mock-"), mark(passage), F.lit(")"))


def stand_in_batch(rows: DataFrame, key: str, passage: str, n: int) -> DataFrame:
    """(key, i, question, answers, difficulty): n questions a passage; every second one has two answers."""
    out = rows.select(key, passage, F.posexplode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i", "j"))
    text = F.concat(F.lit("Question "), (F.col("i") + 1).cast("string"), F.lit(": What concept is discussed? (mock-"), mark(F.concat_ws("_", passage, F.col("i").cast("string"))), F.lit(")"))
    answers = F.when(F.col("i") % 2 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))
    return out.select(key, F.col("i").cast("long").alias("i"), text.alias("question"), F.array_join(answers, ",").alias("answers"), F.lit("medium").alias("difficulty"))


def stand_in_short(passage: Column) -> Column:
    return F.concat(F.lit("Explain the main concept discussed in the passage. (mock-"), mark(passage), F.lit(")"))


def stand_in_statement(passage: Column) -> Column:
    return F.concat(F.lit("The passage discusses a specific concept. (mock-"), mark(passage), F.lit(")"))


def three_distractors(candidates: Column) -> Column:
    return F.slice(F.concat(candidates, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.concat(F.lit("Mock distractor "), i.cast("string")))), 1, 3)


def _language(code: Column) -> Column:
    out = F.lit(LANGUAGE["en"])
    for name, text in LANGUAGE.items():
        out = F.when(code == name, text).otherwise(out)
    return out


def mcq_prompt(passage: Column, language: Column, index: Column, existing: Column) -> Column:
    """One question; the last five earlier questions are named as ones to avoid."""
    recent = F.when(F.size(existing) > 5, F.slice(existing, -5, 5)).otherwise(existing)
    avoid = F.when(F.size(existing) > 0, F.concat(F.lit("\nAvoid:\n"), F.array_join(F.transform(recent, lambda q: F.concat(F.lit("- "), q)), "\n"))).otherwise("")
    hint = F.element_at(F.array(*map(F.lit, HINTS)), (index % len(HINTS) + 1).cast("int"))
    return F.concat(F.lit("Question "), (index + 1).cast("string"), F.lit(". "), hint, F.lit(" "), _language(language), avoid, F.lit("\nPassage:\n"), passage)


def batch_prompt(passage: Column, language: Column, n: Column, plan_lines: Column) -> Column:
    return F.concat(F.lit("Write "), n.cast("string"), F.lit(" questions as a JSON array. "), _language(language), F.lit("\nPlan:\n"), plan_lines, F.lit("\nPassage:\n"), passage)


def distractor_prompt(passage: Column, correct: Column, candidates: Column) -> Column:
    listed = F.array_join(F.transform(F.slice(candidates, 1, 6), lambda c: F.concat(F.lit('"'), c, F.lit('"'))), ",")
    return F.concat(F.lit("Correct: "), correct, F.lit("\nCandidates: ["), listed, F.lit("]\nPassage:\n"), passage)


def short_prompt(passage: Column, language: Column) -> Column:
    return F.concat(F.lit("Ask one short-answer question. "), _language(language), F.lit("\nPassage:\n"), passage)


def true_false_prompt(passage: Column, language: Column) -> Column:
    return F.concat(F.lit("Write one true or false statement. "), _language(language), F.lit("\nPassage:\n"), passage)


def token_budget(n: Column) -> Column:
    return F.greatest(F.lit(8192), F.least(600 * n + 500, F.lit(16384)))


class Model(Protocol):
    """What ``generate`` calls: prompts in, texts out."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def generate(prompts: DataFrame, model: Model, key: str, prompt_col: str = "prompt") -> DataFrame:
    """(key, output): a model called in Arrow batches on the executors."""

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "output": model(frame[prompt_col].tolist())})

    return prompts.select(key, prompt_col).mapInPandas(kernel, f"{key} {prompts.schema[key].dataType.simpleString()}, output string")


class Adapter:
    """The five requests to a model, each over rows of passages and with a (key, output) row for each; ``output`` is the model's text.

    With a ledger, prompts that it has answers to are not asked again.
    """

    def __init__(self, model: Model, key: str, ledger: Ledger | None = None):
        self.model, self.key, self.ledger = model, key, ledger

    def _ask(self, rows: DataFrame, prompt: Column) -> DataFrame:
        if self.ledger:
            return self.ledger.ask(rows.select(self.key, prompt.alias("prompt")), self.model, self.key)
        return generate(rows.select(self.key, prompt.alias("prompt")), self.model, self.key)

    def multiple_choice(self, rows: DataFrame) -> DataFrame:
        """rows: passage, language, index, existing (earlier questions)."""
        return self._ask(rows, mcq_prompt(F.col("passage"), F.col("language"), F.col("index"), F.col("existing")))

    def batch(self, rows: DataFrame) -> DataFrame:
        """rows: passage, language, n, plan_lines."""
        return self._ask(rows, batch_prompt(F.col("passage"), F.col("language"), F.col("n"), F.col("plan_lines")))

    def distractors(self, rows: DataFrame) -> DataFrame:
        """rows: passage, correct, candidates."""
        return self._ask(rows, distractor_prompt(F.col("passage"), F.col("correct"), F.col("candidates")))

    def short_answer(self, rows: DataFrame) -> DataFrame:
        """rows: passage, language."""
        return self._ask(rows, short_prompt(F.col("passage"), F.col("language")))

    def true_false(self, rows: DataFrame) -> DataFrame:
        """rows: passage, language."""
        return self._ask(rows, true_false_prompt(F.col("passage"), F.col("language")))


# ---- repair of JSON that was cut off

_DECODER = json.JSONDecoder()


def repair_json(text: str | None) -> str | None:
    """All whole objects of a damaged JSON text as an array (a lone object as itself); null if there is none.

    Objects are read one after another from the first brace on; trailing commas are dropped. Reading
    stops at the first object that is incomplete.
    """
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False)
    except ValueError:
        pass
    start = re.search(r"[\[{]", text)
    if not start:
        return None
    found, at = [], text.find("{", start.start())
    while at >= 0:
        try:
            value, end = _DECODER.raw_decode(text, at)
        except ValueError:
            end = _object_end(text, at)
            try:
                value = json.loads(re.sub(r",(\s*[}\]])", r"\1", text[at:end])) if end else None
            except ValueError:
                value = None
            if value is None:
                break
        found.append(value)
        at = text.find("{", end)
    if not found:
        return None
    return json.dumps(found if start.group() == "[" or len(found) > 1 else found[0], ensure_ascii=False)


def _object_end(text: str, at: int) -> int:
    """Place behind the brace that closes the object at ``at``; 0 if none does. Strings are passed over whole."""
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S).finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth:
            return m.end()
    return 0


def repaired(texts: DataFrame, key: str, text_col: str) -> DataFrame:
    def kernel(frames):
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "repaired": [repair_json(x) for x in frame[text_col]]})

    return texts.select(key, text_col).mapInPandas(kernel, f"{key} {texts.schema[key].dataType.simpleString()}, repaired string")


QUESTION = "array<struct<question: string, choices: array<string>, answer: string>>"


def valid_questions(parsed: Column) -> Column:
    """Questions that have a text, choices and an answer."""
    return F.filter(parsed, lambda q: q["question"].isNotNull() & q["choices"].isNotNull() & q["answer"].isNotNull())
