"""Requests to a model that can be resumed: answers are kept by prompt, failures are retried with growing waits and then written down."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.storage import discard, staged

ENTRY = "prompt_key string, output string, error string, attempts int"
#: Requests of one task: what a lost executor may cost at most.
TASK_REQUESTS = 500
#: Prompts in one call of the model.
CALL_PROMPTS = 16
#: Longest wait between two attempts, in seconds.
LONGEST_WAIT = 60.0


class Refused(Exception):
    """A model raises this for prompts that no retry will help."""


def _attempts(model: Callable[[list[str]], list[str]], prompts: list[str], tries: int, wait: float) -> Iterator[tuple[str | None, str | None, int]]:
    """(output, error, attempts) of each prompt. A call that keeps failing is halved, so one bad prompt costs the others nothing."""
    error = ""
    for attempt in range(1, tries + 1):
        try:
            out = list(model(prompts))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            for text in out:
                yield (text, None, attempt) if text is not None else (None, "no answer", attempt)
            return
        except Exception as problem:  # whatever a remote call raises: it is written down
            error = f"{type(problem).__name__}: {problem}"[:500]
            if isinstance(problem, Refused):
                break
            if attempt < tries:
                time.sleep(min(wait * 2 ** (attempt - 1), LONGEST_WAIT))
    if len(prompts) == 1:
        yield None, error, attempt
        return
    half = len(prompts) // 2
    for part in (prompts[:half], prompts[half:]):
        yield from _attempts(model, part, tries, wait)


@dataclass
class Ledger:
    """Answers and failures in ``path``, a folder that all executors share.

    A finished task's answers stay even where its job dies later, as the writes commit task by task. So a second
    run asks only for prompts that have no answer yet, failed ones included; equal prompts are asked once. A
    task that is lost half-way is asked again as a whole, ``task_requests`` at most. Null prompts get a null output.
    """

    spark: SparkSession
    path: str
    tries: int = 4
    wait: float = 1.0
    task_requests: int = TASK_REQUESTS

    @property
    def entries(self) -> DataFrame:
        """(prompt_key, output, error, attempts): all that was written down; failed prompts may have several rows."""
        self.spark.createDataFrame([], ENTRY).write.mode("append").parquet(self.path)  # the folder is there from here on
        return self.spark.read.schema(ENTRY).option("recursiveFileLookup", "true").parquet(self.path)

    @property
    def answers(self) -> DataFrame:
        """(prompt_key, output): one row for each prompt that has an answer; the least where runs met."""
        return self.entries.where("output is not null").groupBy("prompt_key").agg(F.min("output").alias("output"))

    def failed(self) -> DataFrame:
        """(prompt_key, error, attempts) of prompts without an answer; attempts of all runs are added up."""
        rows = self.entries.groupBy("prompt_key").agg(F.count("output").alias("n"), F.max("error").alias("error"), F.sum("attempts").alias("attempts"))
        return rows.where("n = 0").drop("n")

    def missing(self, prompts: DataFrame, prompt_col: str = "prompt") -> DataFrame:
        """(prompt_key, prompt): different prompts that have no answer."""
        keyed = prompts.where(F.col(prompt_col).isNotNull()).select(F.sha2(prompt_col, 256).alias("prompt_key"), F.col(prompt_col).alias("prompt"))
        return keyed.join(self.answers, "prompt_key", "left_anti").groupBy("prompt_key").agg(F.min("prompt").alias("prompt"))

    def ask(self, prompts: DataFrame, model: Callable[[list[str]], list[str]], key: str, prompt_col: str = "prompt") -> DataFrame:
        """(key, output) of every row; output is null where the model failed, see ``failed``."""
        prompts = staged(prompts.select(key, prompt_col), "prompts")
        missing = staged(self.missing(prompts, prompt_col), "missing")
        n = missing.count()
        if n:
            tries, wait = self.tries, self.wait

            def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    for at in range(0, len(frame), CALL_PROMPTS):
                        part = frame.iloc[at : at + CALL_PROMPTS]
                        rows = list(_attempts(model, part["prompt"].tolist(), tries, wait))
                        yield pd.DataFrame({"prompt_key": part["prompt_key"].tolist(), "output": [r[0] for r in rows], "error": [r[1] for r in rows], "attempts": [r[2] for r in rows]})

            spread = missing.repartition(-(-n // self.task_requests), "prompt_key")
            # Version 2 of the committer moves a task's file into place when the task ends, not when the job does.
            spread.mapInPandas(kernel, ENTRY).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.path}/run={uuid.uuid4().hex}")
        discard(missing)
        keyed = prompts.select(key, F.sha2(prompt_col, 256).alias("prompt_key"))
        return keyed.join(self.answers, "prompt_key", "left").select(key, "output")
