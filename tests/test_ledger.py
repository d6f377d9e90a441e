"""Requests that fail, are limited, stop half-way and go on."""

import uuid
from pathlib import Path

import pytest

from lexmill.operators.generation import Adapter
from lexmill.operators.ledger import Ledger, Refused
from lexmill.storage import shared_dir


def counting(folder):
    """A model that answers with the prompt in capitals and notes each request in a file. Bad prompts always fail, shy ones the first two times."""
    folder = str(folder)

    def model(prompts):
        for p in prompts:
            seen = len(list(Path(folder).glob(f"{p}-*")))
            Path(folder, f"{p}-{uuid.uuid4().hex}").touch()
            if p.startswith("never"):
                raise Refused("not this one")
            if p.startswith("bad") or (p.startswith("shy") and seen < 2):
                raise TimeoutError("too many requests")
        return [p.upper() for p in prompts]

    return model


def requests(folder, prompt):
    return len(list(Path(folder).glob(f"{prompt}-*")))


def ledger(spark, **options):
    return Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}", wait=0.01, **options)


def rows(spark, prompts):
    return spark.createDataFrame(list(enumerate(prompts)), "id long, prompt string")


def test_failures_are_retried_and_written_down(spark, tmp_path):
    model, book = counting(tmp_path), ledger(spark, tries=3)
    asked = rows(spark, ["a", "b", "shy1", "bad1", "never1", "a", None, ""])
    out = {r.id: r.output for r in book.ask(asked, model, "id").collect()}
    assert out == {0: "A", 1: "B", 2: "SHY1", 3: None, 4: None, 5: "A", 6: None, 7: ""}
    failed = {r.error.split(":")[0]: r.attempts for r in book.failed().collect()}
    assert failed == {"TimeoutError": 3, "Refused": 1}


def test_a_second_run_asks_for_what_is_missing(spark, tmp_path):
    model, book = counting(tmp_path), ledger(spark, tries=1)
    first = [f"p{i}" for i in range(40)]
    book.ask(rows(spark, first), model, "id")
    out = Ledger(spark, book.path).ask(rows(spark, [*first, "q"]), model, "id").collect()
    assert sorted(r.output for r in out) == sorted(p.upper() for p in [*first, "q"])
    assert all(requests(tmp_path, p) == 1 for p in [*first, "q"])
    assert book.missing(rows(spark, [*first, "q", "r"])).count() == 1


def test_answers_of_finished_tasks_outlive_their_job(spark, tmp_path):
    model, book = counting(tmp_path), ledger(spark, task_requests=1)
    prompts = [f"w{i}" for i in range(12)]

    def dies(texts):
        if texts == ["w7"]:
            import time

            time.sleep(3)  # the other tasks end first
            raise SystemExit("the worker is gone")
        return model(texts)

    with pytest.raises(Exception, match="gone"):
        book.ask(rows(spark, prompts), dies, "id")
    kept = {r.output for r in book.answers.collect()}
    assert len(kept) >= 6 and "W7" not in kept
    out = book.ask(rows(spark, prompts), model, "id").collect()
    assert len([r for r in out if r.output]) == 12
    assert all(requests(tmp_path, p.lower()) == 1 for p in kept)


def test_adapter_with_a_ledger(spark, tmp_path):
    calls = Path(tmp_path)

    def model(prompts):
        for _ in prompts:
            (calls / uuid.uuid4().hex).touch()
        return [str(len(p)) for p in prompts]

    adapter = Adapter(model, "id", ledger(spark))
    passages = spark.createDataFrame([(1, "one", "en"), (2, "two!", "vi")], "id long, passage string, language string")
    assert adapter.short_answer(passages).count() == adapter.short_answer(passages).count() == 2
    assert len(list(calls.iterdir())) == 2


def test_no_prompts(spark, tmp_path):
    book = ledger(spark)
    assert book.ask(rows(spark, []), counting(tmp_path), "id").count() == 0 and book.failed().count() == 0
