"""What stages report as they end: counts, never values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Event:
    """One stage of a run; no field of it can hold a value of a document."""

    op: str
    rows: int
    errors: int


class Stages:
    """Stages of a plan that are watched; the counts come with the action that runs the plan, in the same pass over the data."""

    def __init__(self, hook: Callable[[Event], None]):
        self.hook, self.watched = hook, []

    def watch(self, df: DataFrame, op: str, failed: Column | None = None) -> DataFrame:
        """df, whose rows, and those that `failed` holds for, are counted as the stage `op`."""
        seen = Observation(op)
        self.watched.append((op, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.lit(False) if failed is None else failed).alias("errors"))

    def report(self) -> None:
        """Calls the hook with each stage, in the order in which they were watched; call it after the action."""
        for op, seen in self.watched:
            got = seen.get
            self.hook(Event(op, got["rows"], got["errors"]))
        self.watched = []


def final_events(answers: DataFrame) -> DataFrame:
    """(doc_id, op, fields, confidence, review) of scored documents: how many fields were found, never which or what."""
    found = F.size(F.filter(F.map_values("fields"), lambda f: f["found"]))
    return answers.select("doc_id", F.lit("score").alias("op"), found.alias("fields"), "confidence", F.col("needs_review").alias("review"))
