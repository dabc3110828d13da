"""User functions that are run row by row and may fail: an error stays with its row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tallysift.sources.sinks import STAGES


def run_isolated(items: DataFrame, worker: Callable[[dict], object], key: str, stage: str, result: str = "double", index: str | None = None) -> DataFrame:
    """(file, result, index, stage, exception_type, message) of every row of items.

    ``worker`` gets a row as a dictionary. Where it raises, the result is null and the last three columns say why, the message cut
    to 200 characters; else they are null. ``index`` names a column that gives the row's place. Rows of a batch are
    held in memory, no more; a lost task runs its rows again, so the worker must not mind.
    """
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                at = row.get(index) if index else None
                try:
                    out.append((str(row[key]), worker(row), at, None, None, None))
                except Exception as error:  # whatever a user's function raises
                    out.append((str(row[key]), None, at, stage, type(error).__name__, str(error)[:200]))
            yield pd.DataFrame(out, columns=["file", "result", "index", "stage", "exception_type", "message"])

    return items.mapInPandas(run, f"file string, result {result}, index long, stage string, exception_type string, message string")


def split_results(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (file, result, index) and failures (file, stage, exception_type, message, index)."""
    return done.filter("stage is null").select("file", "result", "index"), done.filter("stage is not null").select("file", "stage", "exception_type", "message", "index")
