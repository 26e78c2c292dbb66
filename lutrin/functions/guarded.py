"""A user's embedder or model behind a guard: a text on which it raises becomes an error of its own row, not of the run."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def halved(function: Callable[[pd.Series], Iterable], texts: pd.Series) -> tuple[list, list]:
    """Values and errors of a batch. A part in which the function raises, or returns another number of values, is halved until the
    failing rows stand alone; so every other row is computed at most 1 + log2(n) times.
    """
    values, errors = [None] * len(texts), [None] * len(texts)
    parts = [(0, len(texts))] if len(texts) else []
    while parts:
        low, high = parts.pop()
        try:
            found = list(function(texts.iloc[low:high]))
            if len(found) != high - low:
                raise ValueError(f"{len(found)} values for {high - low} texts")
        except Exception as e:  # noqa: BLE001  whatever a user's function raises
            if high - low == 1:
                errors[low] = f"{type(e).__name__}: {e}"
            else:
                middle = (low + high) // 2
                parts += [(middle, high), (low, middle)]
        else:
            values[low:high] = found
    return values, errors


def guarded(function: Callable[[pd.Series], Iterable], value_type: str = "array<double>") -> Callable[[Column], Column]:
    """A column function: text to struct<value, error>; `function` takes a batch of texts and returns one value each.

    Null texts are not handed on; their value and error are null.
    """
    @F.pandas_udf(f"struct<value:{value_type},error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            given = texts.notna().to_numpy()
            values, errors = halved(function, texts[given])
            out = pd.DataFrame({"value": pd.Series([None] * len(texts), dtype="object"), "error": pd.Series([None] * len(texts), dtype="object")})
            at = given.nonzero()[0]
            for place, value, error in zip(at.tolist(), values, errors, strict=True):
                out.at[place, "value"], out.at[place, "error"] = value, error
            yield out
    return run
