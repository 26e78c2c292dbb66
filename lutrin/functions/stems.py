"""Stems of whole Arrow batches of words: every distinct word of a batch is stemmed once. Same rules as `nlp.text_stems`."""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.text import terms

ENDING = re.compile(r"^(.{3,}?)é?e?r?[sx]?\Z")
UNACCENT = str.maketrans(L.ACCENTED, L.UNACCENTED)
STOP = frozenset(L.STOPWORDS)


def split_words(text: Column) -> Column:
    """Lower-case words of a text, the input of `stemmed`."""
    return terms(F.lower(F.coalesce(text, F.lit(""))))


def stem(word: str) -> str | None:
    """Stem of a lower-case word, null for a function word."""
    if word.translate(UNACCENT) in STOP:
        return None
    if len(word) >= 5 and word.endswith("aux"):
        word = word[:-2] + "l"
    word = ENDING.sub(r"\1", word)
    return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


KEPT = 300_000  # words and stems a worker remembers; more are forgotten together


def remembered(name: str, make: Callable, keys: list[str]) -> list:
    """The values of keys, made once and kept for later batches and tasks of the same worker."""
    kept = sys.modules.setdefault("_lutrin_words", types.ModuleType("_lutrin_words")).__dict__.setdefault(name, {})
    if len(kept) > KEPT:
        kept.clear()
    missing = object()
    out = [kept.get(k, missing) for k in keys]
    for i, v in enumerate(out):
        if v is missing:
            out[i] = kept[keys[i]] = make(keys[i])
    return out


def stemmed(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Row and stem number of every word that is no function word, and the stems by number."""
    rows = pc.list_parent_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.list_flatten(words).dictionary_encode()
    found = remembered("stems", stem, coded.dictionary.to_pylist())
    number: dict[str, int] = {}
    codes = np.array([-1 if s is None else number.setdefault(s, len(number)) for s in found], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
    return rows[codes >= 0], codes[codes >= 0], list(number)
