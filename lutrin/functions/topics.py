"""Topic tags of whole Arrow batches of passages: every keyword is searched once in all texts of a batch. Same rules as `nlp.mechanics`.

The texts of a batch are one row of bytes, divided by a byte that UTF-8 does not use. Short keywords count as whole words; where the sign
beside one is beyond the Latin blocks, the column rules decide.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lutrin.functions import lexicon as L
from lutrin.functions.nlp import _whole
from lutrin.functions.text import folded_literal

ASIDE = "?"  # before a tag: the column rules decide
END = b"\xff"
FOLDS = [(a.encode(), b.encode()) for a, b in zip(L.ACCENTED, L.UNACCENTED, strict=True)]


def _short(keywords: list[str]) -> list[str]:
    return [k.lower() for k in keywords if len(k) < L.SHORT_KEYWORD]


def _tags_by(forms) -> dict[bytes, list[str]]:
    """Tags by keyword; `forms` gives the forms of a tag's keywords."""
    found: dict[bytes, list[str]] = {}
    for tag, (_, keywords) in L.MECHANICS.items():
        for form in forms(keywords):
            found.setdefault(form.encode(), []).append(tag)
    return found


ANYWHERE = _tags_by(lambda keywords: {folded_literal(k) for k in keywords if len(k) >= L.SHORT_KEYWORD})
ALONE = _tags_by(_short)


def _ends_word(sign: bytes) -> bool | None:
    """Whether a sign beside a word ends it; None for a part of one beyond the Latin blocks, which is not decided here."""
    if sign[:1] in (b"", END):
        return True
    try:
        return unicodedata.category(sign.decode())[0] not in "LN"
    except (UnicodeDecodeError, TypeError):
        return None


def _stands_alone(raw: bytes, start: int, end: int) -> bool | None:
    """Whether raw[start:end] is a whole word, None if that is not decided here."""
    before = raw[start - 2:start] if start > 1 and 0xC2 <= raw[start - 2] < 0xCA else raw[max(start - 1, 0):start]
    after = raw[end:end + 2] if end < len(raw) and 0xC2 <= raw[end] < 0xCA else raw[end:end + 1]
    sides = (_ends_word(before), _ends_word(after))
    return False if False in sides else None if None in sides else True


def tags_of(texts: list[bytes | None]) -> list[list[str]]:
    """Sorted tags of every lower-case text; behind ASIDE those that the column rules decide."""
    raw = b"".join((t or b"") + END for t in texts)
    folded = raw
    for accented, plain in FOLDS:
        folded = folded.replace(accented, plain)
    found = [set() for _ in texts]
    ends = np.flatnonzero(np.frombuffer(folded, np.uint8) == END[0]).tolist()
    for form, tags in ANYWHERE.items():
        at = folded.find(form)
        while at >= 0:
            row = bisect_left(ends, at)
            found[row].update(tags)
            at = folded.find(form, ends[row])
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == END[0]).tolist()
    for form, tags in ALONE.items():
        at = raw.find(form)
        while at >= 0:
            alone, nearest = _stands_alone(raw, at, at + len(form)), at + 1
            if alone is not False:
                row = bisect_left(ends, at)
                found[row].update(tags if alone else [ASIDE + t for t in tags])
                nearest = ends[row] if alone else nearest
            at = raw.find(form, nearest)
    return [sorted((t for t in tags if t[0] != ASIDE or t[1:] not in tags), key=lambda t: t.lstrip(ASIDE)) for tags in found]


def mechanics(text: Column) -> Column:
    """Sorted topic tags mentioned in a passage, as `nlp.mechanics` finds them."""
    @F.arrow_udf("array<string>")
    def tags(low: pa.Array) -> pa.Array:
        return pa.array(tags_of(low.cast(pa.binary()).to_pylist()), pa.list_(pa.string()))

    low = F.lower(text)
    doubtful = {tag: _whole(_short(keywords)) for tag, (_, keywords) in L.MECHANICS.items() if _short(keywords)}

    def decided(tag: Column) -> Column:
        kept = F.when(~tag.startswith(ASIDE), tag)
        for name, pattern in doubtful.items():
            kept = kept.when((tag == ASIDE + name) & low.rlike(pattern), F.lit(name))
        return kept
    return F.array_compact(F.transform(tags(low), decided))
