"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs: lines, and long lines after every few words; the parts join back to the text. Their
64-bit digests (the n-th repetition of a paragraph has its own) go into three cells each of a small table of counts, XORs of digests and
XORs of check sums. Subtracting the tables of two texts cell by cell cancels what they share, and peeling cells that
hold one digest recovers the digests in which they differ. If peeling stops early, tables four times as
large are made of both, until it succeeds. The likeness of two texts is the share of common paragraphs among all.

Null texts are empty; two texts without paragraphs have the likeness 1. Documents follow each other by
doc_id, null first, rows with the same doc_id by text; after the last comes the first.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lutrin.llm.common import NULL_ID, U64, long_rows, mixed

PARAGRAPH = re.compile(r"(?:\S+[^\S\n]*){1,8}\n?|\s+")
CELLS = 18
GROWTH = 4
RANGES, RANGE_BYTES, MOST_RANGES = 512, 4 << 20, 10_000
AT_ONCE = 256
OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def digests(text: str) -> np.ndarray:
    """Digests of the paragraphs of a text, all different."""
    parts = PARAGRAPH.findall(text)
    keys = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in parts], U64)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    again = np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))
    with np.errstate(over="ignore"):
        return mixed(keys + again.astype(U64) * U64(0x9E3779B97F4A7C15))


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys ^ U64(0xA5A5A5A55A5A5A5A)) >> U64(32)).astype(np.uint32)


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of every digest, one row each, for tables of this size."""
    third = cells // 3
    with np.errstate(over="ignore"):
        return np.stack([(mixed(keys + U64(cells * 4 + i)) % U64(third)).astype(np.int64) + i * third for i in range(3)])


class Tables:
    """Tables of many texts at once, one row per text."""

    def __init__(self, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.count, self.key, self.check = count, key, check

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Tables:
        out = cls(np.zeros((len(sets), cells), np.int32), np.zeros((len(sets), cells), U64), np.zeros((len(sets), cells), np.uint32))
        if sets:
            keys = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            out._toggle(owner, keys, np.ones(len(keys), np.int32))
        return out

    def _toggle(self, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        cells, check = self.count.shape[1], _checks(keys)
        for place in _places(keys, cells):
            at = owner * cells + place
            np.add.at(self.count.reshape(-1), at, sign)
            np.bitwise_xor.at(self.key.reshape(-1), at, keys)
            np.bitwise_xor.at(self.check.reshape(-1), at, check)

    def __sub__(self, other: Tables) -> Tables:
        return Tables(self.count - other.count, self.key ^ other.key, self.check ^ other.check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and sign of everything recovered from a difference, and which rows came out whole."""
        rows, cells = self.count.shape
        found = []
        while True:
            count, key = self.count.reshape(-1), self.key.reshape(-1)
            at = np.flatnonzero(np.abs(count) == 1)
            at = at[_checks(key[at]) == self.check.reshape(-1)[at]]
            if not len(at):
                break
            owner, keys, sign = at // cells, key[at], count[at]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            new = np.ones(len(at), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, sign = owner[new], keys[new], sign[new]
            self._toggle(owner, keys, -sign)
            found.append((owner, keys, sign))
        whole = ~(self.count.any(axis=1) | self.key.any(axis=1) | self.check.any(axis=1))
        merged = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3)]
        return merged[0], merged[1], merged[2], whole

    def text(self, row: int, size: int) -> str:
        raw = self.count[row].tobytes() + self.key[row].tobytes() + self.check[row].tobytes()
        return f"{size}.{base64.b64encode(raw).decode()}"


def differences(a: list[np.ndarray], b: list[np.ndarray], first: Tables | None = None, cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every pair of digest sets, what only the first holds and what only the second holds, by peeling."""
    out: list = [None] * len(a)
    open_ = np.arange(len(a))
    while len(open_):
        difference = first or Tables.of([a[i] for i in open_], cells) - Tables.of([b[i] for i in open_], cells)
        first = None
        owner, keys, sign, whole = difference.peel()
        order = np.argsort(owner, kind="stable")
        keys, sign = keys[order], sign[order]
        ends = np.searchsorted(owner[order], np.arange(len(open_) + 1))
        for n in np.flatnonzero(whole):
            k, s = keys[ends[n]:ends[n + 1]], sign[ends[n]:ends[n + 1]]
            out[open_[n]] = (k[s > 0], k[s < 0])
        open_, cells = open_[~whole], cells * GROWTH
    return out


def likeness(size_a: int, size_b: int, different: int) -> float:
    either = (size_a + size_b + different) / 2
    return (size_a + size_b - different) / 2 / either if either else 1.0


def _rows(held: list[tuple[int | None, str, str]]) -> pd.DataFrame:
    """Results of documents, each given with its id, text and the next text."""
    edited = [text[:len(text) - len(text) // 2] + after[:len(text) // 2] for _, text, after in held]
    own, new, nxt = ([digests(t) for t in texts] for texts in ([h[1] for h in held], edited, [h[2] for h in held]))
    a, b, c = (Tables.of(s, CELLS) for s in (own, new, nxt))
    to_edited, to_next = differences(own, new, a - b), differences(own, nxt, a - c)
    out = []
    for i, (doc_id, text, _) in enumerate(held):
        near = [likeness(len(own[i]), len(o[i]), len(d[i][0]) + len(d[i][1])) for o, d in ((new, to_edited), (nxt, to_next))]
        out.append((doc_id, len(text), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(),
                    a.text(i, len(own[i])), b.text(i, len(new[i])), *near))
    made = pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")])
    return made.astype({"doc_id": "Int64"})


def _streamed(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range, own before following: every own row meets the row after it."""
    held, before, size = [], None, 0
    for pdf in pdfs:
        for key, text, part, after in zip(pdf["_key"], pdf["text"], pdf["_part"], pdf["_after"], strict=True):
            text = text or ""
            if before is not None and before[2] == part and not before[3]:
                held.append((None if before[0] == NULL_ID else int(before[0]), before[1], text))
                size += len(before[1]) + len(text)
                if len(held) >= AT_ONCE or size > 1 << 22:
                    yield _rows(held)
                    held, size = [], 0
            before = (key, text, part, after)
    if held:
        yield _rows(held)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of docs (doc_id, text, any more), of its edited form, and likenesses.

    Documents are dealt to ranges of doc_id (quantiles, at most MOST_RANGES on the driver) and streamed in order; only the first
    document of each range is also sent to the range before.
    """
    rows = long_rows(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_key"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(min(MOST_RANGES, max(RANGES, size // RANGE_BYTES)))
    marks = rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = np.unique(np.array(marks, np.int64))

    @F.pandas_udf(T.IntegerType())
    def part_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left").astype(np.int32))

    heads = sorted((r["p"], r["k"]) for r in rows.select("_key", part_of("_key").alias("p")).groupBy("p").agg(F.min("_key").alias("k")).collect())
    if not heads:
        return docs.sparkSession.createDataFrame([], OUT)
    before = [(heads[i - 1][0], k) for i, (_, k) in enumerate(heads)]
    after = F.broadcast(docs.sparkSession.createDataFrame(before, "_part int, _key long"))
    own = rows.select("_key", "text", part_of("_key").alias("_part"), F.lit(False).alias("_after"))
    following = rows.join(after, "_key").select("_key", "text", "_part", F.lit(True).alias("_after"))
    dealt = own.unionByName(following).repartition("_part").sortWithinPartitions("_part", "_after", "_key", "text")
    return dealt.mapInPandas(_streamed, OUT)
