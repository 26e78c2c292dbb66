"""Best-fit packing by a configuration linear program over the length histogram.

Texts become token ids plus an end id; longer ones are cut into pieces of the capacity. Only the histogram of
piece lengths (at most one entry per length) reaches the driver. There the configuration program is solved by
multiplicative weights: lengths that are covered little weigh more, and the next configuration is the best
knapsack under these weights, found by dynamic programming. Every piece finds its sequence from its rank within its length, in parallel.

Lengths are rounded up to UNIT tokens for the program; pieces under SMALL tokens are first bundled with others of equal
length. The whole multiples of its configurations are filled with exact lengths, the last place of each with the
longest piece that fits what rounding had left over. The rest is placed best-fit decreasing into the exact gaps of these
sequences and into new ones. Null and empty texts are one piece that holds the end id alone. Rows that share a doc_id are
packed one by one.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lutrin.llm.common import byte_batches, long_rows, release_memory, running, worker_value, written

CAPACITY = 4096
END_ID = 1
UNIT = 8
SMALL = 128
BUNDLE = 1024
STEP = 0.2
SHARPNESS = 6.0
REST = 20_000
TRIED = 64
CACHED_WORDS = 150_000
#: Texts whose signs need no Unicode tables: blanks, printable ASCII and the Latin-1 letters, which lower-case one to one.
PLAIN = re.compile(r"[ \n\t\r!-~À-ÖØ-öø-ÿ]+")
PLAIN_WORD = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \n\t\ra-z0-9ß-öø-ÿ]+")
BLANKS = re.compile(r"[ \n\t\r]+")


def _byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies use for each byte: itself if it is visible, else the next from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


class TokenParts(dict):
    """Bytes of the ids of words; those not used since CACHED_WORDS others came are forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        self[word] = ids = self.make(word) if ids is None else ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHED_WORDS:
            self.older = dict(self)
            self.clear()


class WordTokenizer:
    """Token ids of texts from a file of the `tokenizers` library whose tokens never cross white space.

    Plain texts, and the plain runs between blanks of others, are cut by the file's own rule for words (lower case, contractions,
    letters, single digits, signs), and each word goes to the vocabulary model once; other runs go through the whole encoder.
    """

    def __init__(self, path: str):
        import tokenizers

        self.encoder = tokenizers.Tokenizer.from_file(path)
        self.model = self.encoder.model
        self.signs = _byte_signs()
        self.words = TokenParts(self._word)
        self.runs = TokenParts(self._run)

    def _word(self, word: str) -> bytes:
        spelled = word if word.isascii() else "".join(map(self.signs.__getitem__, word.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _run(self, run: str) -> bytes:
        if PLAIN.fullmatch(run) and "<|" not in run:
            return self._plain(run)
        return array("I", self.encoder.encode(run, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PLAIN_WORD.findall(text.lower())))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if PLAIN.fullmatch(text) and "<|" not in text:
            out = self._plain(text)
        else:
            out = b"".join(map(self.runs.__getitem__, BLANKS.split(text)))
        self.words.trim()
        self.runs.trim()
        return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece, and its `ids` if wanted."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    width, end = 4 * capacity, end_id.to_bytes(4, "little")

    def cut(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = worker_value(f"tokenizer {path}", lambda: WordTokenizer(path))
        for pdf in pdfs:
            for batch in byte_batches(zip(pdf["doc_id"], pdf["text"], strict=True), lambda r: len(r[1] or "")):
                out = []
                for doc_id, text in batch:
                    ids = tokenizer.encode(text) + end
                    for n, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        row = (doc_id, n, at // 4, len(part) // 4, zlib.crc32(part))
                        out.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if with_ids else row)
                made = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
                yield made.astype({"doc_id": "Int64"})
        release_memory()

    return long_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def _knapsack(worth: np.ndarray, sizes: np.ndarray, capacity: int) -> Counter:
    """The multiset of sizes of greatest worth that fits the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(sizes, c, side="right")
        if n:
            value = best[c - sizes[:n]] + worth[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], taken[c] = value[k], k
    chosen: Counter = Counter()
    c = capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            chosen[int(taken[c])] += 1
            c -= int(sizes[taken[c]])
    return chosen


def _fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Configurations with fractional numbers that cover all counts, by multiplicative weights."""
    covered, out = np.zeros(len(sizes)), {}
    while (open_ := covered < counts * (1 - 1e-9)).any():
        live = np.flatnonzero(open_)
        share = covered[live] / counts[live]
        worth = sizes[live] / capacity * np.exp(-SHARPNESS * (share - share.min()))
        chosen = _knapsack(worth, sizes[live], capacity)
        config = tuple(sorted((int(live[k]), a) for k, a in chosen.items()))
        left = min((counts[k] - covered[k]) / a for k, a in config)
        step = min(min(counts[k] / a for k, a in config) * STEP, left) if left > 0 else 0
        step = max(step, min(left, 1.0))
        for k, a in config:
            covered[k] += a * step
        out[config] = out.get(config, 0.0) + step
    return out


def solve(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[tuple, int]]:
    """Configurations ((index of size, how many), ...) and how often each is used: the whole multiples, within the counts."""
    left, plan = counts.astype(np.int64).copy(), Counter()
    while left.any():
        live = np.flatnonzero(left)
        before = left.sum()
        for config, times in sorted(_fractional(sizes[live], left[live].astype(float), capacity).items(), key=lambda x: -x[1]):
            own = tuple((int(live[k]), a) for k, a in config)
            n = min(int(times + 1e-9), *(int(left[k]) // a for k, a in own))
            if n > 0:
                plan[own] += n
                for k, a in own:
                    left[k] -= n * a
        if left.sum() <= REST or left.sum() > 0.9 * before:
            break
    return sorted(plan.items(), key=lambda x: (-x[1], x[0]))


def filled(sizes: np.ndarray, counts: np.ndarray, plan: list[tuple[list[int], int]], capacity: int) -> tuple[list, np.ndarray]:
    """Sequences of the plan with exact sizes, as runs (gap, configuration, how often), and the counts that are left.

    `plan` holds the most that each place of a configuration may take, in descending order, and how often it is used. A place
    takes the largest size within that, the last one the largest that fits the gap; of TRIED sizes for the place before it
    the one is taken that leaves the smallest gap.
    """
    left = counts.astype(np.int64).tolist()
    live = sorted((int(n), k) for k, n in enumerate(sizes) if left[k])
    runs = []

    def within(most: int, used: Counter, tried: int = 1) -> list[tuple[int, int]]:
        """The largest sizes up to `most` that are left, and their indices."""
        found, at = [], bisect_left(live, (most + 1, -1)) - 1
        while at >= 0 and len(found) < tried:
            if left[live[at][1]] > used[live[at][1]]:
                found.append(live[at])
            at -= 1
        return found

    for places, times in plan:
        while times:
            gap, used = capacity, Counter()
            for i, most in enumerate(places):
                found = within(gap if i == len(places) - 1 else min(gap, most), used, TRIED if i == len(places) - 2 else 1)
                best = None
                for size, k in found if len(found) > 1 else ():
                    last = within(gap - size, used + Counter([k]))
                    rest = gap - size - (last[0][0] if last else 0)
                    if best is None or rest < best[0]:
                        best = rest, (size, k)
                    if not rest:
                        break
                for size, k in [best[1]] if best else found:
                    used[k] += 1
                    gap -= size
            if not used:
                break
            n = min(times, *(left[k] // a for k, a in used.items()))
            runs.append((gap, tuple(sorted(used.items())), n))
            times -= n
            for k, a in used.items():
                left[k] -= n * a
                if not left[k]:
                    del live[bisect_left(live, (int(sizes[k]), k))]
    return runs, np.array(left, np.int64)


def best_fit(sizes: np.ndarray, counts: np.ndarray, capacity: int, begun: list = ()) -> list[tuple[tuple, int]]:
    """Best-fit decreasing into begun sequences (gap, configuration, how often) and new ones, in runs of equal sequences."""
    gaps: list[int] = []
    open_: dict[int, list[tuple[tuple, int]]] = defaultdict(list)
    plan, least = Counter(), int(sizes[counts > 0].min(initial=capacity + 1))

    def put(gap: int, config: tuple, times: int) -> None:
        if gap < least:
            plan[config] += times
            return
        if gap not in open_:
            insort(gaps, gap)
        open_[gap].append((config, times))

    for run in begun:
        put(*run)
    for k in np.argsort(-sizes, kind="stable").tolist():
        size, left = int(sizes[k]), int(counts[k])
        while left:
            at = bisect_left(gaps, size)
            gap, config, times = capacity, (), left
            if at < len(gaps):
                gap = gaps[at]
                config, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
            fits = gap // size
            full = min(times, left // fits)
            if full:
                put(gap - fits * size, (*config, (k, fits)), full)
                left -= full * fits
                times -= full
            if left and times:  # fewer are left than fit
                put(gap - left * size, (*config, (k, left)), 1)
                left = 0
                times -= 1
            if config and times:
                put(gap, config, times)
    for runs in open_.values():
        for config, times in runs:
            plan[config] += times
    return sorted(plan.items())


def _bundle(length: int, capacity: int) -> int:
    """How many pieces of one length are placed as one: many short ones, and those that rounding up would spoil."""
    if length < SMALL:
        return max(1, min(BUNDLE, capacity) // length)
    full = capacity // length
    return full if full * -(-length // UNIT) * UNIT > capacity else 1


class Plan:
    """Sequence and slot of every piece from its length and its rank among the pieces of that length."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        items: list[tuple[int, int]] = []  # size and number of single pieces and bundles
        self.single, self.bundled, self.per_bundle = {}, {}, {}
        for key, n in sorted(histogram.items()):
            k = _bundle(key, capacity)
            full = n // k if k > 1 else 0
            self.per_bundle[key] = (k, full)
            for kept, size, number in ((self.single, key, n - full * k), (self.bundled, k * key, full)):
                if number:
                    kept[key] = len(items)
                    items.append((size, number))
        sizes, counts = np.array(items, np.int64).reshape(-1, 2).T
        units = -(-sizes // UNIT)
        classes = np.unique(units)
        program = solve(classes, np.bincount(units, counts)[classes].astype(np.int64), capacity // UNIT) if items else []
        places = [(sorted((int(classes[c]) * UNIT for c, a in config for _ in range(a)), reverse=True), times) for config, times in program]
        begun, left = filled(sizes, counts, places, capacity)
        self.planned = sum(times for _, _, times in begun)
        rows: dict[int, list] = {i: [] for i in range(len(items))}
        at, base = Counter(), 0
        for config, times in best_fit(sizes, left, capacity, begun):
            slot = 0
            for i, a in config:
                rows[i].append((at[i], a, base, slot))
                at[i] += a * times
                slot += a
            base += times
        self.sequences = base
        self.rows = {i: np.array(r, np.int64).reshape(-1, 4) for i, r in rows.items()}

    def place(self, keys: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        order = np.argsort(keys, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1) if len(keys) else ():
            key = keys[own[0]]
            k, full = self.per_bundle[int(key)]
            r = ranks[own]
            packed = r < full * k
            for mine, table in ((own[packed], self.bundled), (own[~packed], self.single)):
                if len(mine):
                    rank = ranks[mine] // k if table is self.bundled else ranks[mine] - full * k
                    rows = self.rows[table[int(key)]]
                    row = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
                    step = rank - row[:, 0]
                    sequence[mine] = row[:, 2] + step // row[:, 1]
                    slot[mine] = (row[:, 3] + step % row[:, 1]) * BUNDLE + (ranks[mine] % k if table is self.bundled else 0)
        return sequence, slot


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`cut` (doc_id, piece, length, any more) with sequence_id and offset; the capacity is a multiple of UNIT."""
    if capacity % UNIT:
        raise ValueError(f"the capacity must be a multiple of {UNIT}")
    length = F.col("length")
    rows = written(cut.withColumn("_key", length.cast("long")))
    histogram = {r["_key"]: r["n"] for r in rows.groupBy("_key").agg(F.count("*").alias("n")).collect()}
    plan = Plan(histogram, capacity)

    @F.pandas_udf("sequence_id long, slot long")
    def placed(keys: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        sequence, slot = plan.place(keys.to_numpy(), ranks.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    ranked = running(rows, ["_key"], [F.col("doc_id"), F.col("piece")], F.struct("doc_id", "piece"), F.lit(1), "_rank")
    there = ranked.withColumn("_at", placed("_key", "_rank"))
    order = W.partitionBy("_at.sequence_id").orderBy("_at.slot").rowsBetween(W.unboundedPreceding, 0)
    return there.select(*cut.columns, F.col("_at.sequence_id").alias("sequence_id"),
                        (F.sum("length").over(order) - length).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that carry `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"))
