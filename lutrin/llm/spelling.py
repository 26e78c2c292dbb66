"""Spelling variants by a trie over letter-group counts.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, so one byte of Latin-1 stands for a code point. Every word has a
frequency vector: its length, then how often it has each of GROUPS groups of letters. The trie arranges the words by these counts, level by level. Of
two words that differ by one inserted, deleted or replaced code point, the vectors differ by at most one surplus and one deficit, so a depth-first
search that may spend one of each meets every near word in a leaf, where the spelling itself is verified.

The trie is spread over Spark by its first levels: a word is stored in the subtree (cell) of its own counts, and as a query visits those cells its budget
reaches. Every pair is looked for from one side only (the surplus comes before the deficit, the longer word is found by the shorter), so it is found
once. The number of levels above the cells grows with the vocabulary, and cells that are large all the same are dealt to blocks. Blocks return sums per
word, never their pairs. Word counts are summed in the tasks before they are shuffled.

Defined results: a null text has no words; a null doc_id counts as an empty id; repeated rows count again; a text without letters and an empty table
give nothing. Each row of `variants` is one word; n_near is 0, form and form_n are null and root is the word itself where nothing is near.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.llm.common import release_memory, written

SHORTEST = 5
LEAST = 3
TIMES = 2  # a form occurs at least so many times as often as the word
GROUPS = 16
ALONE = 10  # the most frequent letters, each a group of its own
HELD = 200_000  # words a task sums before it hands them on
SEGMENT = 1 << 22
PER_CELL = 50_000
BLOCK = 20_000
AT_ONCE = 2048  # (query, word) pairs of a subtree small enough to be compared without going deeper
WIDE = 48  # words above are verified one by one

LETTERS = np.zeros(256, np.uint8)
LETTERS[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = 1
RUNS = bytes(32 if not LETTERS[c] else c + 32 if c < 91 else c for c in range(256))  # all else a blank, A-Z lower-cased


def _segments(raw: bytes) -> Iterator[bytes]:
    """Pieces of about SEGMENT bytes that end between runs."""
    start = 0
    while len(raw) - start > SEGMENT:
        end = raw.find(b" ", start + SEGMENT)
        if end < 0:
            break
        yield raw[start:end]
        start = end
    yield raw[start:]


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def slipped(run: bytes, start: int, every: int) -> bytes:
    """The run without one code point where `every` divides h, the CRC-32 that goes on from `start` over the run; it is code point h % length."""
    h = zlib.crc32(_utf8(run), start)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(documents: DataFrame, slip_every: int | None = None, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(word, n): words of all texts with at least `shortest` code points and `least` occurrences.

    With `slip_every` a letter is left out of every run for which that number divides the CRC-32 of "<doc_id>:<run>".
    """
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(total: dict) -> pa.RecordBatch:
            kept = [(w, n) for w, n in total.items() if len(w) >= shortest]
            return pa.RecordBatch.from_pydict({"word": [w.decode("latin-1") for w, _ in kept], "n": [n for _, n in kept]},
                                              schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        total: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                doc_id = doc_id.as_py()
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for piece in _segments(text.as_py().encode("latin-1", "replace").translate(RUNS)):
                    found = Counter(piece.split())
                    if slip_every:
                        for run, n in found.items():
                            if zlib.crc32(run if run.isascii() else _utf8(run), start) % slip_every == 0:
                                run = slipped(run, start, slip_every)
                            total[run] = total.get(run, 0) + n
                    else:
                        for run, n in found.items():
                            total[run] = total.get(run, 0) + n
                    if len(total) > HELD:
                        yield rows(total)
                        total.clear()
        yield rows(total)
        total.clear()
        release_memory()

    texts = documents.select("doc_id", "text")
    parts = texts.mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group (1 to GROUPS) of every Latin-1 byte, by how often the words have each letter: the most frequent alone, the others dealt in turn."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, _ = _packed([w.encode("latin-1") for w in batch.column(0).to_pylist()])
            found = np.bincount(raw, minlength=256)
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["letter", "n"])

    rows = words.select("word").mapInArrow(counted, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # at most 256
    groups = np.full(256, GROUPS, np.int64)
    for i, row in enumerate(sorted(rows, key=lambda r: (-r["n"], r["letter"]))):
        groups[row["letter"]] = 1 + (i if i < ALONE else ALONE + (i - ALONE) % (GROUPS - ALONE))
    return groups


def vectors(words: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Length and group counts of every word."""
    raw, sizes = _packed(words)
    of = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(of * (GROUPS + 1) + groups[raw], minlength=len(words) * (GROUPS + 1)).reshape(len(words), GROUPS + 1)
    counts[:, 0] = sizes
    return counts.astype(np.int32)


def _cells(head: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of first-level counts; two cells that share a number share a block, nothing else."""
    out = np.zeros(len(head), np.uint64)
    with np.errstate(over="ignore"):
        for column in head.T:
            out = (out ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _steps(levels: int) -> np.ndarray:
    """What may be added to the first counts of a query: nothing, a surplus, a surplus before a deficit; the same for longer words without the deficit."""
    eye = np.eye(levels + 1, dtype=np.int32)
    same = [0 * eye[0], *(eye[i] for i in range(1, levels + 1)),
            *(eye[i] - eye[j] for i in range(1, levels + 1) for j in range(i + 1, levels + 1))]
    longer = [eye[0], *(eye[0] + eye[i] for i in range(1, levels + 1))]
    return np.array(same + longer)


SAME, SPENT, BOTH, LONGER, LONGER_SPENT = range(5)


def descend(trie: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) numbers of leaves that a depth-first search within the budget reaches.

    `trie` holds the members' vectors in sorted order, so a subtree is a range of rows; a batch of queries goes down
    together, each with what it has spent.
    """
    stack = [(0, 0, len(trie), np.arange(len(queries)), np.zeros(len(queries), np.int8))]
    while stack:
        level, low, high, q, spent = stack.pop()
        if level == trie.shape[1]:
            yield np.repeat(q, high - low), np.tile(np.arange(low, high), len(q))
            continue
        if level and (high - low) * len(q) <= AT_ONCE:
            delta = trie[None, low:high, level:] - queries[q, None, level:]
            plus, minus = (delta == 1).sum(2), (delta == -1).sum(2)
            state = spent[:, None]
            before = (delta == 1).argmax(2) < (delta == -1).argmax(2)
            fits = np.where(state == SAME, (plus == minus) & (plus <= 1) & (before | (plus == 0)),
                            np.where(state == SPENT, (plus == 0) & (minus == 1), np.where(state == LONGER, (plus == 1) & (minus == 0), plus + minus == 0)))
            fits &= (np.abs(delta).sum(2) == plus + minus)
            a, b = np.nonzero(fits)
            if len(a):
                yield q[a], b + low
            continue
        column = trie[low:high, level]
        starts = np.concatenate(([0], np.flatnonzero(np.diff(column)) + 1, [high - low]))
        counts = queries[q, level]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            delta = column[a] - counts
            zero, plus, minus = delta == 0, delta == 1, delta == -1
            if level == 0:
                after, keep = np.where(plus, LONGER, SAME), zero | plus
            else:
                after = np.where(zero, spent, np.where(minus, BOTH, spent + 1))
                keep = zero | plus & ((spent == SAME) | (spent == LONGER)) | minus & (spent == SPENT)
            if keep.any():
                stack.append((level + 1, low + a, low + b, q[keep], after[keep].astype(np.int8)))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at:] == b[at + 1:] if len(a) < len(b) else a[at + 1:] == b[at + 1:]


class Spellings:
    """Words of a block as padded rows, to verify many pairs at once."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.width = int(min(WIDE, self.sizes.max(initial=1)))
        short = [w if len(w) <= self.width else b"" for w in words]
        self.left = np.frombuffer(b"".join(w.ljust(self.width, b"\0") for w in short), np.uint8).reshape(len(words), self.width)
        self.right = np.frombuffer(b"".join(w.rjust(self.width, b"\0") for w in short), np.uint8).reshape(len(words), self.width)[:, ::-1]

    def verified(self, other: Spellings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs (word i, word j of other), j at most one longer, are one apart."""
        width = min(self.width, other.width)
        near = np.zeros(len(i), bool)
        long = (self.sizes[i] > width) | (other.sizes[j] > width)
        for k in np.flatnonzero(long):
            near[k] = one_apart(self.words[i[k]], other.words[j[k]])
        k = np.flatnonzero(~long)
        a, b = i[k], j[k]
        first = self.left[a, :width] != other.left[b, :width]
        same = self.sizes[a] == other.sizes[b]
        near[k[same]] = first[same].sum(1) == 1
        k, a, b, first = k[~same], a[~same], b[~same], first[~same]
        last = self.right[a, :width] != other.right[b, :width]
        lead = np.where(first.any(1), first.argmax(1), width)
        near[k] = lead + np.where(last.any(1), last.argmax(1), width) >= self.sizes[a]
        return near


def _met(groups: np.ndarray):
    """What the words of one block are near to: how many, and the one with the largest n."""
    def met(block: pa.Table) -> pa.Table:
        member = block["member"].to_numpy()
        names, n = [w.encode("latin-1") for w in block["word"].to_pylist()], block["n"].to_numpy()
        here, seen = np.flatnonzero(member), np.flatnonzero(~member)
        levels = vectors(names, groups)
        here = here[np.lexsort(levels[here].T[::-1])]
        queries, members = Spellings([names[i] for i in seen]), Spellings([names[i] for i in here])
        code = {name: i for i, name in enumerate(sorted(set(names)))}
        order = np.fromiter((code[x] for x in names), np.int64, len(names))  # Latin-1 bytes sort as code points do
        near, best = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64)
        rank = np.empty(len(names), np.int64)  # of (n, smaller spelling first)
        rank[np.lexsort((-order, n))] = np.arange(len(names))

        def settle(q: list[np.ndarray], m: list[np.ndarray]) -> None:
            q, m = np.concatenate(q), np.concatenate(m)
            a, b = seen[q], here[m]
            once = (levels[a, 1:] != levels[b, 1:]).any(1) | (order[a] < order[b])  # equal vectors meet from both sides
            q, m = q[once], m[once]
            good = queries.verified(members, q, m)
            a, b = seen[q[good]], here[m[good]]
            for own, other in ((a, b), (b, a)):
                np.add.at(near, own, 1)
                np.maximum.at(best, own, rank[other])

        if len(here) and len(seen):
            q, m, held = [], [], 0
            for a, b in descend(levels[here], levels[seen]):
                q.append(a)
                m.append(b)
                held += len(a)
                if held > 1 << 18:
                    settle(q, m)
                    q, m, held = [], [], 0
            if q:
                settle(q, m)
        by_rank = np.argsort(rank)
        found = np.flatnonzero(near)
        top = by_rank[best[found]]
        text = block["word"]
        return pa.table({"word": text.take(pa.array(found)), "n_near": pa.array(near[found]), "other": text.take(pa.array(top)), "other_n": pa.array(n[top])})
    return met


def near_words(words: DataFrame, vocabulary: int) -> DataFrame:
    """(word, n_near, other, other_n) of the words (word, n) that have a near word; other is the one of largest n, then of smallest spelling."""
    groups = letter_groups(words)
    levels = int(min(GROUPS, max(1, math.ceil(math.log(max(1.0, vocabulary / PER_CELL), 4)) + 1)))
    steps = _steps(levels)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                if not part.num_rows:
                    continue
                head = vectors([w.encode("latin-1") for w in part.column("word").to_pylist()], groups)[:, :levels + 1]
                visits = np.sort(_cells((head[:, None, :] + steps[None]).reshape(-1, levels + 1)).reshape(len(head), len(steps)), axis=1)
                offsets = np.arange(0, visits.size + 1, len(steps), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("word"), part.column("n"), pa.array(_cells(head)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(visits.ravel()))],
                    names=["word", "n", "home", "visits"])

    rows = written(words.select("word", "n").mapInArrow(placed, "word string, n long, home long, visits array<long>"))
    homes = rows.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("ms"))
    visits = rows.select(F.explode(F.array_distinct("visits")).alias("cell"), "word", "n")
    crowd = written(homes.join(visits.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("qs")), "cell"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    members = rows.select(F.col("home").alias("cell"), "word", "n").join(crowd, "cell").withColumn("m", mine("ms")).withColumn("q", every("qs"))
    queries = visits.join(crowd, "cell").withColumn("q", mine("qs")).withColumn("m", every("ms"))
    columns = ["cell", "m", "q", "word", "n"]
    both = members.select(*columns, F.lit(True).alias("member")).unionByName(queries.select(*columns, F.lit(False).alias("member")))
    sums = both.groupBy("cell", "m", "q").applyInArrow(_met(groups), "word string, n_near long, other string, other_n long")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other")))
    return sums.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, by doubling the steps until none is left.

    A form occurs at least twice as often as its word, so chains are short and end.
    """
    at = written(forms.select("word", F.col("form").alias("root")))
    while True:
        more = at.alias("a").join(at.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        more = written(more)
        at = more.select("word", "root")
        if not more.filter("moved").limit(1).count():
            return at


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of words (word, n)."""
    words = written(words.select("word", "n"))
    near = near_words(words, words.count())
    joined = words.join(near, "word", "left")
    has = F.col("other_n") >= times * F.col("n")
    rows = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                 F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n")))
    roots = rooted(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "form", "root", "n", "n_near", "form_n")
