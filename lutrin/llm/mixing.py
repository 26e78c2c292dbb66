"""Mixing sources to target weights by blocks, multinomial shard counts and index permutations.

The words of a source form one stream, cut into blocks of fixed length. For every output shard the number of slots
of each source is drawn from a multinomial over what the sources still owe, so the sums meet the targets. The
n-th slot of a source, over all shards, names block permutation(n) of the source; each pass over the source has
its own pseudorandom permutation (swap-or-not rounds, which need no table), and blocks are joined by index. The last slot of
a source takes only the words that are still due.

One row per source (its size, weight and counts) is held by the driver, as a mix names its sources. Null is a source of its
own, last in order. Null, empty and blank texts have no words and are in no block. Rows that share a doc_id are
mixed one by one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lutrin.llm.common import U64, long_rows, mixed, running, written

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARDS = 64
MOST_REPEATS = 3
ROUNDS = 24
RANGE = 4096
SEED = 20


def words_in(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Words per source: shares of the total by weight, none above `most` times its size, the excess reshared."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        for i in over or open_:
            out[i] = float(most * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 by swap-or-not rounds (Hoang, Morris, Rogaway, 2012)."""
    x = index.astype(U64)
    n, key = n.astype(U64), key.astype(U64)
    with np.errstate(over="ignore"):
        for r in range(ROUNDS)[::-1 if back else 1]:
            turn = mixed(key * U64(0x9E3779B97F4A7C15) + U64(r + 1))
            other = (turn % n + n - x) % n
            coin = mixed(turn ^ (np.maximum(x, other) * U64(0xD6E8FEB86659FD93) + U64(r)))
            x = np.where(coin >> U64(63) == 1, other, x)
    return x.astype(np.int64)


class Source:
    """Slots of one source: passes over its permuted blocks until the target is met."""

    def __init__(self, number: int, size: int, target: float, block: int):
        self.number, self.size, self.block = number, size, block
        self.blocks = -(-size // block)
        self.short = size - (self.blocks - 1) * block
        due = min(round(target), MOST_REPEATS * size)
        self.passes, self.rest = divmod(due, size) if size else (0, 0)
        self.slots = self.passes * self.blocks + self._rest_slots()

    def key(self, epoch) -> np.ndarray:
        return np.asarray(epoch, np.int64) * 1_000_003 + self.number * 7919 + SEED

    def _rest_slots(self) -> int:
        if not self.rest:
            return 0
        one = np.array([self.blocks], np.int64)
        self.early = int(permuted(one - 1, one, self.key([self.passes]), back=True)[0])
        n = -(-self.rest // self.block)
        return n if n <= self.early else -(-(self.rest + self.block - self.short) // self.block)

    def at(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words taken of every slot."""
        epoch, place = slot // self.blocks, slot % self.blocks
        index = permuted(place, np.full(len(slot), self.blocks), self.key(epoch))
        words = np.where(index == self.blocks - 1, self.short, self.block)
        if self.rest:
            before = place * self.block - np.where(place > self.early, self.block - self.short, 0)
            words = np.where(epoch == self.passes, np.minimum(words, self.rest - before), words)
        return epoch, index, words


def shard_counts(slots: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Slots per shard (rows) and source (columns): multinomial draws from what is still owed."""
    rng, owed = np.random.default_rng(seed), np.array(slots, np.int64)
    out = np.zeros((shards, len(slots)), np.int64)
    for i in range(shards):
        need = int(owed.sum()) // (shards - i)
        while need:
            drawn = np.minimum(rng.multinomial(need, owed / owed.sum()), owed)
            out[i] += drawn
            owed -= drawn
            need -= int(drawn.sum())
    return out


def mix(docs: DataFrame, weight: Callable[[int], float] = lambda i: 1.0 + i % 3, block_words: int = BLOCK_WORDS,
        shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source, any more).

    First every row of docs as struct `row`, with `_row`, `size`, `source_size` and `target`; then the taken parts of rows
    (_row, shard, slot, epoch, start, words): words `start` to `start + words` of the row's text. `weight` gives the
    weight of the i-th source in code point order.
    """
    spark = docs.sparkSession
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = written(whole.select("row", words_in(F.col("row.text")).alias("size"), F.monotonically_increasing_id().alias("_row")))
    found = rows.groupBy("row.source").agg(F.sum("size").alias("n")).collect()
    found = sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["n"] for r in found], [weight(i) for i in range(len(found))])
    sources = [Source(i, r["n"], t, block_words) for i, (r, t) in enumerate(zip(found, goal, strict=True))]
    about = spark.createDataFrame([(r["source"], i, r["n"], t) for i, (r, t) in enumerate(zip(found, goal, strict=True))],
                                  "source string, _source int, source_size long, target double")
    with_source = rows.join(F.broadcast(about), F.col("row.source").eqNullSafe(about["source"])).drop(about["source"])

    ends = np.cumsum(shard_counts([s.slots for s in sources], shards), axis=0)
    ranges = [(s, i, int(ends[i - 1, s]) if i else 0, int(ends[i, s])) for i in range(shards) for s in range(len(sources))]
    spans = spark.createDataFrame([r for r in ranges if r[2] < r[3]], "_source int, shard int, low long, high long")

    def slotted(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples():
                slot = np.arange(r.low, r.high)
                epoch, index, words = sources[r._1].at(slot)
                yield pd.DataFrame({"_source": r._1, "_block": index, "shard": r.shard, "slot": slot, "epoch": epoch, "due": words})

    chunks = spans.select("_source", "shard", F.explode(F.expr(f"sequence(low, high - 1, {RANGE})")).alias("low"), "high")
    slots = (chunks.withColumn("high", F.least("high", F.col("low") + RANGE)).withColumnRenamed("_source", "_1")
             .repartition("_1", "low").mapInPandas(slotted, "_source int, _block long, shard int, slot long, epoch long, due long"))

    narrow = written(with_source.filter("size > 0").select("_source", "row.doc_id", "_row", "size"))
    placed = running(narrow, ["_source"], [F.col("doc_id"), F.col("size"), F.col("_row")], F.col("doc_id"), F.col("size"), "_at")
    blocks = placed.select("_source", "_row", "size", "_at", F.explode(F.sequence(
        F.floor(F.col("_at") / block_words), F.floor((F.col("_at") + F.col("size") - 1) / block_words))).alias("_block"))
    low = F.greatest(F.col("_block") * block_words, F.col("_at"))
    high = F.least((F.col("_block") + 1) * block_words, F.col("_at") + F.col("size"))
    parts = blocks.select("_source", "_block", "_row", (low - F.col("_at")).alias("start"), (low % block_words).alias("into"),
                          (high - low).alias("held"))
    # both sides grow with the words, whatever the planner guesses behind a Python step: never broadcast
    taken = slots.hint("merge").join(parts, ["_source", "_block"]).withColumn("words", F.least("held", F.col("due") - F.col("into")))
    return with_source.drop("_source"), taken.filter("words > 0").select("_row", "shard", "slot", "epoch", "start", "words")


def mixed_texts(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: one row per document and pass, holding the words taken in that pass.

    A text taken whole stays as it is; else its taken words are joined by one space, in the order of the text. Rows without
    words stay.
    """
    rows, taken = mix(long_rows(docs), **settings)

    @F.pandas_udf("string")
    def gathered(texts: pd.Series, parts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for text, spans, size in zip(texts, parts, sizes, strict=True):
            if spans is None or sum(p["words"] for p in spans) == size:
                out.append(text)
            else:
                words = text.encode("utf-8", "surrogatepass").split()
                kept = [w for p in sorted(spans, key=lambda p: p["start"]) for w in words[p["start"]:p["start"] + p["words"]]]
                out.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    passes = taken.groupBy("_row", "epoch").agg(F.collect_list(F.struct("start", "words")).alias("_parts"))
    out = rows.join(passes, "_row", "left").filter(F.col("_parts").isNotNull() | (F.col("size") == 0))
    out = out.select("row", gathered("row.text", "_parts", "size").alias("_text"))
    new = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])
