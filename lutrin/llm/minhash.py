"""MinHash near-duplicates by a multi-index Hamming join over b-bit signatures.

A signature holds 64 MinHash values cut to 16 bits. The positions are split into chunks, and the radius is twice their
number less one: by the pigeonhole principle two signatures within the radius differ in at most one position of some
chunk. There are as many chunks as it takes that texts right at the threshold differ in more positions than the radius with
a chance of at most MISSED, one in a million: 13 chunks and radius 25 at similarity 0.85 (6.3e-7), 16 and 31 at 0.8 (8.2e-8; 15 and
29 would give 1.2e-6). Every
signature is therefore entered under each chunk with each of its positions left out (64 keys); equal keys
give all pairs within the radius. Pairs are confirmed on the full shingle sets.

Texts with equal sets are one class first. Buckets with the same members count once. In a bucket, members are
compared with its smallest one, the lead. A lead has at most 64 buckets, and what they hold becomes one crowd with every member once;
only members farther from the lead than the radius are compared with all others of the crowd, in blocks. That gives the
clusters of the signature graph. In a cluster the full sets are compared with the set of its smallest member, and
only members without that link with all others, again in blocks. A block returns a spanning forest of its links,
so a large group of copies gives rows in proportion to its size, and every link counts.

Null, empty and blank texts have no shingles and no links. Rows with a null doc_id have no links either,
and component_id is null there. Rows that share a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lutrin.llm.common import U64, byte_batches, components, encoded, forest, grams, long_rows, mixed, odd_numbers, release_memory, word_hashes, written

VALUES = 64
MISSED = 1e-6
WORDS = 3
SHARE = 85
BLOCK = 512
BLOCK_BYTES = 16 << 20
PRINTS = "_id long, n_shingles long, f1 long, f2 long, signature binary"


def missed(share: int, radius: int) -> float:
    """The chance that signatures of texts with a similarity of `share` percent differ in more positions than the radius."""
    p = share / 100
    return sum(comb(VALUES, n) * (1 - p)**n * p**(VALUES - n) for n in range(radius + 1, VALUES + 1))


def chunks_for(share: int) -> int:
    """The smallest number of chunks whose radius misses at most MISSED of the pairs at the threshold."""
    return next(n for n in range(1, VALUES + 1) if missed(share, 2 * n - 1) <= MISSED)


CHUNKS = chunks_for(SHARE)
RADIUS = 2 * CHUNKS - 1


def shingles(h: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; of fewer words, the whole sequence."""
    return np.unique(grams(h, min(words, max(len(h), 1)), 41))


def _sets(texts: pd.Series, words: int) -> Iterator[np.ndarray]:
    for batch in byte_batches(encoded(texts)):
        h, counts = word_hashes(batch, fold=True)
        for part in np.split(h, np.cumsum(counts)[:-1]):
            yield shingles(part, words)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The 16-bit MinHash values of every set, one row each; zeros for an empty set."""
    out = np.zeros((len(sets), VALUES), np.uint16)
    full = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    if len(full):
        joined = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        with np.errstate(over="ignore"):
            for k, factor in enumerate(odd_numbers(VALUES, 53)):
                out[full, k] = (mixed(np.minimum.reduceat(joined * factor, at)) >> U64(48)).astype(np.uint16)
    return out


def _prints(words: int):
    def made(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for rows in byte_batches(range(len(pdf)), lambda i: len(pdf["text"].iloc[i] or ""), 1 << 20):
                part = pdf.iloc[rows]
                sets = list(_sets(part["text"], words))
                with np.errstate(over="ignore"):
                    f1 = [int(np.add.reduce(mixed(s)).astype(np.int64)) for s in sets]
                    f2 = [int(np.add.reduce(mixed(s ^ U64(0x5851F42D4C957F2D))).astype(np.int64)) for s in sets]
                yield pd.DataFrame({"_id": part["_id"].to_numpy(), "n_shingles": [len(s) for s in sets], "f1": f1, "f2": f2,
                                    "signature": [x.tobytes() for x in _signatures(sets)]})
        release_memory()
    return made


def _keys(signatures: pd.Series, chunks: int = CHUNKS) -> np.ndarray:
    """Keys of every signature: for each chunk, its values with one position left out."""
    s = np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, VALUES).astype(U64)
    factors, out = odd_numbers(VALUES, 67), []
    with np.errstate(over="ignore"):
        terms = mixed((s + U64(1)) * factors + factors)
        for chunk in np.split(np.arange(VALUES), [i * VALUES // chunks for i in range(1, chunks)]):
            total = terms[:, chunk].sum(axis=1, dtype=U64)
            out.extend(mixed(total - terms[:, p] + factors[p]) for p in chunk)
    return np.column_stack(out).astype(np.int64)


def _keys_of(chunks: int):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(signature: pd.Series) -> pd.Series:
        return pd.Series(list(_keys(signature, chunks)))
    return keys


@F.pandas_udf(T.IntegerType())
def _apart(a: pd.Series, b: pd.Series) -> pd.Series:
    x = np.frombuffer(b"".join(a), np.uint16).reshape(-1, VALUES)
    y = np.frombuffer(b"".join(b), np.uint16).reshape(-1, VALUES)
    return pd.Series((x != y).sum(axis=1).astype(np.int32))


def _alike(share: int):
    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(100 * both >= share * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)
    return alike


def _sets_of(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([s.tobytes() for s in _sets(texts, words)], dtype=object)

    return written(docs.join(ids, docs["_id"] == ids["rep"], "left_semi").select("_id", packed("text").alias("set")))


def _dealt(rows: DataFrame, group: str, asking: Column, size: Column, single: Column | None = None) -> DataFrame:
    """Rows of every group dealt to blocks (m, q): each asking row meets every row of its group exactly once.

    Groups without an asking row are left out, but for `single` rows: their groups are known to be one block and are not looked up.
    """
    parts = lambda count, total: F.greatest(F.ceil(count / BLOCK), F.ceil(total / BLOCK_BYTES)).cast("int")
    ask, many = asking.cast("int"), rows if single is None else rows.filter(~single)
    crowd = many.groupBy(group).agg(parts(F.count("*"), F.sum(size)).alias("ms"), parts(F.sum(ask), F.sum(size * ask)).alias("qs")).filter("qs > 0")
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    place = lambda m, q, asks: F.struct(m.alias("m"), q.alias("q"), F.lit(asks).alias("asks"))
    every = lambda n, use: F.transform(F.sequence(F.lit(0), F.col(n) - 1), use)
    members = every("qs", lambda q: place(own("ms"), q, False))
    asked = every("ms", lambda m: place(m, own("qs"), True))
    both = many.join(crowd, group)
    if single is not None:
        both = both.unionByName(rows.filter(single).withColumns({"ms": F.lit(1), "qs": F.lit(1)}))
    dealt = both.withColumn("_place", F.explode(F.when(asking, F.concat(members, asked)).otherwise(members)))
    return dealt.select(*rows.columns, "_place.m", "_place.q", "_place.asks")


def _linked_blocks(links):
    """Spanning forest (a, b) of the links of a block; `links` gives the matrix for asking rows and members."""
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        asking, members = pdf[pdf["asks"].to_numpy()], pdf[~pdf["asks"].to_numpy()]
        if not len(asking):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        i, j = asking["rep"].to_numpy(), members["rep"].to_numpy()
        a, b = forest(links(asking, members) & (i[:, None] != j[None, :]), i, j)
        return pd.DataFrame({"a": a, "b": b})
    return found


def _close(radius: int):
    def close(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        s, t = (np.frombuffer(b"".join(z["signature"]), np.uint16).reshape(-1, VALUES) for z in (x, y))
        apart = np.zeros((len(s), len(t)), np.uint8)
        for k in range(VALUES):
            apart += s[:, k:k + 1] != t[None, :, k]
        return apart <= radius
    return close


def _share_enough(share: int, columns: int = 2048):
    def enough(x: pd.DataFrame, y: pd.DataFrame) -> np.ndarray:
        p, q = ([np.frombuffer(b, np.uint64) for b in z["set"]] for z in (x, y))
        size_p, size_q = (np.array([len(z) for z in s], np.int64) for s in (p, q))
        p_all, q_all = (np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (p, q))
        common = np.intersect1d(p_all, q_all)
        both = np.zeros((len(p), len(q)), np.int64)
        placed = []
        for values, sizes in ((p_all, size_p), (q_all, size_q)):
            at = np.searchsorted(common, values)
            kept = at < len(common)
            kept[kept] = common[at[kept]] == values[kept]
            owner = np.repeat(np.arange(len(sizes)), sizes)[kept]
            order = np.argsort(at[kept], kind="stable")
            placed.append((at[kept][order], owner[order]))
        for low in range(0, len(common), columns):
            parts = []
            for (at, owner), n in zip(placed, (len(p), len(q)), strict=True):
                a, b = np.searchsorted(at, [low, low + columns])
                part = np.zeros((n, columns), np.float32)
                part[owner[a:b], at[a:b] - low] = 1
                parts.append(part)
            both += (parts[0] @ parts[1].T).astype(np.int64)
        return 100 * both >= share * (size_p[:, None] + size_q[None, :] - both)
    return enough


def _crowded(signatures: DataFrame, chunks: int) -> DataFrame:
    """Pairs (a, b, most) of the smallest member of every bucket, its lead, with each of the others; every pair once.

    `most` is at least the number of members of all buckets of the lead; zero if the pair alone shares its bucket.
    """
    keys = signatures.select("rep", F.explode(_keys_of(chunks)("signature")).alias("key"))
    met = (keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), F.max("rep").alias("last"),
                                   F.bit_xor(F.xxhash64("rep")).alias("members")).filter("n > 1")
           .groupBy("n", "lead", "last", "members").agg(F.min("key").alias("key")))
    met = written(met)
    crowds = met.filter("n > 2").select("key", "lead", F.sum("n").over(W.partitionBy("lead")).alias("most"))
    # merged at every size: a hot key is then split by the skew handling of the join
    rows = keys.join(crowds.hint("merge"), "key").filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"), "most")
    couples = met.filter("n = 2").select(F.col("lead").alias("a"), F.col("last").alias("b"), F.lit(0).cast("long").alias("most"))
    return rows.unionByName(couples).groupBy("a", "b").agg(F.max("most").alias("most"))


def _clusters(signatures: DataFrame, radius: int) -> DataFrame:
    """(rep, center): components of the graph of signatures within the radius, for all that have a neighbour."""
    a, b = (signatures.select(F.col("rep").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    stars = _crowded(signatures, radius // 2 + 1).join(a, "a").join(b, "b")
    measured = written(stars.select("a", "b", "most", (_apart("sa", "sb") > radius).alias("far"), F.col("sb").alias("signature")))
    close = measured.filter("not far").select("a", "b")
    crowds = measured.filter("most > 0").select(F.col("a").alias("lead"), F.col("b").alias("rep"), "most", "far", "signature")
    blocks = _dealt(crowds, "lead", F.col("far"), F.lit(2 * VALUES), single=F.col("most") <= BLOCK)
    more = blocks.groupBy("lead", "m", "q").applyInPandas(_linked_blocks(_close(radius)), "a long, b long")
    return written(components(close.unionByName(more)).select(F.col("id").alias("rep"), F.col("component").alias("center")))


def _confirmed(clusters: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that connect what the links on full sets connect."""
    center = sets.select(F.col("_id").alias("center"), F.col("set").alias("center_set"))
    own = clusters.join(sets.withColumnRenamed("_id", "rep"), "rep").join(center, "center")
    tested = written(own.select("rep", "center", _alike(share)("set", "center_set").alias("linked")))
    stars = tested.filter("linked and rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b"))
    left = tested.filter("not linked").select("center").distinct()
    full = tested.join(left, "center", "left_semi").join(sets.withColumnRenamed("_id", "rep"), "rep")
    blocks = _dealt(full, "center", ~F.col("linked"), F.octet_length("set"))
    more = blocks.groupBy("center", "m", "q").applyInPandas(_linked_blocks(_share_enough(share)), "a long, b long")
    return stars.unionByName(more)


def near_duplicates(docs: DataFrame, words: int = WORDS, share: int = SHARE, radius: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, any more).

    Links are pairs with 100 * |intersection| >= share * |union| of their shingle sets. Without a radius it follows from the share.
    """
    radius = 2 * chunks_for(share) - 1 if radius is None else radius
    texts = long_rows(docs).select(F.col("doc_id").cast("long").alias("_id"), "text")
    prints = written(texts.mapInPandas(_prints(words), PRINTS))
    known = prints.filter("_id is not null and n_shingles > 0")
    alike = ["n_shingles", "f1", "f2"]
    classes = written(known.groupBy(*alike).agg(F.min("_id").alias("rep")))
    signatures = written(known.join(classes, alike).filter("_id = rep").select("rep", "signature").distinct())

    clusters = _clusters(signatures, radius)
    final = components(_confirmed(clusters, _sets_of(texts, clusters, words), share))

    member = known.join(classes, alike).select("_id", "rep")
    groups = member.join(final, member["rep"] == final["id"], "left").groupBy("_id").agg(
        F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = prints.select("_id", "n_shingles").join(groups, "_id", "left")
    component = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rows whose document links to one with a smaller doc_id, however many links away."""
    gone = near_duplicates(docs, **settings).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
