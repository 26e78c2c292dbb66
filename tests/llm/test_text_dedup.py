"""Near-duplicates and substring dedup against brute force, with nulls, repeated rows and long texts."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lutrin.llm import common, minhash, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute_near(rows, n=3, share=85):
    sets = {}
    for doc_id, text in rows:
        w = words(folded(text))
        runs = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        sets[doc_id] = runs
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
              and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    component = brute_components(sets, linked)
    return {d: (len(sets[d]), component[d], component[d] == d) for d in sets}


def brute_repeats(rows, width=20):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if key in seen:
                gone[i:i + width] = [True] * width
            seen.add(key)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed=1, n=90):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Éa", "ÉB", "ß", "x" * 300, "日本"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, line = text(60), text(9)
    rows = [(i, text(rng.randint(1, 120))) for i in range(n)]
    for i in range(n, n + 60):
        base = words(rows[rng.randrange(n)][1])
        for _ in range(rng.randint(0, 6)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, " ".join(base)))
    for i in range(n + 60, n + 80):
        rows.append((i, f"{text(30)}\n{passage}\t{line} {text(5)}"))
        rows.append((i + 1000, f"{line}\x0b{text(12)} {line}"))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "one"), (5004, "ONE"), (5005, "One two"), (5006, passage), (5007, passage.upper()),
             (5008, passage + " " + passage), (5009, "a " * 50), (5010, "a " * 25), (5011, text(30_000)), (5012, words(passage)[0]),
             (-3, passage[: len(passage) // 2])]
    return rows


def frame(spark, rows, extra=False):
    data = [(d, t, "s", 1, 2.0, "k") for d, t in rows]
    columns = "doc_id long, text string, source string, n long, size double, key string"
    df = spark.createDataFrame(data, columns).repartition(5)
    return df if extra else df.select("doc_id", "text")


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows, extra=True)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_with_other_settings(spark):
    rows = corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), words=5, share=80).collect()}
    assert got == brute_near(rows, 5, 80)


def test_pairs_at_a_lower_threshold_are_found_beyond_the_default_radius(spark):
    rows = []
    for i in (6624, 51164):  # signatures of these pairs differ in 27 positions
        common = " ".join(f"p{i}c{k}" for k in range(8))
        rows += [(i, f"{common} p{i}a"), (i + 1, f"{common} p{i}b")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows), words=1, share=80).collect()}
    assert got == brute_near(rows, 1, 80) and sum(kept for _, _, kept in got.values()) == 2


def test_radius_follows_from_the_threshold():
    assert (minhash.CHUNKS, minhash.RADIUS) == (13, 25)
    for share in (70, 80, 85, 90):
        chunks = minhash.chunks_for(share)
        assert minhash.missed(share, 2 * chunks - 1) <= minhash.MISSED < minhash.missed(share, 2 * chunks - 3)
        a = np.arange(minhash.VALUES, dtype=np.uint16)
        b = a.copy()
        b[np.random.default_rng(share).choice(minhash.VALUES, 2 * chunks - 1, replace=False)] ^= 256
        keys = minhash._keys([a.tobytes(), b.tobytes()], chunks)
        assert keys.shape == (2, minhash.VALUES) and set(keys[0]) & set(keys[1])


def test_large_group_of_near_copies_is_one_component_or_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_near_duplicates_of_nulls_repeated_rows_and_nothing(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (3, None), (3, "a b c d e f g h")]
    got = sorted(minhash.near_duplicates(frame(spark, rows)).collect(), key=str)
    assert [tuple(r) for r in got if r.doc_id in (1, 2)] == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert [tuple(r) for r in got if r.doc_id is None] == [(None, 2, None, True)]
    assert sorted(tuple(r) for r in got if r.doc_id == 3) == [(3, 0, 3, True), (3, 6, 3, True)]
    assert minhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []
    kept = minhash.without_near_duplicates(frame(spark, rows, extra=True))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3, 3]
    assert kept.columns == ["doc_id", "text", "source", "n", "size", "key"]


def test_signature_distance_join_misses_no_pair_within_the_radius():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, minhash.VALUES, dtype=np.uint16)
    for apart in (0, 1, 13, minhash.RADIUS):
        for _ in range(50):
            b = a.copy()
            at = rng.choice(minhash.VALUES, apart, replace=False)
            b[at] ^= 1
            keys = minhash._keys([a.tobytes(), b.tobytes()])
            assert set(keys[0]) & set(keys[1])


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = corpus(seed)
    marked = substrings.duplicate_words(frame(spark, rows, extra=True))
    got = {r.doc_id: (r.d.n_words, r.d.n_removed, r.d.kept_sha256) for r in
           marked.select("doc_id", substrings.kept_digest("text", "_lutrin_spans").alias("d")).collect()}
    assert got == brute_repeats(rows)


def test_substring_dedup_of_nulls_repeated_rows_and_nothing(spark):
    text = " ".join(f"q{i}" for i in range(25))
    rows = [(None, text), (7, text), (7, text), (7, text + " end"), (8, None), (9, "")]
    docs = frame(spark, rows, extra=True)
    got = sorted(((r.doc_id, r.d.n_words, r.d.n_removed) for r in substrings.duplicate_words(docs).select(
        "doc_id", substrings.kept_digest("text", "_lutrin_spans").alias("d")).collect()), key=str)
    assert got == sorted([(None, 25, 0), (7, 25, 25), (7, 25, 25), (7, 26, 25), (8, 0, 0), (9, 0, 0)], key=str)
    left = substrings.without_duplicates(docs)
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == [("7", "end"), ("8", ""), ("9", ""), ("None", text)]
    assert left.columns == docs.columns
    assert substrings.duplicate_words(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    links += [(5000, i) for i in range(5001, 5100)]
    ids = {x for e in links if e[0] != e[1] for x in e}
    got = {r.id: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == brute_components(ids, [e for e in links if e[0] != e[1]])
    assert collections.Counter(got.values())[5000] == 100


def test_word_hashes_agree_with_split():
    texts = [b"a b  a", b"", b" \x0b ", "é\u2003x é\u2003x".encode(), b"A a", b"w" * 10_000]
    h, counts = common.word_hashes(texts)
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert h[0] == h[2] != h[1] and h[3] == h[4]
    assert common.word_hashes([b"A a"], fold=True)[0].tolist() == [h[0]] * 2
    long = b" ".join(b"t%d" % (i % 7) for i in range(1_500_000))
    assert len(long) > 2 * common.BATCH_BYTES
    hashes, n = common.word_hashes([long, b"t1"])
    assert n.tolist() == [1_500_000, 1] and hashes[1] == hashes[8] == hashes[-1] and len(set(hashes.tolist())) == 7


def test_groups_are_dealt_with_one_lookup(spark, monkeypatch):
    """Every asking row meets its whole group once; groups of one block are not looked up, large ones once for members and askers."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = [(k, 100 * k + i, n, (i * k) % 3 == 1) for k, n in ((1, 3), (2, 4), (3, 9), (4, 23)) for i in range(n)]
    df = common.written(spark.createDataFrame(rows, "key long, rep long, n long, far boolean"))
    dealt = minhash._dealt(df, "key", F.col("far"), F.lit(1), single=F.col("n") <= 4)
    met = {}
    for r in dealt.collect():
        met.setdefault((r.key, r.m, r.q), ([], []))[r.asks].append(r.rep)
    pairs = sorted((a, b) for members, asking in met.values() for a in asking for b in members)
    assert pairs == sorted((a, b) for k, a, _, far in rows if far for k2, b, _, _ in rows if k == k2)
    assert all(max(map(len, block)) <= 12 for block in met.values())
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "(n#" in plan
    nobody = minhash._linked_blocks(None)(pd.DataFrame({"rep": [1], "asks": [False]}))
    assert list(nobody.columns) == ["a", "b"] and nobody.empty


def test_members_are_dealt_once_a_lead_not_once_a_bucket(spark, monkeypatch):
    """A near copy shares some 20 of its 64 buckets with the same lead; all far members still meet all others."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng, deal, dealt = np.random.default_rng(6), minhash._dealt, []
    base = rng.integers(0, 2**16, minhash.VALUES, dtype=np.uint16)

    def counted(rows, group, *args, **named):
        dealt.append((rows.count(), rows.select(group, "rep").distinct().count(), rows.select("rep").distinct().count()))
        return deal(rows, group, *args, **named)

    monkeypatch.setattr(minhash, "_dealt", counted)
    n = 100
    signatures = np.repeat(base[None, :], n, axis=0)
    for k, s in enumerate(signatures):
        s[rng.choice(minhash.VALUES, rng.integers(22, 30) if k % 5 == 4 else rng.integers(1, 9), replace=False)] ^= 1 + k
    apart = (signatures[:, None, :] != signatures[None, :, :]).sum(axis=2)
    linked = [(i, j) for i in range(n) for j in range(i) if apart[i, j] <= minhash.RADIUS]
    assert (apart[0] > minhash.RADIUS).sum() > n // 10
    df = common.written(spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(signatures)], "rep long, signature binary"))
    got = {r.rep: r.center for r in minhash._clusters(df, minhash.RADIUS).collect()}
    met = {i for pair in linked for i in pair}
    assert got == {i: c for i, c in brute_components(range(n), linked).items() if i in met}
    [(rows, pairs, members)] = dealt
    assert rows == pairs <= 8 * members
