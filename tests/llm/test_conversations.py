"""The prefix trie against a brute force over all prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lutrin.llm import conversations as C
from lutrin.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key int"


def brute(rows):
    """Nodes of (conv_id, turn, role, text) rows whose heads were exchanged."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    whole = {c: tuple(own.get(c - c % 20, [])[:heads[c]] + own[c][heads[c]:]) for c in own}
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for prefix in members:
        if prefix:
            kids[prefix[:-1]] += 1
    for prefix, of in members.items():
        more = (len(of) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1])) if prefix else 0
        for d in range(len(prefix) + 1):
            saved[prefix[:d]] += more
            leaves[prefix[:d]] += not kids[prefix]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if whole[c] == p)
    return sorted((min(of), len(p), min(members[p[:-1]]) if p else -1, len(of), kids[p], leaves[p], saved[p],
                   hashlib.sha256(ends(p).encode()).hexdigest()) for p, of in members.items())


def nodes(df):
    got = C.prefix_trie(C.with_heads(C.sequences(df)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_whole_table_equals_brute_force(spark, folder):
    df = table(spark, folder, "conversations")
    assert nodes(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("parts", ["3", "200"])
def test_copies_over_many_partitions_and_rounds(spark, parts):
    """A third of all conversations is one text, others share starts of all lengths; 200 partitions take two merging rounds."""
    rng = random.Random(7)
    rows = []
    for c in range(900):
        texts = ["hello there", "fine thanks", "bye"] if c % 3 == 0 else [f"t{rng.randrange(3)} word" for _ in range(rng.randrange(0, 9))]
        rows += [(c * 7, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(texts)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert nodes(made(spark, rows)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_ties_long_and_odd_rows(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, "a b"), (0, 2, "user", None), (1, 0, "x", ""), (1, 1, "", "x"), (None, 0, "user", "nobody"),
            (2, 0, "user", "a"), (2, 0, "user", "a"), (40, 5, "user", "w " * 100_000), (41, 5, "user", "w " * 100_000), (41, 6, "user", "z"),
            (-3, 0, "user", "below zero"), (-20, 0, "user", "giver"), (-(2**63), 0, "user", "least"), (2**63 - 1, 0, "user", "most"),
            *[(60, i, "user", "long") for i in range(150)], *[(61, i, "user", "long" if i < 120 else "other") for i in range(150)]]
    assert nodes(made(spark, rows)) == brute(rows)


def test_empty_table_and_table_without_ids(spark):
    assert nodes(made(spark, [])) == []
    assert nodes(made(spark, [(None, 0, "user", "a")])) == []


def test_shared_depth():
    a, b = bytes(16) * 5, bytes(16) * 3 + b"x" * 32
    assert [C.shared_depth(a, b), C.shared_depth(a, a[:32]), C.shared_depth(b"", a), C.shared_depth(b[48:], a)] == [3, 2, 0, 0]
