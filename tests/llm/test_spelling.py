"""Spelling variants against a brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from lutrin.llm import spelling as S
from lutrin.llm.common import table
from lutrin.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, every=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def near(words):
    """All words one apart, by the words without one letter."""
    without, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            without.setdefault((w[:i], w[i + 1:]), set()).add(w)
    for (a, b), of in without.items():
        for w in of:
            out[w] |= of - {w}
            if a + b in out and a + b != w:
                out[w].add(a + b)
                out[a + b].add(w)
    return out


def brute(n):
    pairs, form, rows = near(n), {}, []
    for w, of in pairs.items():
        best = min(of, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(pairs[w]), n.get(form.get(w))))
    return sorted(rows, key=lambda r: r[0])


def got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def test_whole_table_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_spelling_variants"](spark, folder)) == brute(counts(rows))


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Colour colour color " * 3), (3, "COLOR Étude étude ÉTUDE ×÷×÷× " * 4),
            (3, "COLOR Étude étude ÉTUDE ×÷×÷× " * 4), (4, "漢字 abcdeĀfghij " * 3),
            (5, ("a" * 70 + " ") * 8 + ("a" * 69 + "b ") * 3 + ("a" * 71 + " ") * 3), (6, "x" * 5_000_000), (7, "colours " * 700_000)]
    docs = spark.createDataFrame([(*r, "z", 2) for r in rows], "doc_id long, text string, word string, n int")
    for every in (None, 97, 3):
        assert got(S.variants(S.word_counts(docs, every))) == brute(counts(rows, every))
    assert got(S.variants(S.word_counts(docs.limit(0)))) == []


def test_crowded_cells_and_many_levels(spark):
    """Words over three letters: few cells, long chains of forms, words near to hundreds of others."""
    rng = random.Random(3)
    n = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 9))): 3 + int(2 ** rng.uniform(0, 14)) for _ in range(4000)}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(S.variants(words)) == brute(n)
    near_rows = S.near_words(words, vocabulary=10**12).collect()  # all levels above the cells
    assert {r.word: r.n_near for r in near_rows} == {w: len(of) for w, of in near(n).items() if of}


def test_blocks_of_one_cell_add_up(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 40)
    rng = random.Random(5)
    n = {"".join(rng.choice("ab") for _ in range(11)): rng.randrange(3, 99) for _ in range(1200)}
    assert got(S.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == brute(n)


def test_search_reaches_every_near_word():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 7))).encode() for _ in range(1500)})
    groups = np.full(256, S.GROUPS, np.int64)
    groups[list(b"abcde")] = [1, 2, 3, 4, 1]
    levels = S.vectors(words, groups)
    order = np.lexsort(levels.T[::-1])
    met = set()
    for q, m in S.descend(levels[order], levels):
        met |= {(words[a], words[order[b]]) for a, b in zip(q.tolist(), m.tolist(), strict=True)}
    for a, of in near({w.decode("latin-1"): 1 for w in words}).items():
        for b in of:
            a_, b_ = a.encode(), b.encode()
            assert (a_, b_) in met or (b_, a_) in met
            assert S.one_apart(a_, b_)
