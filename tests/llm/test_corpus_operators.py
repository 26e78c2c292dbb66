"""Packing, mixing, fingerprints and toxicity: exact round trips, brute force and held-out accuracy."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lutrin.llm import fingerprints, mixing, packing, queries, toxicity

TEXTS = ["a\x0bb\x0cc\x85d\xa0e", "Foo'LL bar's x1y22", "x\x1cy <|endoftext|>z a<|startoftext|>", "İstanbul ΑΣ Σ", "e ́x e ́", "",
         "  \n ", "!!! ?a--b_c 'S 'Re 're", "ﬁ Ⅷ ½ ٣٤ 漢字かな 한국 𝒜𝒷 👍🏽", "a\u200bb\ufeffc  d e", "\x00\x01a\x7f", None]


@pytest.fixture(scope="module")
def tokenizer_path():
    return queries.public_tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids(tokenizer_path):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path)
    return lambda text: encoder.encode(text or "", add_special_tokens=False).ids


def test_cached_token_ids_equal_the_whole_encoder(tokenizer_path, ids, folder):
    import pyarrow.parquet as pq

    own = packing.WordTokenizer(tokenizer_path)
    for text in TEXTS + pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)


def test_packing_round_trip(spark, tokenizer_path, ids):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, "word " * 9000), (None, "null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, length long, piece string")
    cut = packing.pieces(docs, tokenizer_path, with_ids=True)
    packed = packing.pack(cut).collect()
    assert sorted(r.ids_crc32 for r in packed) == sorted(
        zlib.crc32(np.array((ids(t) + [1])[i:i + 4096], "<u4").tobytes()) for _, t in rows for i in range(0, len(ids(t)) + 1, 4096))
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(cut)).collect()}
    for r in packed:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == r.ids
    assert sum(len(x) for x in whole.values()) == sum(r.length for r in packed)
    assert max(len(x) for x in whole.values()) <= 4096
    assert packing.pack(packing.pieces(docs.limit(0), tokenizer_path)).collect() == []


@pytest.mark.parametrize("lengths, most", [([1365] * 300 + [819] * 51, 111), ([1] * 5000 + [4096] * 3 + [4095] * 2, 8), ([10] * 4000, 10), ([1], 1),
                                           ([2048] * 40 + [1024] * 40, 30)])
def test_configurations_hold_every_piece_once(lengths, most):
    key = lambda n: n if n < packing.SMALL or packing._bundle(n, 4096) > 1 else -(-n // packing.UNIT) * packing.UNIT
    keys = np.array([key(n) for n in lengths])
    seen, ranks = collections.Counter(), []
    for k in keys.tolist():
        ranks.append(seen[k])
        seen[k] += 1
    sequence, slot = packing.Plan(dict(seen), 4096).place(keys, np.array(ranks))
    assert len(set(zip(sequence.tolist(), slot.tolist(), strict=True))) == len(lengths)
    total = collections.Counter()
    for s, n in zip(sequence.tolist(), lengths, strict=True):
        total[s] += n
    assert max(total.values()) <= 4096 and len(total) <= most


def test_packing_is_near_the_lower_bound_on_mixed_lengths():
    lengths = np.random.default_rng(1).gamma(1.2, 900, 30_000).astype(int).clip(1, 4096)
    histogram = collections.Counter(packing.UNIT * -(-int(n) // packing.UNIT) for n in lengths)
    plan = packing.Plan(dict(histogram), 4096)
    assert plan.sequences <= 1.01 * sum(k * n for k, n in histogram.items()) / 4096


@pytest.mark.parametrize("mean", [60, 300, 900])
def test_the_program_gives_the_plan_and_needs_no_more_than_best_fit(mean):
    lengths = np.random.default_rng(5).gamma(1.2, mean / 1.2, 20_000).astype(int).clip(1, 4096)
    keys, counts = np.unique(lengths, return_counts=True)
    plan = packing.Plan(dict(zip(keys.tolist(), counts.tolist(), strict=True)), 4096)
    assert plan.planned > 0.7 * plan.sequences
    assert plan.sequences <= sum(times for _, times in packing.best_fit(keys, counts, 4096))


def test_places_take_exact_sizes_and_the_rest_goes_into_the_gaps():
    sizes, counts = np.array([3, 5, 6, 10]), np.array([4, 1, 2, 2])
    runs, left = packing.filled(sizes, counts, [([12, 8], 2)], 16)
    assert runs == [(0, ((2, 1), (3, 1)), 2)] and left.tolist() == [4, 1, 0, 0]
    assert packing.best_fit(sizes, left, 16, [(4, ((3, 1),), 1), *runs]) == sorted(
        [(((3, 1), (0, 1)), 1), (((2, 1), (3, 1)), 2), (((1, 1), (0, 3)), 1)])
    assert packing.filled(sizes, np.zeros(4, int), [([12, 8], 2)], 16)[0] == []


def test_tokens_of_words_that_come_again_after_many_others(tokenizer_path, ids, monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)
    own = packing.WordTokenizer(tokenizer_path)
    for text in ["one two three four five", "One's \u4e2d\u6587 x\u00a0y <|endoftext|> na\u00efve", "two 12 !? five", "", "a'll b're c've d'x"] * 3:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids(text)
        assert len(own.words) <= 3 and len(own.runs) <= 3


@pytest.mark.parametrize("mean", [300, 900])
def test_packing_is_near_the_lower_bound_of_the_real_lengths(mean):
    lengths = np.random.default_rng(2).gamma(1.2, mean / 1.2, 20_000).astype(int).clip(1, 4096)
    keys, counts = np.unique(lengths, return_counts=True)
    plan = packing.Plan(dict(zip(keys.tolist(), counts.tolist(), strict=True)), 4096)
    assert plan.sequences <= -(-int(lengths.sum()) // 4096) + 1
    ranks = np.concatenate([np.arange(n) for n in counts])
    sequence, slot = plan.place(np.repeat(keys, counts), ranks)
    assert len(set(zip(sequence.tolist(), slot.tolist(), strict=True))) == len(lengths)
    total = np.bincount(sequence, np.repeat(keys, counts), plan.sequences)
    assert 0 < total.min() and total.max() <= 4096


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 10], [1, 1]) == [10, 10]
    assert mixing.targets([1, 99, 0], [1, 1, 5]) == [3, 97, 0]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]
    assert mixing.targets([], []) == []
    out = mixing.targets([1, 2, 300], [3, 2, 1])
    assert out[0] == 3 and out[1] == 6 and abs(sum(out) - 303) < 1e-9


def test_permutation_is_one_to_one_and_turns_back():
    for n in (1, 2, 7, 1000):
        x = np.arange(n)
        y = mixing.permuted(x, np.full(n, n), np.full(n, 9))
        assert sorted(y) == x.tolist()
        assert (mixing.permuted(y, np.full(n, n), np.full(n, 9), back=True) == x).all()


def test_mix_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(int(rng.integers(0, 300)))), ["a", "B", None, "é", ""][int(rng.choice(5, p=[.6, .2, .1, .05, .05]))])
            for i in range(150)] + [(None, "null id here", "a"), (3, None, "B"), (4, "", "a"), (5, "same row", "B"), (5, "same row", "B")]
    docs = spark.createDataFrame([(*r, 1, "z", 5) for r in rows], "doc_id long, text string, source string, size long, target string, n_chars long")
    whole, taken = mixing.mix(docs)
    sums = taken.groupBy("_row").agg(F.sum("words").alias("taken"))
    out = whole.join(sums, "_row", "left").select("row.*", whole["size"].alias("words"), "source_size", whole["target"].alias("goal"), F.coalesce("taken", F.lit(0)).alias("taken")).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(list)
    for r in out:
        assert r.words == len((r.text or "").split()) and r.taken <= 3 * r.words
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sum(r.words for r in by[s]) for s in order], [1 + i % 3 for i in range(len(order))])
    for s, goal in zip(order, want, strict=True):
        assert {r.goal for r in by[s]} == {goal} and {r.source_size for r in by[s]} == {sum(r.words for r in by[s])}
        assert abs(sum(r.taken for r in by[s]) - goal) <= 0.5
    again = mixing.mixed_texts(docs)
    texts = again.collect()
    assert again.columns == docs.columns
    assert sorted(map(str, texts)) == sorted(map(str, mixing.mixed_texts(docs).collect()))
    count = collections.Counter(w for r in texts for w in (r.text or "").split() if w[0] == "d")
    assert sum(count.values()) + sum(r.taken for r in out if not (r.text or "").startswith("d")) == sum(r.taken for r in out)
    assert max(count.values()) <= 3
    empty = mixing.mix(docs.limit(0))
    assert empty[0].collect() == [] and empty[1].collect() == []


def test_shards_draw_all_slots():
    out = mixing.shard_counts([1000, 10, 0, 333], 16)
    assert out.sum(axis=0).tolist() == [1000, 10, 0, 333] and np.ptp(out.sum(axis=1)) <= 1


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, "\n".join(f"line {j} of {i % 7} " + "x" * (j % 5) for j in range(i % 40))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "one line only"), (103, "a b c d e f g h i j k l " * 4000), (104, "é\u2028x 𝒜\n\n\n y"), (105, "r\n" * 50)]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, fingerprint string").repartition(7)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    rows.sort()
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        own, new, nxt = (set(fingerprints.digests(t).tolist()) for t in (text, edited, after))
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(share(own, new)) and r.near_next == pytest.approx(share(own, nxt))
        assert (r.fingerprint == r.edited_fingerprint) == (own == new)
        assert (r.fingerprint == got[rows[(i + 1) % len(rows)][0]].fingerprint) == (own == nxt)


def test_fingerprints_of_repeated_rows_null_ids_and_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints.fingerprints(make([])).collect() == []
    one = fingerprints.fingerprints(make([(5, "abcd")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    out = fingerprints.fingerprints(make([(None, "first"), (1, "same"), (1, "same"), (2, None)])).collect()
    assert sorted((str(r.doc_id), r.near_next) for r in out) == [("1", 0.0), ("1", 1.0), ("2", 0.0), ("None", 0.0)]


def test_peeling_recovers_both_sides_of_a_difference():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    pairs = [(0, 0), (1, 0), (0, 3), (40, 60), (1500, 1), (0, 2000)]
    a = [keys[:1000 + n] for n, _ in pairs]
    b = [np.concatenate([keys[:1000], keys[3000:3000 + m]]) for _, m in pairs]
    for (n, m), (only_a, only_b) in zip(pairs, fingerprints.differences(a, b), strict=True):
        assert set(only_a) == set(keys[1000:1000 + n]) and set(only_b) == set(keys[3000:3000 + m])


def test_toxicity_folds_signs_and_spares_exceptions():
    lexicon = toxicity.Lexicon({toxicity.folded(t): 4.0 for t in toxicity.BASE_TERMS} | {"lowe*": 3.0})
    hits = lambda text: lexicon.hits(text, lexicon.automaton())
    assert hits("What an IDIOT!") == hits("what an 1d10t") == hits("іdіоt") == 4.0
    assert hits("take out the trash can") == hits("guinea pig") == 0.0 and hits("trash talk") == 4.0
    assert hits("idiotic") == hits("") == hits(None) == hits("classy") == 0.0
    assert hits("loweix") == 3.0 and hits("xlowei") == 0.0
    assert hits("fine " * 200_000 + "moron") == 4.0


def test_toxicity_on_held_out_rows(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(1500):
        toxic = int(rng.random() < 0.2)
        w = [f"w{rng.integers(500)}" for _ in range(int(rng.integers(5, 200)))]
        if toxic:
            for _ in range(3):
                w.insert(int(rng.integers(len(w))), rng.choice(["idiot", "l0ser", "zubba" + str(rng.integers(99)), "zubbakk"]))
        rows.append((i, " ".join(w), toxic, "x"))
        if i % 3:
            labels.append((i, toxic, "clash"))
    docs = spark.createDataFrame(rows + [(None, "idiot idiot", 0, ""), (9000, None, 0, ""), (9001, "", 0, "")], "doc_id long, text string, toxic int, score string")
    marks = spark.createDataFrame(labels + [(None, 1, ""), (1, None, ""), (2, 7, "")], "doc_id long, toxic int, text string")
    lexicon = toxicity.fit(docs, marks)
    got = docs.select("doc_id", "toxic", toxicity.held_out(F.col("doc_id")).alias("held"), toxicity.score(F.col("text"), lexicon).alias("p")).collect()
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held]
    assert sum((r.p >= toxicity.THRESHOLD) == bool(r.toxic) for r in held) >= 0.97 * len(held)
    assert all(0 <= r.p <= 1 for r in got) and next(r.p for r in got if r.doc_id is None) >= 0.3
    assert {r.p for r in got if r.doc_id in (9000, 9001)} == {min(r.p for r in got)}
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.p < toxicity.THRESHOLD for r in got)
    assert toxicity.fit(docs.limit(0), marks.limit(0)).logistic == toxicity.PRIOR


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_give_rows(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder)
    assert rows.count() > 0
