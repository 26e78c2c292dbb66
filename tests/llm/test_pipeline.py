"""The pipeline stage by stage against brute-force versions of its decisions."""

import re

import pytest
from test_text_dedup import brute_near, brute_repeats, words

import corpus_pipeline
from lutrin.llm import mixing, packing, queries, toxicity
from lutrin.llm.common import table, written


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = table(spark, folder, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, folder))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_stage_names_and_columns(stages):
    assert list(stages) == ["toxicity", "minhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go(spark, folder, stages):
    before, after = stages["toxicity"]
    lexicon = toxicity.fit(before, table(spark, folder, "labels"))
    scores = before.select("doc_id", toxicity.score(before["text"], lexicon).alias("p")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in scores if r.p < 0.3)


def test_one_of_each_group_stays(stages):
    before, after = stages["minhash_near_dedup"]
    want = brute_near([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, _, kept) in want.items() if kept)


def test_repeats_go(stages):
    before, after = stages["substring_dedup"]
    rows = {r.doc_id: r.text for r in before.collect()}
    want = brute_repeats(rows.items())
    got = {r.doc_id: r for r in after.collect()}
    for doc_id, (n, gone, _) in want.items():
        if doc_id not in got:
            assert gone == n > 0
        else:
            assert len(words(got[doc_id].text)) == n - gone and got[doc_id].n_chars == len(got[doc_id].text)
            assert gone or got[doc_id].text == rows[doc_id]


def test_sources_meet_their_targets(stages):
    before, after = stages["source_mixing"]
    size = lambda rows, s: sum(len(words(r.text)) for r in rows if r.source == s)
    rows, mixed = before.collect(), after.collect()
    order = sorted({r.source for r in rows})
    want = mixing.targets([size(rows, s) for s in order], [1 + i % 3 for i in range(len(order))])
    for s, goal in zip(order, want, strict=True):
        assert abs(size(mixed, s) - goal) <= 0.5
    texts = {r.doc_id: re.sub(r"\s+", " ", r.text or "") for r in rows}
    assert all(set(words(r.text)) <= set(texts[r.doc_id].split(" ")) for r in mixed)


def test_everything_is_packed(stages):
    before, after = stages["best_fit_packing"]
    own = packing.WordTokenizer(queries.public_tokenizer("word_bpe_49k.json"))
    rows = after.collect()
    assert sum(r.length for r in rows) == sum(len(own.encode(r.text)) // 4 + 1 for r in before.collect())
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 4096 and len(by) <= 1.1 * sum(by.values()) / 4096 + 1


def test_run_gives_the_last_stage(spark, folder, stages):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == stages["best_fit_packing"][1].columns
    key = lambda df: sorted(map(str, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert key(got) == key(stages["best_fit_packing"][1])
