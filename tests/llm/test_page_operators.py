"""URL filter, extraction, WARC bundles and embeddings: SQL twin, held-out pages, round trips, brute force."""

import base64
import hashlib
import io
import random

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lutrin.llm import embeddings, extraction, labelled_pages, queries, urls, warc

URLS = ["http://WWW.Example.COM/en/a?x#y", "https://example.com/en", "http://a.net/es/1", "ftp://net/fr/", "http://xnet/es/", "nothing", "", None, "http://",
        "http://a.org/CASINO/x", "http://a.org/casinox", "http://a.org/free-bets", "http://a.org/?u=http://b.net/es/", "http://h.com", "http://h.com#/x",
        "http://ads.a.org/track", "http://a.org/ads/ads/ads", "http://a.org/éspam-farmé", "x://u:p@host.org:80/p;q?a/b", "http://a.org/win_free_x", "\nhttp://n.net/es/\n2"]


def test_url_verdicts_equal_sql(spark):
    rows = [(i, u, "clash", "r") for i, u in enumerate(URLS)] + [(None, URLS[0], "", ""), (3, URLS[2], "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = urls.verdict(pages, queries.RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [r[:2] for r in rows])
    want = con.execute(urls.verdict_sql(queries.RULES)).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by = {u: tuple(r)[1:] for u, r in zip(URLS, got, strict=False)}
    assert by[URLS[0]] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert by["https://example.com/en"] == ("example.com", "/en", "com/", "allow")
    assert by["http://xnet/es/"] == ("xnet", "/es/", None, "allow")
    assert by["http://h.com"] == ("h.com", "", None, "allow")
    assert [by[u][-1] for u in ("http://a.org/CASINO/x", "http://a.org/casinox", "http://a.org/free-bets", "http://a.org/ads/ads/ads", "http://ads.a.org/track")] == [
        "block", "allow", "block", "allow", "block"]
    assert by[None] == by[""] == ("", "", None, "allow")
    assert urls.verdict(pages.limit(0), queries.RULES).collect() == []


def test_url_query_equals_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    got = queries.QUERIES["op3_url_filter"](spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(queries.SQL["op3_url_filter"]).fetchall(), key=str)


@pytest.fixture(scope="module")
def field():
    return extraction.fitted()


def test_extraction_of_held_out_pages(field):
    pages = labelled_pages.pages(copies=8, seed=77)
    labels = [(a, b) for html, y in pages for a, b in zip(field.viterbi(extraction.blocks(html)), y, strict=True)]
    assert len(labels) > 500 and sum(a == b for a, b in labels) >= 0.98 * len(labels)


def test_extraction_of_broken_and_empty_pages(spark, field):
    page = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav>'
            '<!-- <p>no</p> --><div class="ad">Buy this now.</div><article><h1>The  title</h1><p><b>First\n line &amp; more.<br><p>AT&ampT &quot;x&quot; 1 < 2 &am'
            '</article><footer>&copy; host &middot; Words here.</footer></body></html>')
    want = 'The title\nFirst line & more.\nAT&T "x" 1 < 2 &am'
    assert field.main_text(page) == want
    assert field.main_text(page[:page.index("</article>") + 4]) == want
    rows = [(1, page, "clash"), (2, None, ""), (3, "", ""), (4, "<nav>x</nav>", ""), (5, "<article><p>" + "word " * 100_000 + "</p></article>", ""), (None, page, ""), (1, page, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [r.m for r in pages.select(extraction.main_text(F.col("html"), field).alias("m")).collect()]
    assert got == [want, "", "", "", ("word " * 100_000).strip(), want, want]
    assert pages.limit(0).select(extraction.main_text(F.col("html"), field)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>x</title><body><article><p>Main text here.</p></article>", ["Main text here."]),
    ("<html><head><meta charset=utf-8><script>s</script><p>Main", ["Main"]),
    ("<head><noscript><link></noscript><meta x><p>t", ["t"]),
    ("<p>a <svg class=i/> b</p><p>second para.</p>", ["a b", "second para."]),
    ("<p>a <svg><text>no</text><svg>no</svg>no</svg> b<math/> c</p>", ["a b c"]),
    ("<p>a <svg>no</p><p>yes</p><svg></svg>", ["a", "yes"]),
    ("<p>a <svg>no<p>yes</p></svg>z", ["a", "yes", "z"]),
    ("<p>a <math><mi>x</mi><mo>=</mo></math> b <object data=q>or <b>this</b></object></p>", ["a x= b or this"]),
    ("<article><video src=x/><p>rest</p></article><p>end</p>", ["rest", "end"]),
    ("<div>a<video src=x>no</div><p>rest</p><video>no <p>no</p></video> end", ["a", "rest", "end"]),
    ("<div>a<template><div>no</div><template>no</template>no</template>b</div>", ["ab"]),
    ("<p>a<select><option>no<option>no</select>b</p><textarea>no", ["ab"])])
def test_elements_without_text_end_where_html_ends_them(page, want):
    assert [b.text for b in extraction.blocks(page)] == want


def test_main_text_of_a_page_without_end_of_head(field):
    assert field.main_text("<html><head><title>x</title><body><article><p>Main text here.</p></article>") == "Main text here."


def test_field_gradient_matches_enumeration():
    rng = np.random.default_rng(1)
    s, t = rng.standard_normal((1, 3, 2)), rng.standard_normal((2, 2))
    marginal, pairs = extraction._expected(s, t, np.ones((1, 3), bool))
    paths = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    weight = np.array([np.exp(s[0, range(3), p].sum() + t[p[0], p[1]] + t[p[1], p[2]]) for p in paths])
    weight /= weight.sum()
    assert np.allclose(marginal[0], [[sum(w for w, p in zip(weight, paths, strict=True) if p[i] == k) for k in (0, 1)] for i in range(3)])
    assert np.allclose(pairs, [[sum(w * sum(p[i:i + 2] == (a, b) for i in (0, 1)) for w, p in zip(weight, paths, strict=True)) for b in (0, 1)] for a in (0, 1)])


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    texts = [None, "", "<p>é</p>", "\r\n\r\nWARC/1.1\r\n", "x" * 300_000] + ["".join(rng.choices("ab<>\n", k=200)) for _ in range(30)]
    rows = [(i, None if i % 11 == 0 else f"http://h/{i} x\n", texts[i % len(texts)], "clash") for i in range(80)] + [(None, "u", texts[7], ""), (79, "again", texts[79 % 35], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _key string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    index = warc.write(warc.with_originals(pages), folder, frame_bytes=2000, bundle_bytes=4000)
    got = warc.resolved(warc.read(index)).collect()
    last = {}
    for i, _, html, _ in rows:
        last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        own = last[html or ""] == i
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if own else "revisit", None if own else last[html or ""]))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    some = index.filter("page_id in (3, 60)")
    assert {r.page_id: bytes(r.payload).decode() for r in warc.read(some).collect() if r.record_type == "response"}[60] == texts[60 % 35]
    files = sorted((tmp_path / "warc").iterdir())
    assert len(files) > 2 and all(f.name.endswith(".warc.zst") for f in files)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(files[0].read_bytes()), read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ")
    reader = warc.BundleReader(f"file://{files[0]}")
    assert sum(size for _, size in reader.sizes) == len(plain) and len(reader.sizes) >= 1
    empty = warc.write(warc.with_originals(pages.limit(0)), folder)
    assert warc.resolved(warc.read(empty)).collect() == []


def brute_vectors(rows, threshold=0.95):
    units = {}
    for i, v in rows:
        x = embeddings.unit(None if v is None else np.array(v, dtype=object))
        if i is not None and x is not None:
            units.setdefault(i, x)
    ids = sorted(units)
    near = {a: [b for b in ids if b != a and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold] for a in ids}
    component = {i: i for i in {r[0] for r in rows if r[0] is not None}}
    moved = True
    while moved:
        moved = False
        for a in ids:
            low = min([component[a], *(component[b] for b in near[a])])
            if low < component[a]:
                component[a], moved = low, True
    return {i: (len(near.get(i, [])), component[i], component[i] == i) for i in component}


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 32)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    rows = [(i, base[i].tolist()) for i in range(300)]
    for i in range(300, 500):
        x = base[i % 40] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.3])
        rows.append((i, (x * rng.uniform(0.1, 9)).tolist()))
    rows += [(1000 + i, base[3].tolist()) for i in range(70)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] * 16), (2005, [float("inf")] + [0.0] * 15),
             (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e300] * 16), (2009, [1e-300] * 16), (None, base[3].tolist())]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, rep string, cell int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect()}
    assert got.pop(None) == (0, None, True)
    want = brute_vectors(rows)
    links = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.99 * links and all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)
    assert [got[i] for i in (2000, 2001, 2002, 2003, 2004, 2005)] == [(0, i, True) for i in range(2000, 2006)]
    assert got[2007] == (1, 2006, False) and got[2009] == (1, 2008, False)
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_embedding_recall_on_random_neighbours_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.98 * 4000


@pytest.mark.parametrize("size, inner", [(384, 4), (384, 6)])
def test_embedding_recall_of_vectors_that_vary_in_few_directions(spark, size, inner):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, inner)) @ rng.standard_normal((inner, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = int((x @ x.T >= embeddings.THRESHOLD).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in embeddings.near_duplicates(df).collect())
    assert links > 1000 and 0.98 * links <= got <= links


def test_embeddings_of_repeated_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
