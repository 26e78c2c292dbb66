"""Nearest neighbours against brute force: recall, exact scores, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lutrin.llm import neighbours as N
from lutrin.llm.common import table
from lutrin.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, score string, id int"


def brute(rows, is_query, k=20):
    """{query: [(score, vec_id)]} over usable (vec_id, vector) rows of one length each."""
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    return {q: sorted(((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q and len(v) == len(good[q])))[:k] for q in good if is_query(q)}


def found(df):
    out = {}
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for rows in out.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [(-s, i) for _, i, s in rows] == sorted((-s, i) for _, i, s in rows)
    return out


def recall(got, want):
    assert set(got) == {q for q, rows in want.items() if rows}
    assert all(len(got[q]) == len(rows) for q, rows in want.items() if rows)
    return np.mean([len({i for _, i, _ in got[q]} & {i for _, i in rows}) / len(rows) for q, rows in want.items() if rows])


def test_whole_table(spark, folder):
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in table(spark, folder, "embeddings").collect()]
    got, want = found(QUERIES["op13_nearest_neighbours"](spark, folder)), brute(rows, lambda i: i % 20 == 0)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v) for i, v in rows}
    assert all(abs(s - float((vectors[q] * vectors[i]).sum())) < 1e-12 for q, found_rows in got.items() for _, i, s in found_rows)


@pytest.mark.parametrize("lengths", ["equal", "spread"])
def test_clusters_copies_and_lengths(spark, lengths):
    """Tight clusters, a third of all rows equal, and vectors of very different length."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    x = centres[rng.integers(12, size=3000)] + 0.3 * rng.standard_normal((3000, 24))
    x[:1000] = x[0]
    if lengths == "spread":
        x[1000:] *= np.exp(rng.standard_normal(2000))[:, None]
    order = rng.permutation(3000)
    rows = [(int(i), x[n].tolist()) for i, n in enumerate(order)]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    assert recall(found(N.nearest(df, F.col("vec_id") % 50 == 0)), brute(rows, lambda i: i % 50 == 0)) >= 0.9


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, -0.0]), (3, [0.5, 0.0]), (4, None), (5, []), (6, [0.0, -0.0]), (7, [1.0, None]),
            (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (21, [1.0, 0.0, 0.0]), (40, [7.0]),
            (60, [-3.0, 1e-3]), (-20, [1e3, 1.0])]
    df = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)
    got = found(N.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute(rows, lambda i: i % 20 == 0)
    assert {q: [(-s, i) for _, i, s in r] for q, r in got.items()} == {q: r for q, r in want.items() if r}
    twice = spark.createDataFrame([(0, [1.0], "s", 0), (0, [1.0], "s", 0), (1, [2.0], "s", 0), (1, [2.0], "s", 0)], SCHEMA)
    assert found(N.nearest(twice, F.col("vec_id") % 20 == 0)) == {0: [(1, 1, 2.0)]}
    assert found(N.nearest(df.limit(0), F.lit(True))) == {}


def test_codes_keep_direction_and_length():
    import pyarrow as pa

    x = np.random.default_rng(0).standard_normal((50, 32)) * 1e6
    raws = [v.tobytes() for v in x]
    import pandas as pd
    units, norms = N.decoded(pa.array(list(N._code.func(pd.Series(raws))), pa.binary()))
    true = np.linalg.norm(x, axis=1)
    assert np.abs(units - x / true[:, None]).max() < 0.005 and np.abs(norms / true - 1).max() < 1e-6
