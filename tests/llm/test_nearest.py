"""Nearest neighbours against brute force: recall, exact scores, repeated ids, unequal lengths and dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintlake.llm import ann
from lintlake.llm.queries import QUERIES


def true_nearest(rows, q, own, k=20):
    """(id, score) of the k nearest rows other than `own`, ties by id; rows that agree are one."""
    seen = {(i, tuple(v)) for i, v in rows if len(v) == len(q)} - {own}
    scored = sorted((-float((np.asarray(v) * q).sum()), i) for i, v in seen)
    return [(i, -s) for s, i in scored[:k]]


def recall_of(out, rows, queries):
    hits = []
    for i, v in queries:
        want = true_nearest(rows, np.array(v), (i, tuple(v)))
        got = out[out.query_id == i].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, len(want) + 1))
        assert all(a >= b for a, b in zip(got.score, got.score.iloc[1:]))
        hits.append(len({x for x, _ in want} & set(got.vec_id)) / max(len(want), 1))
    return np.mean(hits)


@pytest.mark.parametrize("spread", [0.0, 1.0])
def test_recall(spark, spread):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x *= (np.exp(spread * rng.normal(size=3000)) / np.linalg.norm(x, axis=1))[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (9000, None), (9020, [0.0] * 24), (9040, [float("nan")] * 24), (9060, [1.0, float("inf")] * 12), (None, x[0].tolist())], "vec_id long, embedding array<double>")
    out = ann.nearest(df, F.col("vec_id") % 20 == 0, leaf=100).toPandas()
    assert recall_of(out, rows, rows[::20]) >= 0.9
    for r in out.itertuples():
        assert np.isclose(r.score, (x[r.query_id] * x[r.vec_id]).sum(), rtol=1e-12) and r.query_id != r.vec_id
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_few_and_repeated_rows(spark):
    rows = [(0, [5.0, 0.0]), (1, [5.0, 0.0]), (1, [0.1, 0.0]), (1, [0.1, 0.0]), (20, [1.0, 1.0]), (20, [-1.0, 1.0]), (3, [1.0, 2.0, 3.0]), (40, [0.0, 1.0, 0.0]), (60, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 4)))
    assert got[0] == [(1, 1, 25.0), (2, 20, 5.0), (3, 1, 0.5), (4, 20, -5.0)]
    assert got[40] == [(1, 3, 2.0)] and 60 not in got
    assert sorted(got[20]) == sorted([(1, 0, 5.0), (2, 1, 5.0), (3, 1, 0.1), (4, 20, 0.0), (1, 20, 0.0), (2, 1, -0.1), (3, 0, -5.0), (4, 1, -5.0)])


def test_every_list_is_filled(spark, monkeypatch):
    """A bound that is much too narrow, on crowded and lonely rows: the rest asks again."""
    monkeypatch.setattr(ann, "RECALL", 0.0)
    monkeypatch.setattr(ann, "CHUNK", 64)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=8), (500, 1)), rng.normal(size=(300, 8)), 50 + rng.normal(size=(3, 8))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, leaf=10, recall=0.0).toPandas()
    assert out.groupby("query_id").size().tolist() == [20] * 41
    same = out[(out.query_id < 500)].groupby("query_id").vec_id.apply(list)
    assert all(v[0] in (800, 801, 802) or v == sorted(v) for v in same)


def test_query(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op6_nearest_neighbours"](spark, str(tmp_path))
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert out.count() == 60
