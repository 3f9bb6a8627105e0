"""Vantage-point trees: exact with factor 1, recall with the production factor."""

import numpy as np
import pytest

from tallyframe.llm.vptree import FACTOR, nearest_neighbours
from tallyframe.llm import vptree

SCHEMA = "vec_id long, embedding array<float>, score double, rank int, dim int, tree string"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], 0.0, 0, 0, "") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def plain(vectors, ids, k=20):
    x = np.array(vectors, np.float32).astype(np.float64)
    ids = np.array(ids)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = (x * x[i]).sum(1)
        scores[i] = -np.inf
        out[int(ids[i])] = [int(ids[j]) for j in np.lexsort((ids, -scores))[:k] if j != i]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


@pytest.mark.parametrize("spread", [0.0, 2.0])
def test_factor_one_is_exact(spark, monkeypatch, spread):
    """Vectors of different norms, with repeated vectors whose ties go to the smaller id."""
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "SHARD_ROWS", 150)
    r = np.random.default_rng(2)
    vectors = r.normal(size=(400, 6)) * np.exp(spread * r.normal(size=(400, 1)))
    vectors[100:160] = vectors[7]
    assert found(nearest_neighbours(table(spark, vectors), factor=1.0)) == plain(vectors, np.arange(400))


def test_recall_with_the_production_factor(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    local = rows.orderBy("vec_id").toPandas()
    want = plain(np.stack(local.embedding.to_numpy()), local.vec_id.to_numpy())
    got = found(nearest_neighbours(rows, factor=FACTOR))
    hits = sum(len(set(got[q]) & set(v)) for q, v in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == len(v) for q, v in want.items())


def test_rows_that_take_no_part(spark):
    vectors = [[1, 0], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [0.5, 1], [2, 0, 0], [1, 1], [], [3, 3]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, None, 160, 1]
    got = found(nearest_neighbours(table(spark, vectors, ids)))
    assert got == {0: [1, 120], 120: [1, 0]}


def test_scores_are_inner_products(spark):
    rows = nearest_neighbours(table(spark, [[1, 2], [3, 4], [5, -6]])).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in rows] == [(1, 11.0), (2, -7.0)]


def test_repeated_ids_and_empty_table(spark):
    got = found(nearest_neighbours(table(spark, [[1, 0], [0, 1], [1, 1], [1, 1]], [0, 0, 3, 3])))
    assert got == {0: [3, 3]}
    assert nearest_neighbours(table(spark, [])).count() == 0


def test_many_copies_of_one_row(spark):
    """Copies are combined before they are dealt, and are rows again at the end."""
    vectors = [[3, 4]] * 30 + [[1, 0], [0, 1]]
    got = found(nearest_neighbours(table(spark, vectors, [7] * 30 + [0, 20])))
    assert got == {0: [7] * 20, 20: [7] * 20}


def test_regions_bound_distances_and_prune_clusters():
    """No region is left out that holds something nearer; clustered vectors leave out most."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 8))
    points = centres[r.integers(0, 40, 4000)] + 0.02 * r.normal(size=(4000, 8))
    largest = float(np.sqrt((points * points).sum(1).max()))
    regions = vptree.Regions(points[:1500], largest, 40)
    of = regions.of(points)
    profiles = {int(x): regions.profile(int(x), points[of == x]) for x in np.unique(of)}
    asked = points[:200]
    gaps = regions.gaps(asked, profiles)
    visited = 0
    for region in profiles:
        scores = asked @ points[of == region].T
        distance = np.sqrt(np.maximum((asked * asked).sum(1)[:, None] + largest**2 - 2 * scores, 0)).min(1)
        assert (gaps[region] <= distance + 1e-9).all()
    kth = np.sort(asked @ points.T, axis=1)[:, -20]
    limit = np.sqrt((asked * asked).sum(1) + largest**2 - 2 * kth)
    visited = np.mean([gaps[region] <= limit for region in profiles])
    assert visited < 0.5


def test_parts_hold_a_bounded_number_of_queries(monkeypatch):
    monkeypatch.setattr(vptree, "QUERY_PART", 100)
    parts = vptree.query_parts({(3, 0): 60, (3, 1): 40, (3, 2): 1, (3, 3): 250, (3, 4): 5})
    assert parts == {(3, 0): (0, 1), (3, 1): (0, 1), (3, 2): (1, 1), (3, 3): (2, 3), (3, 4): (5, 1)}
