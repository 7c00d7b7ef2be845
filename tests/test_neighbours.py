import numpy as np
import pytest

from tessera.operators import neighbours, surface


def test_only_near_pairs_leave_a_task():
    rng = np.random.default_rng(1)
    ids, vectors = np.arange(5000), rng.normal(size=(5000, 16))
    best = np.full((50, 10), np.inf)
    n = sum(len(neighbours.candidates(ids[i : i + 500], vectors[i : i + 500], ids[::100], vectors[::100], best)[0]) for i in range(0, 5000, 500))
    assert 500 <= n < 50 * 5000 / 50


@pytest.mark.parametrize("odd", [None, "[]", "[1, null]", "[1, 2, 3]", "[1, nan]"])
def test_neighbours_are_those_of_the_sql(spark, tmp_path, odd):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(0, 4, 2) / 3]) for i in range(300)]
    rows += [(i, [0.5, 0.5]) for i in range(300, 420)] + [(100, [0.25, 1.0]), (None, [0.0, 0.0])]
    if odd:
        rows.append((500, {"[]": [], "[1, null]": [1.0, None], "[1, 2, 3]": [1.0, 2.0, 3.0], "[1, nan]": [1.0, float("nan")]}[odd]))
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = (sorted(map(repr, q(spark, str(tmp_path)).collect())) for q in (surface.knn_topk, surface.SURFACE["knn_topk"].run))
    assert got == want and len(got) >= 40


def test_distances_are_not_a_join_of_all(spark, tiny):
    plan = surface.queries()["knn_topk"](spark, tiny)._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" in plan
