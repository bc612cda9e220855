"""Tree models as node tables against MLlib's own scores, and in SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ml as L
from barloom.operators import trees as T

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    y = x[:, 0] * 2 + (x[:, 1] > 0) + rng.normal(size=400) * 0.1
    data = [(i, *map(float, r), float(v), int(v > 0.5)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id int, a double, b double, c double, y double, label int")


def close(a, b):
    a, b = ({r.id: r[1] for r in df.collect()} for df in (a, b))
    assert set(a) == set(b) and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_forest_boosting_and_classifier_scores(spark, rows):
    forest = L.fit_rf_regressor(rows, COLS, "y", trees=8, depth=4)
    nodes = T.node_table(spark, forest.model)
    close(T.score_mean(rows, nodes, COLS, ["id"], 4), forest(rows).select("id", "prediction"))
    want = dict(zip(COLS, forest.model.featureImportances.toArray()))
    assert all(abs(want[r.feature] - r.importance) < 1e-9 for r in T.importances(nodes, COLS).collect())
    assert [f for f, _ in L.top_importances(forest.model, COLS, 2)] == [r.feature for r in T.importances(nodes, COLS).orderBy(F.desc("importance")).limit(2).collect()]
    boosted = L.fit_gbt_regressor(rows, COLS, "y", trees=6, depth=3)
    close(T.score_sum(rows, T.node_table(spark, boosted.model), COLS, ["id"], 3), boosted(rows).select("id", "prediction"))
    judge = L.fit_balanced_rf(rows, COLS, trees=7, depth=3)
    nodes = T.node_table(spark, judge.model)
    close(T.score_share(rows, nodes, COLS, ["id"], 3), judge(rows).select("id", "confidence"))
    want = dict(zip(COLS, judge.model.featureImportances.toArray()))
    assert all(abs(want[r.feature] - r.importance) < 1e-9 for r in T.importances(nodes, COLS, classes=True).collect())


def test_nodes_score_in_sql(spark, rows):
    forest = L.fit_rf_regressor(rows, COLS, "y", trees=5, depth=3)
    nodes, data = T.node_table(spark, forest.model).drop("stats").toPandas(), rows.toPandas()  # noqa: F841
    got = duckdb.sql("""WITH RECURSIVE w AS (SELECT id, tree, 0 AS node FROM data, (SELECT DISTINCT tree FROM nodes)
      UNION ALL SELECT w.id, w.tree, CASE WHEN [a, b, c][feature + 1] <= threshold THEN "left" ELSE "right" END FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node
      JOIN data d ON d.id = w.id WHERE "left" >= 0)
      SELECT id, avg(prediction) FROM w JOIN nodes n ON n.tree = w.tree AND n.node = w.node WHERE "left" < 0 GROUP BY id""").fetchall()
    want = {r.id: r.prediction for r in forest(rows).collect()}
    assert len(got) == 400 and all(abs(want[i] - p) < 1e-9 for i, p in got)
