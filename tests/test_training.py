"""Model queries on tables made here."""

import datetime
import math

from barloom.operators import features as fe, models
from barloom.plans.catalog import CATALOG

START = datetime.datetime(1995, 3, 1)
BRANDS, DAYS = 3, 60


def write_tables(spark, folder):
    lines = [(i * BRANDS + b, n, b, 1, 1000.0 + 40 * math.sin(i * (b + 1) * 0.7) + 15 * n, 1.0 + n, 0.01 * ((i + b) % 9), "FO"[(i + n) % 2], START + datetime.timedelta(days=i))
             for i in range(DAYS) for b in range(BRANDS) for n in range(2)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, "
                          "l_linestatus string, l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(b, f"Brand#{b + 1}", b + 1) for b in range(BRANDS)], "p_partkey long, p_brand string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, 37 * i) for i in range(20)], "doc_id long, n_chars int").write.parquet(f"{folder}/documents.parquet")


def test_target_regression_learns_all_features_in_all_rounds(spark, tmp_path, monkeypatch):
    write_tables(spark, tmp_path)
    fitted, fit = [], models.fit_target

    def spy(df, columns, *args, **kwargs):
        fitted.append((df.count(), columns, fit(df, columns, *args, **kwargs)))
        return fitted[-1][2]

    monkeypatch.setattr(models, "fit_target", spy)
    rows = CATALOG["target_regression"].run(spark, str(tmp_path)).collect()
    (n, columns, model), tree, full = fitted[0], fitted[0][2].stages[-1], models.ModelConfig()
    assert len(rows) == 1 and rows[0]["correlation"] is not None
    assert n == BRANDS * DAYS * 70 // 100  # every bar of the first 70 % of the dates
    assert columns == fe.FEATURES and len(columns) == 80 and tree.numFeatures == 80
    assert tree.getNumTrees == full.rounds and max(t.depth for t in tree.trees) == full.boost_depth
