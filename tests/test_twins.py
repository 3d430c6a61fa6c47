"""Spark queries against their SQL twins on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from barloom.plans.catalog import CATALOG

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["top_ranked", "rsi", "directional_index", "supertrend", "hurst_exponent", "kalman_trend", "triple_barrier_label",
         "walk_forward_folds", "daily_options_summary", "max_pain_by_join", "option_greeks", "news_sentiment", "sector_tags",
         "article_mentions", "trade_outcomes", "trade_verdicts", "performance_summary", "candles", "asof_fill_quote", "mark_to_market",
         "life_verdicts", "marked_equity", "sampled_sequences", "yearly_extremes"]


def rows(df: pd.DataFrame) -> list:
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return str(pd.Timestamp(v)) if hasattr(v, "isoformat") else str(v)
    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    query = CATALOG[name]
    assert rows(query.run(spark, DIR).toPandas()) == rows(con.execute(query.sql).df())
