import duckdb

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "n_hits", "observation"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
    assert len(qs) >= 70


def test_oracles_match_at_smallest_scale(spark):
    from tools.compare import _rows
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, ors = E.queries(), E.oracle_sql()
    for name in ("bm25_topk", "em_format_scores", "gae_advantages", "replay_rollouts", "prompt_rows"):
        df = qs[name](spark, SF_SMALL)
        rel = con.execute(ors[name])
        dcols = [d[0] for d in rel.description]
        assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, rel.fetchall()), name
