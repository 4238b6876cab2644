"""Registered queries against their oracle SQL on the small tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
QUICK = ["cells", "leave_out_residuals", "track_file_cells", "branch_cells", "point_index", "depth_jumps", "shift_stats", "classifier_profile"]


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return [columns[i] for i in order], sorted(clean, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def test_queries_match_oracles(spark, duck):
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in QUICK:
        df = queries[name](spark, SMALL)
        cur = duck.execute(oracles[name])
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall()), name


def test_every_query_has_an_oracle_but_the_models():
    """Fitted models and the resampled grid are tested on fixtures; the training-data queries have tests of their own."""
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    own = {n for n in queries if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())}
    assert own - set(oracles) == {"linear_models", "tree_models", "metrics_by_predicted_bin", "grid_reconstructed_resampled"}
