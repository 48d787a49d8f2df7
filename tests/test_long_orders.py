"""Queries over orders with more lines than the small tables have, against their SQL."""

import datetime
import random

import duckdb
import pandas as pd
import pytest

from millrace import plans
from millrace.operators import columns, geometry, layout
from millrace.plans import grids


@pytest.fixture(scope="module")
def long_orders(tmp_path_factory):
    """Orders of 1, 4, 17, 20, 24 and 30 lines in each class of order numbers by 3; quantities count up by one."""
    at = str(tmp_path_factory.mktemp("sf"))
    rows = [(30 * i + j, 7 * n, 3, n % 7 + 1, float(n // 7 + 7 * (n % 7) + 1), 1000.0 + n, 0.05, 0.01, "A", "F", datetime.datetime(2000, 1, 1)) for i, k in enumerate((1, 4, 17, 20, 24, 30)) for j in range(3) for n in range(k)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    pd.DataFrame(rows, columns=names).astype({"l_linenumber": "int32", "l_shipdate": "datetime64[us]"}).to_parquet(f"{at}/lineitem.parquet")
    return at


@pytest.mark.parametrize("name", ["ruled_grid_rows", "headed_word_tables"])
def test_long_orders(spark, long_orders, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{long_orders}/lineitem.parquet'")
    df = plans.QUERIES[name](spark, long_orders)
    rel = con.sql(plans.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted((tuple(r[c] for c in rel.columns) for r in df.collect()), key=str) == sorted(rel.fetchall(), key=str)


def test_only_a_first_column_of_whole_numbers_is_named_by_its_count(spark):
    cells = [(p, r, c, t) for p, cols in ((1, (("1", "2", "3", "4"), ("5", "6", "7", "8"))), (2, (("1", "2", "3", "4", "5", "x"), ("a", "b", "c", "d", "e", "f")))) for c, col in enumerate(cols) for r, t in enumerate(col)]
    heads = [(p, c, h) for p in (1, 2) for c, h in enumerate(("No", "Qty"))]
    got = columns.semantic_headings(spark.createDataFrame(cells, "p int, r int, c int, text string"), spark.createDataFrame(heads, "p int, c int, heading string"), ["p"])
    assert {(r.p, r.c): r.heading for r in got.collect()} == {(1, 0): "row_number", (1, 1): "Qty", (2, 0): "No", (2, 1): "Qty"}


def test_islands_are_those_of_the_buckets_that_words_cover(spark):
    rng = random.Random(4)
    words = [(p, float(x), float(x + rng.choice([-3, 0, 1, 9, 40]))) for p in range(40) for x in (rng.randint(-50, 400) for _ in range(rng.randint(1, 12)))]
    got = geometry.column_edges(spark.createDataFrame(words, "p int, x0 double, x1 double"), ["p"], 2, 3).orderBy("p", "column_idx").collect()
    for p in range(40):
        covered = sorted({b for q, a, z in words if q == p for b in range(int(min(a, z) // 2), int(max(a, z) // 2) + 1)})
        runs: list[list[int]] = []
        for b in covered:
            runs.append([b, b]) if not runs or b - runs[-1][1] > 3 else runs[-1].__setitem__(1, b)
        assert [(r.x0, r.x1) for r in got if r.p == p] == [(2.0 * a, 2.0 * (z + 1)) for a, z in runs]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_words_place_words_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(layout, "materialise", lambda df, name: seen.append(df) or df)
    words = spark.createDataFrame([(1, 1, "a", 90.0, 0.0, 9.0, 0.0, 9.0)], "p int, word_idx long, text string, conf double, x0 double, x1 double, y0 double, y1 double")
    layout.tables_of_words(words, ["p"])
    assert _plan(seen[0]).count("MapInPandas") == 1


def test_pages_are_made_in_one_pass_over_the_lines(spark, long_orders):
    made = {"payload_items": grids._documents(spark, long_orders), "layout_regions": grids._page_words(spark, long_orders)[0]}
    assert {k: _plan(df).count("Relation [") for k, df in made.items()} == dict.fromkeys(made, 1)
