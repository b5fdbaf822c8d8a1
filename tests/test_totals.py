"""Totals beyond the range of a long are exact; those within it are longs, as in SQL."""

from __future__ import annotations

import re

import pytest

from spanforge.catalog import ORACLES, QUERIES
from spanforge.operators import sampling as S
from spanforge.plans.stats import fitted, total

YEAR = 31_536_000_000_000_000
QUERIES_OF_TOTALS = "q26_zone_stats q27_all_zone_stats q21e_zone_names q28_root_zone_stats q128_gpu_zone_stats q24_csv_aggregate q12_csv_export q33_statistics_children q35_statistics_sorted q17_visible_stats q39_child_distribution_inclusive q41_share_of_mean q25_truncated_mean q43_percentiles q56_side_by_side q57_speed_up q49_group_by_name q49_group_by_none q36_gpu_statistics_view q149_views q11_capture q121_flame_zones q124_flame_sorted".split()


@pytest.fixture(scope="module")
def long_dir(tmp_path_factory):
    """Fifty threads with a view of twenty years and a click inside it: a thousand years of each, where a long holds 292."""
    import duckdb

    path = tmp_path_factory.mktemp("long")
    duckdb.connect().execute(f"""COPY (SELECT 8 * (u // 2) + 2 * n + u % 2 AS event_id, TIMESTAMP '1990-01-01' + to_days(CAST(d AS INTEGER)) + to_microseconds(u) AS ts, u AS user_id, kind AS event_type, 1.5::DOUBLE AS value, '{{"k": ' || u % 10 || '}}' AS props
FROM range(50) t(u), (VALUES (0, 0, 'view'), (1, 1, 'click'), (2, 7300, 'purchase'), (3, 7301, 'error')) e(n, d, kind) ORDER BY 1) TO '{path}/events.parquet' (FORMAT parquet)""")
    return str(path)


def plain(rows):
    """Rows with whole numbers as they are and others to nine digits."""
    return sorted(str([f"{x:.9g}" if isinstance(x, float) else str(x) for x in row]) for row in rows)


@pytest.mark.parametrize("name", QUERIES_OF_TOTALS)
def test_totals_beyond_a_long(name, spark, long_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{long_dir}/events.parquet')")
    want = con.execute(re.sub(r"(CAST\(sum\([\w -]+\)(?: OVER \([\w ]+\))?) AS BIGINT\)", r"\1 AS HUGEINT)", ORACLES[name]))  # its numbers, in a type that holds them
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, long_dir).select(*columns).collect()
    assert plain(got) == plain(want.fetchall()) and got


def test_flame_of_a_range_beyond_a_long(spark, long_dir):
    from spanforge.catalog.zones import zones

    since, until = 20 * YEAR, 35 * YEAR  # fifteen years of each of fifty zones
    flat = S.flame_of_zones(zones(spark, long_dir), since, until).collect()
    assert {r.path: (r.time, r["count"]) for r in flat}["view"][1] == 50 and sum(r.time for r in flat) > 2 * (1 << 63)


def test_only_totals_beyond_a_long_are_decimals(spark):
    rows = spark.createDataFrame([(1, 1 << 62, 5), (1, 1 << 62, 6), (2, 7, None)], "k int, x long, y long")
    sums = rows.groupBy("k").agg(total("x").alias("x"), total("y").alias("y"))
    got = fitted(sums, "x", "y")
    assert dict(got.dtypes) == {"k": "int", "x": "decimal(29,0)", "y": "bigint"}
    assert sorted((r.k, int(r.x), r.y) for r in got.collect()) == [(1, 1 << 63, 11), (2, 7, None)]
    assert dict(fitted(sums.where("k = 2"), "x", "y").dtypes) == {"k": "int", "x": "bigint", "y": "bigint"}
    assert dict(fitted(sums.where("k = 3"), "x", "y").dtypes) == {"k": "int", "x": "bigint", "y": "bigint"}


def same_order(name, spark, path):
    """The query's rows and those of its SQL, in their order."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}/events.parquet')")
    want = con.execute(re.sub(r"(CAST\(sum\([\w -]+\)) AS BIGINT\)", r"\1 AS HUGEINT)", ORACLES[name]))
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, path)
    return [[str(x) for x in r] for r in got.select(*columns).collect()], [[str(x) for x in r] for r in want.fetchall()], dict(got.dtypes)


@pytest.mark.parametrize("name, column", [("q35_statistics_sorted", "total"), ("q124_flame_sorted", "time")])
def test_order_of_totals_beyond_a_long(name, column, spark, long_dir):
    got, want, types = same_order(name, spark, long_dir)
    assert got == want and len(got) == 2 and types[column] == "decimal(29,0)"


def test_flame_range_query_beyond_a_long(spark, tmp_path):
    import duckdb

    # 22,000 threads with a view over the whole range of five days: 301 years of it
    duckdb.connect().execute(f"""COPY (SELECT 22000 * n + u AS event_id, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS ts, u AS user_id, kind AS event_type, 1.5::DOUBLE AS value, '{{"k": 1}}' AS props
FROM range(22000) t(u), (VALUES (0, 0, 'view'), (1, 9, 'purchase')) e(n, d, kind) ORDER BY 1) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    got, want, types = same_order("q121_flame_zones_range", spark, str(tmp_path))
    assert got == want == [["view", str(22_000 * 5 * 86_400_000_000_000), "22000"]] and types["time"] == "decimal(29,0)"
