"""Every core query runs, and equals its SQL where it has one."""

import pytest

from stridelake.plans import registry
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    more, less = differences(registry.QUERIES[name](spark, data), registry.ORACLE_SQL[name], data)
    assert not more and not less


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0


def test_finite_or_zero_of_every_line(spark, data):
    """Also lines of later windows and without a window."""
    lines = spark.read.parquet(f"{data}/energy.parquet")
    got = registry.QUERIES["f21_finite_or_zero"](spark, data)
    assert got.count() == lines.count() > lines.where("win_idx < 50").count()
    assert got.where("energy is null or isnan(energy) or abs(energy) = double('inf')").count() == 0


def test_otsu_of_readings_above_a_hundred(spark, tmp_path):
    """Files whose upper class lies above 100, or that lie above it as a whole."""
    rows, n = [], 0
    for mode, low, high in (("a", 20.0, 150.0), ("b", 300.0, 400.0)):
        for win in range(60):
            n += 1
            rows.append((f"/x/stream_energy_velocity_{mode}.jsonl", mode, win, (low if win % 2 else high) + win % 5, n))
    spark.createDataFrame(rows, "path string, stem string, win_idx long, energy double, line_id long").write.parquet(str(tmp_path / "energy.parquet"))
    got = {r["path"][-7]: r["threshold"] for r in registry.QUERIES["a19_otsu"](spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b"} and 23.5 < got["a"] < 150 and 303.5 < got["b"] < 400  # the centre of a bin, which may hold the lower class
