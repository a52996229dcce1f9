"""Plans that stay small however operators are nested, and quantiles that rank few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from laminaflow.operators.ordered import group_quantiles
from laminaflow.operators.robust import robust_z
from laminaflow.plans import QUERIES


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_markdown_rows_reads_its_table_a_bounded_number_of_times(spark):
    assert scans(QUERIES["markdown_rows"](spark, "/root/testdata/sf0.001")) < 300  # about 3000 before, by counting the nesting


def test_quantiles_and_scores_read_their_rows_few_times(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert scans(group_quantiles(events, ["event_type"], "value", {"p": 0.5})) == 2
    assert scans(robust_z(events, ["event_type"], "value")) <= 7


@pytest.mark.parametrize("nearest", [False, True])
def test_quantiles_of_odd_values(spark, nearest):
    rng = np.random.default_rng(5)
    groups = {"wide": rng.standard_normal(500) * 10.0 ** rng.integers(-12, 12, 500), "equal": np.full(40, 8.0), "close": 1e9 + rng.integers(0, 9, 300),
              "twos": 2.0 ** rng.integers(-5, 6, 200) * rng.choice([-1, 1], 200), "zeros": np.array([0.0, -0.0, 0.0, 1.0]), "one": np.array([3.5]), "ends": np.array([-np.inf, -1.0, 0.0, 2.0, np.inf]), None: np.array([1.0, 2.0, 4.0])}
    rows = [(k, float(v)) for k, values in groups.items() for v in values] + [("wide", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    wanted = {"a": 0.05, "b": 0.5, "c": 0.99}
    found = {r["k"]: r for r in group_quantiles(df, ["k"], "v", wanted, nearest, {"rows": F.count(F.lit(1))}).collect()}
    assert set(found) == set(groups)
    for k, values in groups.items():
        s, r = np.sort(values), found[k]
        assert r["rows"] == len(s)
        for name, q in wanted.items():
            at = q * (len(s) - 1)
            if nearest:
                assert r[name] == s[int(np.rint(at))]
            else:
                lo, hi = s[int(np.floor(at))], s[int(np.ceil(at))]
                assert r[name] == pytest.approx(lo if lo == hi else (np.ceil(at) - at) * lo + (at - np.floor(at)) * hi, rel=1e-12)


def test_outliers_of_sessions_read_their_rows_few_times(spark):
    assert scans(QUERIES["session_outliers"](spark, "/root/testdata/sf0.001")) <= 13  # far over 100 before, by counting the nesting


def test_a_trial_sends_ten_bytes_a_row():
    from laminaflow.operators import slopes
    sizes = slopes.Sizes(chunk=64, range=16)
    y = np.random.default_rng(3).standard_normal(64)
    chunk = {"key": "k", "rank": 5, "chunk": 2, "ys": y.tobytes(), "middle": 0.0, "rows_x": [0.0, 50.0, 150.0], "rows_y": [0.1, -0.2, 0.3], "n": 192, "trials": [0.0, 0.1]}
    pieces = list(slopes._pieces(chunk, sizes))
    assert len(slopes.STEPS) <= 4
    assert sum(len(p["x"]) + len(p["r"]) for p in pieces) == 2 * 64 * 10
