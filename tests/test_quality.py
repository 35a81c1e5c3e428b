import pytest

from sweepgrid.operators import quality


def test_cores_used_keeps_the_baseline(spark):
    """Samples every 0.125 s are published once 0.25 s have passed since the last published one."""
    fast = [("a", k / 8, k * 0.25) for k in range(9)]
    gaps = [("b", 0.0, 1.0), ("b", 0.125, 9.0), ("b", 1.0, 2.0), ("b", 2.0, 1.5), ("b", 3.0, None), ("b", 4.0, 8.0), ("b", 5.0, 9.0)]
    samples = spark.createDataFrame(fast + gaps, "pid string, t double, cpu double").repartition(3)
    got = {(r.pid, r.t): r.cores for r in quality.cores_used(samples, "pid", "t", "cpu").collect()}
    assert len(got) == 16
    assert [got["a", k / 8] for k in range(9)] == [pytest.approx(2.0) if k and k % 2 == 0 else None for k in range(9)]
    assert [got["b", t] for t in (0.0, 0.125, 1.0, 2.0, 3.0, 4.0, 5.0)] == [None, None, 1.0, 0.0, None, None, 1.0]
