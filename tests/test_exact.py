import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residua.functions import exact

DOUBLES = st.floats(allow_nan=False, allow_infinity=False)


def _bins(values):
    """What the aggregation leaves of a group, in plain Python."""
    out = {}
    for x in values:
        if x:
            b = math.floor(math.log2(abs(x)) / exact.WIDTH)
            up = exact.BELOW - exact.WIDTH * b
            units = x * 2.0 ** (up // 2) * 2.0 ** (up - up // 2)
            high = math.floor(units / 2.0**exact.HALF)
            own = out.setdefault(b, [0, 0])
            own[0], own[1] = own[0] + high, own[1] + int(units - high * 2.0**exact.HALF)
    return [{"bin": b, "high": h, "low": low} for b, (h, low) in out.items()]


@settings(max_examples=300, deadline=None)
@given(st.lists(DOUBLES, max_size=12))
def test_total_is_rounded_once(values):
    try:
        want = math.fsum(values)
    except OverflowError:
        return
    assert exact._total(_bins(values)) == want


def test_sums_equal_fsum_whatever_the_order(spark):
    rnd = random.Random(6)
    groups = {k: [rnd.choice([1, -1]) * rnd.random() * 10.0 ** rnd.randint(-300 if k == 1 else -20, 300 if k == 1 else 20) for _ in range(400)] for k in range(4)}
    groups[4], groups[5], groups[6], groups[7] = [5e-324] * 3 + [None], [None, None], [1e308, 1e308, -1e308], [0.1] * 1_000
    groups[8], groups[9], groups[10] = [1.0, math.inf], [math.inf, -math.inf], [math.nan, 1.0]
    rows = [(k, x) for k, values in groups.items() for x in values]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "k int, x double")
    for parts in (1, 7):
        found = {r["k"]: r["total"] for r in exact.exact_sums(frame.repartition(parts, F.rand(3)), ["k"], "x").collect()}
        assert all(found[k] == math.fsum(v for v in groups[k] if v is not None) for k in (0, 1, 2, 3, 4, 7))
        assert found[5] == 0 and found[6] == 1e308  # a sum on the way would overflow
        assert found[8] == math.inf and math.isnan(found[9]) and math.isnan(found[10])
    assert exact.exact_sums(frame.limit(0), ["k"], "x").count() == 0
