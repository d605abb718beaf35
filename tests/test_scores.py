import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sagekeep.functions.scores import ScoreConfig, age_label, graph_boost, reinforcement, temporal_confidence

NOW = datetime(2025, 6, 1)
MOMENT = F.lit
CASES = {
    (1,): 1.234367377, (1, 7, 14): 1.405287423, (1 / 24, 1): 1.274160472, (1, 2): 1.368112135, (1, 1): 1.266967686, (60,): 1.019545370,
}


def moment():
    return F.lit(NOW).cast("timestamp")


def events(spark, cases):
    rows = [(f"m{n}", f"e{n}-{i}", NOW - timedelta(days=d)) for n, ages in enumerate(cases) for i, d in enumerate(ages)]
    return spark.createDataFrame(rows, "memory_id string, event_id string, occurred_at timestamp")


def test_reinforcement_of_known_cases(spark):
    for order in (list(CASES), [tuple(reversed(c)) for c in CASES]):
        got = {r.memory_id: r.multiplier for r in reinforcement(events(spark, order), moment()).collect()}
        for n, expected in enumerate(CASES.values()):
            assert got[f"m{n}"] == pytest.approx(expected, abs=1e-8)


def test_reinforcement_switched_off_and_odd_rows(spark):
    off = reinforcement(events(spark, list(CASES)), moment(), ScoreConfig(enabled=False))
    assert {r.multiplier for r in off.collect()} == {1.0}
    odd = spark.createDataFrame([(None, "a", NOW), ("m", "b", None)], "memory_id string, event_id string, occurred_at timestamp")
    assert reinforcement(odd, moment()).collect() == []


def test_events_after_the_moment_weigh_more_than_one(spark):
    got = reinforcement(events(spark, [(-21,)]), moment()).first().multiplier
    assert got == pytest.approx(1 + 0.35 * math.log1p(math.e))


@pytest.mark.parametrize(("degree", "boost"), [(0, 1.0), (5, 1.268763920), (20, 1.456678366)])
def test_graph_boost(spark, degree, boost):
    assert spark.range(1).select(graph_boost(F.lit(degree))).first()[0] == pytest.approx(boost, abs=1e-8)


@pytest.mark.parametrize(
    ("days", "stability", "tau", "expected"),
    [
        (10, "dynamic", 20, 0.606530660), (10, "ephemeral", 20, 0.135335283), (10, "dynamic", 90, 0.894839317), (10, "ephemeral", 90, 0.239651036),
        (10, "static", 90, 1.0), (10, "unknown", 90, 1.0), (10, None, 90, 1.0), (10, "odd label", 90, 0.894839317),
        (1000, "dynamic", 90, 0.01), (-3, "dynamic", 90, 1.0), (None, "dynamic", 90, 1.0),
    ],
)
def test_temporal_confidence(spark, days, stability, tau, expected):
    since = None if days is None else NOW - timedelta(days=days)
    row = spark.createDataFrame([(since, stability)], "t timestamp, s string")
    got = row.select(temporal_confidence("t", "s", moment(), ScoreConfig(dynamic_tau_days=tau))).first()[0]
    assert got == pytest.approx(expected, abs=1e-8)


def test_age_labels(spark):
    ages = {30: "just now", 59: "just now", 60: "1m", 3599: "59m", 3600: "1h", 86_399: "23h", 86_400: "1d", 604_800: "1w", 2_591_999: "4w", 2_592_000: "1mo", -5: "just now"}
    rows = [(NOW - timedelta(seconds=s), label) for s, label in ages.items()] + [(None, "unknown")]
    frame = spark.createDataFrame(rows, "t timestamp, label string").select("label", age_label("t", moment()).alias("got"))
    assert all(r.label == r.got for r in frame.collect())
