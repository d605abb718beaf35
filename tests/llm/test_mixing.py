import numpy as np
import pytest

from sagekeep.llm.mixing import fit_budget, knapsack, mix, reached_shares

DOCS = "doc_id long, text string, source string, uses int, n_tokens long"
GOALS = "source string, target_share double, max_repeats int"


def test_knapsack_meets_reachable_sums_and_comes_near_others():
    lengths, counts = np.array([3, 5, 7]), np.array([2, 1, 1])
    for target in range(0, 20):
        best = max(
            3 * a + 5 * b + 7 * c for a in range(3) for b in range(2) for c in range(2) if 3 * a + 5 * b + 7 * c <= target
        )
        take = knapsack(lengths, counts, target)
        assert (take <= counts).all() and (take * lengths).sum() == best


@pytest.mark.parametrize("budget", [0, 1, 999, 12_345, 50_000, 149_999])
def test_budget_is_met_exactly_where_it_can_be(budget):
    lengths = np.arange(1, 301)
    counts = np.full(300, 2)
    passes, extra = fit_budget(lengths, counts, budget, 3)
    assert (extra >= 0).all() and (extra <= counts).all()
    assert (lengths * (passes * counts + extra)).sum() == budget


def test_shares_repeats_and_odd_rows(spark):
    rows = [(i, "word " * (i % 17 + 1), "A " if i % 2 else "a", 0, 0) for i in range(200)]
    rows += [(1000 + i, "word " * (i % 5 + 1), "b", 0, 0) for i in range(20)]
    rows += [(2000, None, "a", 0, 0), (2001, "", "b", 0, 0), (2002, "x", None, 0, 0), (None, "x", "a", 0, 0), (3000, "x", "other", 0, 0)]
    rows += [rows[0], rows[1]]
    docs = spark.createDataFrame(rows, DOCS)
    goals = spark.createDataFrame([("A", 0.6, 1), ("B", 0.3, 4), ("gone", 0.1, 2), (None, 0.1, 1), ("zero", 0.0, 1)], GOALS)
    chosen = mix(docs, goals)
    found = chosen.collect()
    assert len({r.doc_id for r in found}) == len(found)
    assert all(r.uses <= (1 if r.source == "a" else 4) for r in found)
    assert not {2000, 2001, 2002, 3000, None} & {r.doc_id for r in found}
    shares = {r.source: r for r in reached_shares(chosen, goals).collect()}
    assert abs(shares["a"].share - 2 / 3) < 0.01 and abs(shares["b"].share - 1 / 3) < 0.01
    assert shares["gone"].tokens == 0 and shares["gone"].share == 0
    assert mix(docs, goals).exceptAll(chosen).count() == 0  # the draw is seeded


def test_empty_inputs(spark):
    docs, goals = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], GOALS)
    assert mix(docs, goals).collect() == []
    assert mix(spark.createDataFrame([(1, "x", "a", 0, 0)], DOCS), goals.filter("false")).collect() == []


def test_one_length_that_holds_most_documents(spark):
    docs = spark.createDataFrame([(i, "same size text", "a", 0, 0) for i in range(3000)] + [(9999, "b", "b", 0, 0)], DOCS)
    goals = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 30)], GOALS)
    found = mix(docs, goals, total=300).collect()
    assert sum(r.uses * r.n_tokens for r in found if r.source == "a") == 270
