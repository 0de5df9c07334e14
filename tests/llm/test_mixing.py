"""The source mix against brute force, and the promises of its docstring."""

from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from gridpulse.llm import mixing
from gridpulse.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.conftest import CLASHING


def aims(totals):
    """Targets by resharing the excess until no source is above three times its size."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    whole, target = sum(totals.values()), {}
    open_ = set(order)
    while open_:
        left = whole - sum(target.values())
        share = Fraction(left, sum(weight[s] for s in open_))
        over = {s for s in open_ if share * weight[s] > 3 * totals[s]}
        if not over:
            return target | {s: share * weight[s] for s in open_}
        target |= {s: Fraction(3 * totals[s]) for s in over}
        open_ -= over
    return target


ROWS = [
    *[(i, "w " * (1 + i * 7 % 13), "en", "big") for i in range(60)],
    (100, "x y z", None, "a"), (101, "x", None, "a"), (102, None, None, "a"), (103, "", None, "b"),
    (104, "one\ttwo three\x0bfour", None, "Ä"), (105, "p q r s", None, None),
    (None, "n n", None, "big"), (None, "n n n", None, "big"),
    *[(7, "same text", None, "c")] * 5, (8, "long " * 30000, None, "d"),
]


def test_mix_equals_brute_force(docs):
    out = mixing.scheduled(docs(ROWS, CLASHING)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in ROWS)
    sizes = Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")])
    expected = aims(sizes)
    taken = Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(expected[r["source"]]), abs=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) == r["reads"]
        assert all(0 <= p <= 1 for p in r["positions"]) and sorted(r["positions"]) == r["positions"]
        taken[r["source"]] += r["taken"]
    for source, target in expected.items():
        assert abs(taken[source] - target) <= 1
    assert sum(sizes.values()) == pytest.approx(sum(map(float, expected.values())))


def test_reruns_and_row_order_do_not_matter(docs):
    first = mixing.scheduled(docs(ROWS)).collect()
    again = mixing.scheduled(docs(ROWS[::-1]).repartition(5)).collect()
    assert Counter(map(str, first)) == Counter(map(str, again))


def test_schedule_is_inverted():
    for schedule in mixing.SCHEDULES:
        pieces = mixing._knots(schedule)
        assert pieces[0][3] == 0.0
        for (start, rate, slope, before), (end, _, _, after) in zip(pieces, pieces[1:]):
            step = end - start
            assert before + rate * step + slope * step * step / 2 == pytest.approx(after)


def test_positions_follow_the_schedule(spark):
    """Half of a falling source's words are due well before half time."""
    shares = spark.range(0, 101).select((F.col("id") / 100).alias("q"))
    for schedule in mixing.SCHEDULES:
        got = shares.select("q", mixing.due_time(F.col("q"), schedule).alias("t")).collect()
        for row in got:
            given = 0.0
            for (a, x), (b, y) in zip(schedule, schedule[1:]):
                step = max(0.0, min(row["t"], b) - a)
                given += x * step + (y - x) / (b - a) * step * step / 2
            whole = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(schedule, schedule[1:]))
            assert given / whole == pytest.approx(row["q"], abs=1e-9)


def test_training_order(docs):
    mix = mixing.in_training_order(mixing.scheduled(docs(ROWS)))
    seen = [r["position"] for r in mix.collect()]
    read = [p for p in seen if p is not None]
    assert read == sorted(read) and None not in seen[: len(read)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", None, "a"), (2, " \n", None, "b")]])
def test_nothing_to_mix(docs, rows):
    out = mixing.scheduled(docs(rows)).collect()
    assert [(r["size"], r["target"], r["taken"], r["position"]) for r in out] == [(0, 0.0, 0, None)] * len(rows)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    name = "op13_source_mix"
    assert differences(spark, connect(folder), folder, name, LLM_QUERIES, LLM_ORACLES) is None


def test_plan_has_no_python(docs):
    plan = mixing.in_training_order(mixing.scheduled(docs(ROWS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
