"""Medians from counted values against sorted ones."""

import random
from datetime import date
from decimal import Decimal as D
from statistics import median

from tallyspark.operators.recurring import recurring_in_period
from tallyspark.operators.windows import group_medians, with_group_median


def test_medians_of_any_size_and_sign(spark):
    r, rows = random.Random(6), []
    sizes = [lambda: D(r.randrange(-300, 300)) / 100, lambda: D(10) ** r.randrange(-2, 12), lambda: D(r.randrange(10**9)) / 100, lambda: D("99.99") + D(r.randrange(4)) / 100, lambda: D(0)]
    for g in range(40):
        for _ in range(r.randrange(1, 30)):
            rows.append((g if g else None, r.choice("ab"), r.choice(sizes[: 1 + g % 5])(), r.randrange(1, 4)))
    tx = spark.createDataFrame([(*x, i) for i, x in enumerate(rows)] + [(99, "a", None, 1, -1)], "g int, h string, amount decimal(15,2), times int, id int")
    for times in (None, "times"):
        want = {}
        for g, h, a, n in rows:
            want.setdefault((g, h), []).extend([a] * (n if times else 1))
        got = {(x.g, x.h): x["median"] for x in group_medians(tx, ("g", "h"), times).collect()}
        assert got == {k: D(median(v)).quantize(D("0.001")) for k, v in want.items()}
    each = with_group_median(tx, ("g", "h")).select("g", "h", "id", "median").collect()
    assert len(each) == len(rows) + 1 and {x["median"] for x in each if x.id == -1} == {None}


def test_postings_near_rules_without_pairs(spark):
    """Rules and postings of a busy merchant are ordered, not joined to each other."""
    r = random.Random(4)
    rules = [(m, D(lo) / 100, D(lo + r.randrange(40)) / 100) for m in "abcdefgh" for lo in (r.randrange(-100, 4000) for _ in range(3))]
    rows = [(m, D(r.randrange(-100, 6000)) / 100) for m in "abcdefgh" for _ in range(2)] + [("a", D(5)), ("a", None), (None, D(1))]
    df = spark.createDataFrame([(f"r{i}", *x, "CLP", 7, "weekly", True, 0.5, date(2024, 1, 9), 3) for i, x in enumerate(rules)], "id string, merchant_id string, amount_min decimal(15,2), amount_max decimal(15,2), currency string, period_days int, period_label string, is_active boolean, confidence double, last_seen_date date, occurrences int")
    tx = spark.createDataFrame([(m, a, "CLP", date(2024, 1, 3)) for m, a in rows], "merchant_id string, amount decimal(15,2), currency string, date date")
    got = recurring_in_period(tx, df, date(2024, 1, 1))
    met = {m for m, lo, hi in rules for k, a in rows if k == m and a is not None and lo * D("0.85") <= a <= hi * D("1.15")}
    assert {x.merchant_id for x in got.collect()} == met and met and len(met) < 8
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert all("_size" not in x for x in text.split("\n") if "Join" in x)
