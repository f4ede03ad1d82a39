"""Numbers are derived from any two numbers of the ground, however many it has."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from papyrine.operators import facts, rewrites
from papyrine.plans import rewrite_queries


def test_all_numbers_of_a_ground_are_partners(spark):
    # 37 % of 7,300 is only found with the two largest of 26 numbers, which are 4,599 and 7,300.
    text = "Counts were " + " and ".join(str(1000 + i) for i in range(24)) + " then 4599 from 7300 in all"
    rows = spark.createDataFrame([(1, text, text + " by 37%")], "id long, text string, rewrite string")
    assert rewrites.number_gate(rows).first().accepted and not rewrites.number_gate(rows, partners=24).first().accepted
    assert "[1:24]" not in rewrite_queries.SQL["gate_matrix"]
    long = " ".join(str(10**9 + i) for i in range(20000))
    rows = spark.createDataFrame([(1, long, "by 4321 and 1")], "id long, text string, rewrite string")
    assert tuple(facts.check_numbers(rows, "rewrite", "text").select("n_derived", "n_unsupported").first()) == (1, 1)


def test_halving_finds_what_all_pairs_show(spark):
    def half_up(x):
        return math.floor(x) + (x - math.floor(x) >= 0.5)

    def by_pairs(v, ground):
        pairs = [(a, b) for a in ground for b in ground if a > b]
        return any(abs(half_up((a - b) / a * 100) - v) <= 1 or abs((a - b) / a * 100 - v) <= 0.5 or abs(a / b - v) <= 0.15 or abs(half_up(a / b) - v) < 1e-9 for a, b in pairs)

    random.seed(3)
    cases = []
    for i in range(400):
        ground = sorted({round(random.choice([1, 10, 1000]) * random.random() * random.choice([1, 100]), random.choice([0, 1, 6])) for _ in range(random.choice([0, 1, 2, 3, 5, 9]))} - {0.0})
        of = random.choice([round(random.random() * 100, random.choice([0, 1])), float(random.randint(0, 12)), random.choice([37.0, 4321.0, 0.0, 1.15, 0.85])])
        cases.append((i, of, ground))
    rows = spark.createDataFrame(cases, "id long, v double, g array<double>")
    got = {r.id: r.x for r in rows.select("id", facts.derived(F.col("v"), F.col("g")).alias("x")).collect()}
    assert got == {i: by_pairs(v, g) for i, v, g in cases} and 20 < sum(got.values()) < 380
