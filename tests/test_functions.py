"""Functions against published values and brute force."""

import random
from decimal import ROUND_FLOOR, ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.functions import exact, special
from assaykit.functions import text as tx

# Printed tables: statistic, degrees of freedom, p.
KNOWN = [("t", 2.086, 20, 0, 0.05), ("t", 12.706, 1, 0, 0.05), ("t", 2.576, 1e6, 0, 0.01), ("chi2", 3.841, 1, 0, 0.05), ("chi2", 18.307, 10, 0, 0.05), ("F", 4.351, 1, 20, 0.05), ("F", 3.316, 2, 30, 0.05), ("z", 1.95996, 0, 0, 0.05), ("r", 0.5, 10, 0, 0.0978546)]


@pytest.mark.parametrize(("kind", "stat", "df1", "df2", "p"), KNOWN)
def test_tail_probabilities(kind, stat, df1, df2, p):
    got = special.p_value(np.array([kind]), np.array([stat]), np.array([float(df1)]), np.array([float(df2)]), np.array([2.0]))[0]
    assert got == pytest.approx(p, abs=6e-5)


def test_incomplete_functions_keep_their_identities():
    a, b, x = np.array([0.5, 2.0, 7.5]), np.array([3.0, 0.5, 7.5]), np.array([0.1, 0.9, 0.5])
    assert special.betainc(a, b, x) == pytest.approx(1 - special.betainc(b, a, 1 - x), abs=1e-12)
    assert special.gammaincc(np.ones(3), x) == pytest.approx(np.exp(-x), abs=1e-12)
    assert list(special.betainc(1.0, 1.0, np.array([0.0, 0.25, 1.0]))) == pytest.approx([0, 0.25, 1])
    assert np.isnan(special.p_value(np.array(["r"]), np.array([1.0]), np.array([5.0]), np.zeros(1), np.ones(1)))[0]


def brute_grim(m, d, g):
    if d < 1 or g >= 10**d:
        return "no-power"
    mean, unit = Decimal(m).scaleb(-d), Decimal(1).scaleb(-d)
    low = int((mean * g).to_integral_value(rounding=ROUND_FLOOR))
    for k in range(low - 1, low + 3):
        if any((Decimal(k) / g).quantize(unit, rounding=r) == mean for r in (ROUND_HALF_UP, ROUND_HALF_EVEN)):
            return "consistent"
    return "inconsistent"


def test_grim_equals_decimal_arithmetic(spark):
    rng = random.Random(3)
    cases = [(rng.randint(0, 999), d, rng.randint(1, 120)) for _ in range(3000) for d in (rng.choice([0, 1, 2, 3]),)]
    df = spark.createDataFrame(cases, "m long, d int, g long").select("*", exact.grim_verdict(F.col("m"), F.col("d"), F.col("g")).alias("v"))
    assert all(r["v"] == brute_grim(r["m"], r["d"], r["g"]) for r in df.collect())
    one = spark.createDataFrame([(347, 2, 20)], "m long, d int, g long").select(exact.grim_nearest(F.col("m"), F.col("d"), F.col("g")).alias("n")).first()
    assert one["n"] == [345, 350]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


@pytest.mark.parametrize(
    ("expr", "want"),
    [
        (lambda: tx.decimal_text(lit(" 3,47 ")), "3.47"),
        (lambda: tx.decimals(lit("93.80")), 2),
        (lambda: tx.decimals(lit("12")), 0),
        (lambda: tx.normalize_doi(lit(" https://doi.org/DOI:10.1/X ")), "10.1/x"),
        (lambda: tx.year_digits(lit("(c) 2019a")), "2019"),
        (lambda: tx.surname(lit("van der Berg, Anna")), "berg"),
        (lambda: tx.surname(lit("Ludwig van Beethoven")), "beethoven"),
        (lambda: tx.surname(lit(None).cast("string")), ""),
        (lambda: tx.canonical(lit("LearningRate")), "learning_rate"),
        (lambda: tx.canonical(lit("--num-epochs")), "epochs"),
        (lambda: tx.canonical(lit("Top P")), "top_p"),
        (lambda: tx.quantity(lit("trained for 1.5k steps on 8 GPUs")), 1500.0),
        (lambda: tx.quantity(lit("no number")), None),
        (lambda: tx.role_of(lit("4.2 Experimental Setup")), "methods"),
        (lambda: tx.role_of(lit("Data availability")), ""),
        (lambda: tx.role_of(lit("IV. Results and Discussion")), "results"),
        (lambda: tx.arxiv_id(lit("none"), lit("arXiv:2101.12345v2")), "2101.12345"),
        (lambda: tx.reason_code(lit("Compression RATIO too high")), "bomb"),
        (lambda: tx.located(F.array(lit("a"), lit("a"), lit("b"), lit("c")), lit("x")), "a <-> b <-> +1 more <-> x (absent)"),
        (lambda: tx.relatedness(lit("of it"), lit("x")), 1.0),
        (lambda: F.array_sort(tx.number_texts(lit("94.20 and 94.2, 7, 2019, 010.50"))), ["10.5", "94.2"]),
        (lambda: tx.jaccard(F.array(lit("a")), F.array().cast("array<string>")), 0.0),
        (lambda: tx.overlap(F.array(lit("a")), F.array().cast("array<string>")), 1.0),
        (lambda: tx.fold(lit("Ströße ÆØ é")), "Strosse ÆO e"),
        (lambda: tx.margin(lit(1.0), lit(0.0)), None),
    ],
)
def test_text_functions(spark, expr, want):
    assert value(spark, expr()) == want


def test_sentences_keep_every_character(spark):
    text = "One, e.g. this. Two et al. (2019) said so! (Three?) Yes.  Fig. 2 shows it"
    got = value(spark, tx.masked_sentences(lit(text)))
    assert "".join(got) == text
    assert [s.strip() for s in got] == ["One, e.g. this.", "Two et al. (2019) said so!", "(Three?) Yes.", "Fig. 2 shows it"]


def test_fingerprints_ignore_prose(spark):
    f = lambda m: value(spark, tx.fingerprint(lit("r/x"), lit(m)))
    assert f("mean 3.47 of 20") == f("the mean 3.47 over 20") != f("mean 3.48 of 20") and len(f("x")) == 12


def test_wilson(spark):
    low, high = exact.wilson(lit(8), lit(10))
    assert value(spark, low) == pytest.approx(0.4902, abs=1e-4) and value(spark, high) == pytest.approx(0.9433, abs=1e-4)
    low, high = exact.wilson(lit(0), lit(0))
    assert (value(spark, low), value(spark, high)) == (0.0, 1.0)
