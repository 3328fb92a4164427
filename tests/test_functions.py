"""Keys, rounding, statistics: golden values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardspark.errors import UserInputError
from hazardspark.functions.keys import MISSING_TERM, code_key_of, covariate_key, covariate_key_of, literal_key, term_key, term_key_of, to_number
from hazardspark.functions.rounding import round_figures, round_figures_np
from hazardspark.functions.stats import chi_square_tail, two_sided_p

NCIT = "http://ncicb.nci.nih.gov/xml/owl/EVS/Thesaurus.owl#"


def test_term_keys_of_python_values():
    assert term_key_of(f"<{NCIT}C37987>") == term_key_of(f" {NCIT}C37987 ") == "ncit:C37987"
    assert term_key_of("http://snomed.info/id/419099009") == "sct:419099009"
    assert term_key_of(1) == term_key_of("1") == term_key_of(" 1.0 ") == term_key_of(True) == 1.0
    assert [term_key_of(x) for x in (None, math.nan, math.inf, "", "<>", " ")] == [None] * 6
    assert term_key_of(NCIT) == NCIT and term_key_of("inf") == "inf" and term_key_of("1_0") == "1_0" and term_key_of("0x1") == "0x1"
    assert covariate_key_of(MISSING_TERM) is None and covariate_key_of(f"{NCIT}C54031") is None
    assert code_key_of("inf") == math.inf and code_key_of("nan") is None and code_key_of(" M ") == "M" and code_key_of("1e2") == 100.0


def test_namespaces_of_the_session(spark):
    spark.conf.set("spark.hazard.namespaces", "http://example.org/own#=own, http://example.org/two/=two")
    try:
        assert term_key_of("<http://example.org/own#C1>") == "own:C1"
        got = spark.range(1).select(term_key(F.lit(" http://example.org/two/x "), "string").alias("k"), term_key(F.lit(f"{NCIT}C1"), "string").alias("n")).first()
        assert (got.k, got.n) == ("s:two:x", "s:ncit:C1")
        spark.conf.set("spark.hazard.namespaces", "no prefix")
        with pytest.raises(UserInputError):
            term_key_of("x")
    finally:
        spark.conf.unset("spark.hazard.namespaces")
    assert term_key_of("http://example.org/own#C1") == "http://example.org/own#C1"


TEXTS = [f"<{NCIT}C37987>", f" {NCIT}C16576 ", "http://snomed.info/id/419", "1", " 1.0 ", "1.", ".5e1", "+3", "-0", "1e7", "1e-5", "123456789.25", "M", "inf", "NaN", "1.0d", "0x1", "", "<>", " ", None, NCIT, "< 7 >", "1e400"]


def test_spark_keys_equal_python_keys(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", term_key(F.col("t"), "string").alias("k")).orderBy("i").collect()
    for text, row in zip(TEXTS, got):
        if text != "1e400":
            assert row.k == literal_key(text), text
    numbers = [0.0, -0.0, 1.0, 0.1, 123.456, 1e6, 1e7, 12345678.9, 1e-3, 1e-4, 9.99e-4, 1e21, -2.5e-10, 3.0, math.nan, math.inf]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", term_key(F.col("x"), "double").alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [literal_key(x) for x in numbers]
    one = spark.range(1).select(covariate_key(F.lit(f"<{NCIT}C54031>"), "string").alias("k")).first()
    assert one.k is None


def test_numbers_of_text(spark):
    rows = [("365",), ("120.5",), (" 7 ",), (f"{NCIT}C54031",), ("ncit:C54031",), (None,), ("",), ("1.0d",), ("2020-01-01",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(to_number(F.col("t"), "string")).collect()]
    assert got == [365.0, 120.5, 7.0] + [None] * 6
    got = [r[0] for r in spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "x double").select(to_number(F.col("x"), "double")).collect()]
    assert got == [1.0, None, math.inf]


def test_rounding(spark):
    assert np.allclose(round_figures_np([123.456, 0.0123456, 0], 3), [123, 0.0123, 0], rtol=1e-15)
    assert round_figures_np(-987.654, 3) == -988 and round_figures_np(0.00123456, 3) == pytest.approx(0.00123)
    assert np.allclose(round_figures_np([123.4567890123, 0.0123456789012, -987.6543210987], 7), [123.4568, 0.01234568, -987.6543], rtol=1e-15)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-8, 9, 500), [0.0, 0.5, 1.5, 2.5, 25.0, 35.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    for figures in (2, 4, 7):
        got = [r[1] for r in df.select("i", round_figures(F.col("v"), figures)).orderBy("i").collect()]
        assert got == list(round_figures_np(values, figures))
    assert [r[0] for r in df.limit(3).select(round_figures(F.col("v"), F.lit(None).cast("int")) == F.col("v")).collect()] == [True] * 3


def test_tails():
    assert two_sided_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12) and two_sided_p(0) == 1
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert chi_square_tail(-1e-9, 2) == 1 and chi_square_tail(1e5, 3) == 0
    assert math.isnan(two_sided_p(math.nan))
