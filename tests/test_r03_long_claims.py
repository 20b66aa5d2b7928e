"""Findings of round 3: claims of any length meet facts by one reading (F12)."""

import time

from pyspark.sql import functions as F

from litspark.functions import text
from litspark.operators.claims import conflicts


def test_a_long_claim_is_read_once(spark):
    long = spark.range(1).select(F.lit(1).alias("source_id"), F.lit(0).alias("claim_index"), F.concat(F.repeat(F.lit("abcdefg\n\U0001f600x"), 50_000), F.lit(" the sky is green")).alias("claim"))
    facts = spark.createDataFrame([(1, "sky is green"), (2, "z\U0001f600"), (3, "\U0001f600x"), (4, "g\n\U0001f600x")], "fact_id long, text string")
    began = time.time()
    assert {r.fact_id for r in conflicts(long, facts).collect()} == {1, 3, 4}
    assert time.time() - began < 60


def test_sections_equal_each_section(spark):
    docs = ["", None, "# Data", "x\n \t# My Methods\n\n a\n#b\nc\n## dataset and METHOD\nd\n", "## results\n#\nz", "method\nno heading"]
    lists = [["method"], ["data", "corpus"], ["results"]]
    df = spark.createDataFrame([(d,) for d in docs], "v string")
    for filled in (False, True):
        each = F.array(*[text.section(F.col("v"), words, filled) for words in lists])
        rows = df.select("v", text.sections(F.col("v"), lists, filled).alias("a"), each.alias("b")).collect()
        assert all(r.a == r.b for r in rows)
        got = {r.v: r.a for r in rows}
        assert got[None] == ["", "", ""] and got["x\n \t# My Methods\n\n a\n#b\nc\n## dataset and METHOD\nd\n"] == ["a", "d", ""]
        assert got["## results\n#\nz"] == ["", "", "#\nz" if filled else ""]
