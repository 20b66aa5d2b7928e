"""Ports of any length (F6)."""

import pytest
from pyspark.sql import functions as F

from litspark.functions import urls


def one(spark, value, rule):
    return spark.createDataFrame([(value,)], "v string").select(rule(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("port", ["8080", "99999", "108000", "12345678901"])
def test_ports_of_any_length(spark, port):
    assert one(spark, f"http://x.org:{port}/", urls.url_policy).reason == f"port {port} not allowed"
