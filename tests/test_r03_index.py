"""Findings of round 3: what a stored index shuffles."""

import uuid

from litspark.operators.shared import shared_dir
from litspark.operators.token_index import TokenIndex


def test_a_search_shuffles_its_postings_once(spark):
    index = TokenIndex(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}", buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    index.add(frame([(1, "red fox"), (1, "red hen"), (2, "fox"), (3, "red red")]), "id", ["name"])
    index.merge()
    index.add(frame([(2, "red"), (4, "fox red")]), "id", ["name"])
    index.remove(frame([(3, "")]).select("id"))
    found = index.search("fox red hen")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r.id, r.words) for r in found.collect()} == {(1, 3), (2, 1), (4, 2)}
    assert index.postings().count() == 6
