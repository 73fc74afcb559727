"""Unions of equally partitioned frames must not lose or double keys."""

from jobloom.operators import grounding
from jobloom.queries.audits import entries

SF = "/root/testdata/sf0.001"


def test_nothing_is_invented_by_dropping_rows(spark):
    changes = grounding.lost_and_invented_sections(*entries(spark, SF)).groupBy("change").count().collect()
    assert [r.change for r in changes] == ["lost"]


def test_a_blank_heading_names_no_section(spark):
    rows = lambda *headings: spark.createDataFrame([(1, h) for h in headings], "doc_id long, heading string")
    found = lambda **how: sorted((r.section, r.change) for r in grounding.lost_and_invented_sections(rows("Skills", "Awards"), rows("Skills", " "), **how).collect())
    assert found() == [("awards", "lost")]
    assert found(unnamed=True) == [("", "invented"), ("awards", "lost")]


def test_union_then_group(spark):
    from pyspark.sql import functions as F

    from jobloom.runtime import union_all

    df = spark.range(2_000).select((F.col("id") % 50).alias("k"), "id")
    a, b = df.repartition(8, "k"), df.repartition("k").groupBy("k", "id").count().select("k", "id")
    both = union_all([union_all([a, b]), union_all([b, a])]).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert both.count() == 50 and both.filter("n <> 160").count() == 0
