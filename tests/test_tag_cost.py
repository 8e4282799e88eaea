"""Tags of a line are looked at once, not once more for each of them."""

from pyspark.sql import functions as F

from locus.functions import codecs


def test_fields_are_matched_once_a_row(spark):
    rows = spark.createDataFrame([(["NM:i:1", "x", "RG:Z:a:b", "NM:i:2", "XA:A:q"],), ([],), (None,)], "f array<string>")
    found = rows.select(codecs.tags_map(F.col("f")).alias("tags"))
    assert [r.tags for r in found.collect()] == [{"NM": "i:1", "RG": "Z:a:b", "XA": "A:q"}, {}, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == 1
    head = spark.createDataFrame([("@SQ\tSN:a\tLN:5\tSN:b",)], "value string").select(codecs.header_fields(F.col("value")).alias("fields"))
    assert head.first().fields == {"SN": "a", "LN": "5"} and head._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
