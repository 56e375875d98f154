import pytest
from pyspark.sql import functions as F

from claimspan.operators import structured as X
from claimspan.streaming import claims_stream as S


@pytest.mark.parametrize(
    "text, want",
    [
        ("Macaulay Culkin is not dead.", ("Macaulay Culkin", "is", "not dead")), ("Militants beheaded hostage as warning.", ("Militants", "beheaded", "hostage")),
        ("Alice posted video claiming to show fraud.", ("Alice", "posted", "video")), ("Nothing here", ("Nothing", None, None)), (None, (None, None, None)), ("", (None, None, None)),
    ],
)
def test_slots(spark, text, want):
    r = X.structured_slots(spark.createDataFrame([(text, "clash")], "text string, other string")).first()
    assert (r.subject, r.relation, r.object) == want


def test_qualifier(spark):
    r = X.structured_slots(spark.createDataFrame([("Viral news: Bob was fined in 1999",)], "text string")).first()
    assert r.qualifier == "Viral news" and r.object == "fined" and r.full


def test_stance_pipeline_learns(spark):
    rows = [(f"good true word{i % 7}", "pro") for i in range(60)] + [(f"bad false word{i % 7}", "con") for i in range(20)] + [(None, "pro"), ("x", None)]
    data = X.stance_rows(spark.createDataFrame(rows, "claim string, label_name string"), "claim", "label_name")
    scored = X.stance_pipeline(1 << 10).fit(data).transform(data)
    assert scored.where("label_index <> predicted").count() == 0 and scored.count() == 80


def test_stream_equals_batch_and_drops_repeats(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/retrieval_json.parquet")
    source = tmp_path / "in"
    rows.union(rows.limit(5)).write.parquet(str(source))
    stream = spark.readStream.schema(rows.schema).parquet(str(source))
    query = S.run_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = S.labelled_pairs(rows)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0
    assert S.late_counts(rows, "exported_at", "sample_id").count() > 0


@pytest.mark.parametrize(
    "text, relation",
    [
        ("Macaulay Culkin is not dead.", "is"), ("The star isn't gone, he said", "is"), ("'It was fake', Alice denied", "denied"), ('"It was fake"', "was"), ("Bob re-open Monday", "open"), ("The man, not dead, sleeps", "is"),
        ("He said \"police have said so\" and led", "said"), ("“They have it” says Bob", "says"), ("Nothing here", None), ("", None), (None, None), ("Wasn’t it has-been", "was"),
    ],
)
def test_relations(spark, text, relation):
    found = spark.createDataFrame([(text,)], "t string").select(X.found_relation(F.col("t")).alias("f")).first().f
    assert (found.relation if found else None) == relation
