"""Counts of the stance baseline."""

import math

from claimspan.operators import structured as X


def test_repeated_terms_count_sublinearly(spark, tmp_path):
    rows = [("good", "pro"), ("good good good", "pro"), ("bad", "con"), ("bad bad", "con"), ("", "con")]
    data = X.stance_rows(spark.createDataFrame(rows, "claim string, label_name string"), "claim", "label_name")
    model = X.stance_pipeline(1 << 10).fit(data)
    got = {r.claim: sorted(round(float(x), 6) for x in r.dampened.values) for r in model.transform(data).collect()}
    log = lambda n: round(1 + math.log(n), 6)
    assert got == {"good": [1.0], "good good good": [log(2), log(3)], "bad": [1.0], "bad bad": [1.0, log(2)], "": []}
    model.write().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model")).transform(data)
    assert [r.predicted for r in again.orderBy("claim").collect()] == [r.predicted for r in model.transform(data).orderBy("claim").collect()]
