"""Failure labels of rows without decisive result."""

import json

from claimspan.plans import reports


def test_noisy_evidence_is_a_failure_label(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/benchmark_rows.parquet").schema
    query = "The harbour council has approved a new bridge for the northern district"
    good = "The council of the northern district has approved the new harbour bridge project."

    def row(sample, *evidence, pairs=1):
        claims = [{"claim_id": "q", "text": query, "relation": "approved", "object": "bridge", "source_metadata": {"role": "query"}}]
        claims += [{"claim_id": f"e{i}", "text": t, "source_doc_id": "d", "source_chunk_id": c, "source_metadata": {"role": "retrieved_evidence"}} for i, (c, t) in enumerate(evidence)]
        return {"sample_id": sample, "query": query, "cross_source_pair_count": pairs, "claims": claims, "cross_source_nli_results": [{"label": "neutral"}]}

    rows = [
        row("clean", ("c1", good), ("c2", good)),
        row("flagged", ("c1", good), ("c2", "Harbour bridge")),
        row("mean", ("c1", "According to the council, " + good)),
        row("diluted", ("c1", "According to the council, " + good), ("c2", good)),
        row("one chunk", ("c1", "Harbour bridge"), ("c1", good)),
        row("no evidence"),
        row("no pairs", ("c1", "Harbour bridge"), pairs=0),
    ]
    (tmp_path / "rows.json").write_text("\n".join(map(json.dumps, rows)))
    spark.read.schema(schema).json(str(tmp_path / "rows.json")).write.parquet(str(tmp_path / "benchmark_rows.parquet"))
    noisy = {r.sample_id: r.noisy for r in reports._noisy_samples(spark.read.parquet(str(tmp_path / "benchmark_rows.parquet"))).collect()}
    assert noisy == {"clean": False, "flagged": True, "mean": True, "diluted": False, "one chunk": False, "no pairs": True}
    got = {r.failure: r.rows for r in reports.failure_labels(spark, str(tmp_path)).collect()}
    assert got == {"EVIDENCE_STILL_NOISY": 2, "EVIDENCE_OK_BUT_NOT_COMPARABLE": 4, "NO_CROSS_SOURCE_SIGNAL": 1}
