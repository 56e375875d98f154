"""Session helpers."""

from types import SimpleNamespace

import pytest

from claimspan.runtime import shared_folder, spread


def test_a_cluster_must_name_its_checkpoint_folder():
    conf = SimpleNamespace(get=lambda name: None)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://head:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context))
    kept = SimpleNamespace(getCheckpointDir=lambda: "hdfs:///set")
    assert shared_folder(SimpleNamespace(sparkContext=kept)) is None


def test_only_small_tables_are_dealt_out(spark):
    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, cores + 3)
    assert spread(one).rdd.getNumPartitions() == cores and spread(many) is many
    assert sorted(r.id for r in spread(one).collect()) == list(range(100)) and spread(one.limit(0)).count() == 0
