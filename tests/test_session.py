from unittest.mock import MagicMock

import pytest

from traceflow.session import checkpoint, spread


def fake(master, configured=None, current=None):
    df = MagicMock()
    context = df.sparkSession.sparkContext
    context.master = master
    context.getCheckpointDir.return_value = current
    df.sparkSession.conf.get.return_value = configured
    return df, context


def test_checkpoint_uses_the_named_folder():
    df, context = fake("spark://host", configured="/shared")
    assert checkpoint(df) is df.checkpoint.return_value
    context.setCheckpointDir.assert_called_once_with("/shared")


def test_checkpoint_keeps_a_folder_that_is_set():
    df, context = fake("spark://host", current="/shared/app")
    checkpoint(df)
    context.setCheckpointDir.assert_not_called()


def test_a_cluster_never_gets_a_local_folder():
    df, context = fake("spark://host")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint(df)
    context.setCheckpointDir.assert_not_called()


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=cores)
    assert spread(few, "id").rdd.getNumPartitions() > 1
    assert spread(few, "id").count() == 100
    assert spread(many, "id") is many
