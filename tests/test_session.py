from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexcorpus import session
from lexcorpus.operators import sampling
from lexcorpus.sources.readers import spread_small


def test_tables_are_written_to_the_scratch_folder(spark):
    out = session.materialize(spark.range(5), "t")
    assert sorted(r.id for r in out.collect()) == list(range(5))
    assert all(session.scratch_dir(spark).removeprefix("file:") in f for f in out.inputFiles())


class FakeSession:
    """A session whose checkpoint folder is not configured."""

    def __init__(self, master, conf=None):
        self.sparkContext, self.conf = self, self
        self.master, self.value, self.folder = master, conf, None

    def get(self, key, default):
        return self.value if key == session.CHECKPOINT_CONF and self.value else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_folder():
    assert session.scratch_dir(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    local = FakeSession("local[2]")
    folder = session.scratch_dir(local)
    assert Path(folder).is_dir() and session.scratch_dir(local) == folder
    with pytest.raises(RuntimeError, match="shared folder"):
        session.scratch_dir(FakeSession("spark://host:7077"))


def test_small_scans_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    assert spread_small(one, "id").rdd.getNumPartitions() == 16
    many = spark.range(0, 100, 1, 20)
    assert spread_small(many, "id").rdd.getNumPartitions() == 20
    large = spark.range(0, 1 << 30, 1, 2)  # by its size, not by its splits
    assert spread_small(large, "id").rdd.getNumPartitions() == 2


def test_intermediate_tables_are_deleted(spark):
    with session.intermediates(spark):
        inside = session.materialize(spark.range(3), "inside")
        folder = Path(inside.inputFiles()[0].removeprefix("file:")).parent
        assert folder.is_dir()
    assert not folder.exists()


def test_a_hot_key_does_not_change_the_size(spark):
    # a third of all rows carries one key
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    df = spark.range(3000).select(hot.alias("id"), F.col("id").alias("row"))
    for n in (10, 500, 1500, 2500):
        assert sampling.sample_exact(df, n).count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_seed_changes_the_sample(spark, seed):
    df = spark.range(1000)
    a = {r.id for r in sampling.sample_exact(df, 50, seed).collect()}
    b = {r.id for r in sampling.sample_exact(df, 50, seed + 10).collect()}
    assert len(a) == len(b) == 50 and a != b
