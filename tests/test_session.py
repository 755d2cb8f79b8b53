import pytest

from cohortshare.session import scratch_path, shared_dir


def test_scratch_goes_under_the_checkpoint_dir(spark, tmp_path):
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    target = str(tmp_path / "shared")
    sc.setCheckpointDir(target)
    try:
        base = shared_dir(spark)
        assert f"{target}/" in base          # Spark adds a unique subfolder inside the target
        p = scratch_path(spark, "x")
        assert p.startswith(base) and p != scratch_path(spark, "x")
    finally:
        if before:
            sc.setCheckpointDir(before)


def test_spread_only_small_inputs(spark):
    from cohortshare.session import spread
    par = spark.sparkContext.defaultParallelism
    big = spark.range(0, 1000, 1, numPartitions=par * 4)
    assert spread(big) is big                               # already split: no shuffle added
    small = spark.range(0, 1000, 1, numPartitions=1)
    assert spread(small).rdd.getNumPartitions() == par


def test_no_machine_local_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
