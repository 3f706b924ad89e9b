from pathlib import Path

from lorequarry import scratch


def test_spool_and_release(spark):
    where = scratch.shared_dir(spark)
    assert where == spark.conf.get("spark.checkpoint.dir")
    df = scratch.spool(spark.range(5), "t")
    assert df.count() == 5
    path = Path(scratch._written[spark.sparkContext.applicationId][-1].removeprefix("file:"))
    assert list(path.glob("*.parquet"))
    scratch.release(spark)
    assert not path.exists()
