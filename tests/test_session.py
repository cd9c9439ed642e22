import time
from pathlib import Path

from pyspark.sql import functions as F

from relrank.session import FREE_SHUFFLES, materialize, scratch


def _shuffle_files(spark) -> set[str]:
    """Shuffle data of the session, below the folders that its block manager has named."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {str(f) for folder in folders for f in Path(folder).rglob("shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    held = _shuffle_files(spark)
    set_before = spark.conf.get(FREE_SHUFFLES, None)
    rows = spark.range(20000).repartition(3, F.rand(seed=1))
    written = materialize(rows, "freed")
    for _ in range(50):
        left = _shuffle_files(spark) - held
        if not left:
            break
        time.sleep(0.1)
    assert not left
    assert written.count() == 20000 and rows.count() == 20000
    assert spark.conf.get(FREE_SHUFFLES, None) == set_before


def test_a_block_deletes_the_tables_that_it_does_not_keep(spark):
    with scratch(spark, "outer"):
        with scratch(spark, "inner"):
            gone = materialize(spark.range(5), "gone").inputFiles()
            inner = materialize(spark.range(6), "inner")
        assert not any(Path(f.removeprefix("file://")).exists() for f in gone)
        assert inner.count() == 6
        outer = materialize(spark.range(7), "outer")
    assert not any(Path(f.removeprefix("file://")).exists() for f in inner.inputFiles())
    assert outer.count() == 7
