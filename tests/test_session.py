"""What a stored table leaves behind."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from touchline.session import CLEANUP, cut_lineage


def test_a_stored_table_keeps_no_shuffle_files(spark):
    blocks = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath())
    files = lambda: {p for p in blocks.rglob("shuffle_*.data")}
    before, former = files(), spark.conf.get(CLEANUP, None)
    rows = cut_lineage(spark.range(10_000).repartition(4, F.col("id")).groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.count() == 7 and spark.conf.get(CLEANUP, None) == former
    left = lambda: sum(p.stat().st_size for p in files() - before if p.exists())
    # Files go on the side; what is left is of the count above, one row a partition.
    until = time.time() + 10
    while left() >= 2_000 and time.time() < until:
        time.sleep(0.1)
    assert left() < 2_000
