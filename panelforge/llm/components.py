"""Connected components of links between keys, as rounds of joins over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Links for which a table of a round gets one file; it gets two for each core of the session at least.
PART_LINKS = 20_000


def connected(links: DataFrame) -> DataFrame:
    """Rows (key, comp) for every key of links (a, b): comp is the smallest key of its component.

    A round takes the least label among neighbours, then the label of that label, so long chains halve. Each round's
    labels are written to the shared folder. A star's hub, and a label that many keys have, are hot keys of the two
    joins; they meet a broadcast of bounded size, see split_join(). No links give no rows. links should be stored, as they are
    counted: a table gets as many files as they ask for, not one for each shuffle partition.
    """
    parts = max(2 * links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // PART_LINKS))

    def written(df: DataFrame, name: str) -> DataFrame:
        return common.stored(df.coalesce(parts), name)

    both = written(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("comp")), "labels")
    while True:
        near = common.split_join(both, labels.withColumnRenamed("key", "b"), "b", written=True).groupBy(F.col("a").alias("key")).agg(F.min("comp").alias("near"))
        low = written(labels.join(near, "key").select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("next")), "labels")
        jump = labels.select(F.col("key").alias("next"), F.col("comp").alias("far"))
        step = written(common.split_join(low, jump, "next", written=True).select("key", "old", F.least("next", "far").alias("comp")), "labels")
        labels = step.select("key", "comp")
        if step.filter("old <> comp").isEmpty():
            return labels
