"""How an input is dealt to the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes, as the optimizer estimates them, below which an input is dealt out; the limit does not grow with the cluster.
SMALL = 128 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deals an input of less than SMALL bytes out to all cores by the keys; leaves a larger one as it is.

    A file is read by one task for each row group, so a single file of a few MB would keep one core busy. What is
    shuffled for that is bounded, however many cores there are.
    """
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()  # there is no public form of it
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if int(str(estimate)) < SMALL else df
