"""Row-local feature blocks on a stream.

The reference has no streaming operator; what carries over is a property:
every row-local measure in ``quire.functions`` is a plain Catalyst
expression, so the same projection runs on ``readStream`` input. Stateful
group statistics stay batch jobs (their inputs are whole tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quire.session import scratch_path

FeatureFn = Callable[[], dict[str, Column]]


def feature_projection(df: DataFrame, key: str, features: dict[str, Column]) -> DataFrame:
    """The projection shared by the batch and the streaming path."""
    return df.select(key, *[c.alias(n) for n, c in features.items()])


def stream_features(spark: SparkSession, source: str, schema: StructType, key: str,
                    features: dict[str, Column], sink: str, fmt: str = "parquet",
                    available_now: bool = True) -> StreamingQuery:
    """Read new files of ``source`` as a stream, apply the row-local
    features and append them to ``sink`` (exactly-once file sink with its
    own checkpoint under the shared checkpoint folder)."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    out = feature_projection(stream, key, features)
    writer = (out.writeStream.format("parquet").option("path", sink)
              .option("checkpointLocation", scratch_path(spark, "stream-ckpt")).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
