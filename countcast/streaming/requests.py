from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from countcast.plans.score import answered, reply, score
from countcast.spec import CountSpec


# State in files of the checkpoint and on the executors' disks, with a bounded cache: request numbers
# in the heap (Spark's default) take memory in proportion to the requests. A stream that is
# restarted keeps the kind of state that its checkpoint has.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = {
    PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk, unless the session names a provider of its own."""
    before = {} if spark.conf.get(PROVIDER, None) else {k: spark.conf.get(k, None) for k in ON_DISK}
    for k in before:
        spark.conf.set(k, ON_DISK[k])
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def request_stream(
    spark: SparkSession, folder: str, spec: CountSpec, format: str = "parquet", files_per_batch: int | None = None, timed: bool = False
) -> DataFrame:
    """Requests from files dropped into a folder. ``files_per_batch`` bounds a batch's size;
    ``timed`` requests carry ``sent_at``, the time they were sent."""
    schema = spec.request_schema()
    if timed:
        schema = T.StructType([*schema.fields, T.StructField("sent_at", T.TimestampType())])
    reader = spark.readStream.format(format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def unique_requests(requests: DataFrame, within: str = "1 hour") -> DataFrame:
    """Timed requests without those seen before: of equal ``request_id`` only the first is kept.

    A request may be sent again as late as ``within`` after the first time. Numbers seen are state
    in the checkpoint, so this holds across restarts; they are forgotten once the watermark has
    passed, so the state holds one such span of requests, which ``start_scoring`` keeps on disk.
    """
    return requests.withWatermark("sent_at", within).dropDuplicatesWithinWatermark(["request_id"])


def score_stream(requests: DataFrame, spec: CountSpec, model: PipelineModel) -> DataFrame:
    """The batch scoring plan on a stream. It keeps no state, so batches are independent."""
    return reply(score(requests, spec, model), spec)


def answer_stream(requests: DataFrame, spec: CountSpec, model: PipelineModel) -> DataFrame:
    """As ``score_stream``, but every request comes back: with a prediction or a reason."""
    return reply(answered(requests, spec, model), spec)


def start_scoring(
    replies: DataFrame, output: str, checkpoint: str, format: str = "parquet", once: bool = False
) -> StreamingQuery:
    """Append replies to files. The file sink's log and the checkpoint make each request's
    reply appear exactly once across restarts. ``once`` drains what is there and stops."""
    writer = (
        replies.writeStream.format(format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    with state_on_disk(replies.sparkSession):  # a stream takes its settings when it starts
        return writer.start(output)
