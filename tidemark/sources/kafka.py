"""S1/S2 and the Kafka side of K3/S6: Spark's own Kafka connector.

These need the ``spark-sql-kafka`` package on the classpath and a reachable
broker; neither exists in the test environment, so only the option builders
are unit-tested. The replay topic in ``tidemark.sources.topic`` has the same
schema and stands in for a broker everywhere else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.envelope import TOPIC
from tidemark.streaming.checkpoint import Position, offsets_read


def bootstrap_list(servers: str | Iterable[str]) -> str:
    """Brokers as the comma list the connector expects."""
    if isinstance(servers, str):
        return servers
    return ",".join(servers)


def kafka_source_options(
    servers: str | Iterable[str],
    topic: str = TOPIC,
    starting_offsets: str = "earliest",
    isolation_level: str | None = None,
    max_offsets_per_trigger: int | None = None,
    fail_on_data_loss: bool | None = None,
    min_partitions: int | None = None,
    group_id: str | None = None,
) -> dict[str, str]:
    """Options for ``readStream.format("kafka")``.

    ``startingOffsets`` only applies when a query starts on a new
    checkpoint; later runs resume from the checkpointed offsets. Set
    ``isolation_level="read_committed"`` to hide records of aborted
    producer transactions. ``max_offsets_per_trigger`` bounds a
    micro-batch so that a backlog is split over several batches;
    ``min_partitions`` splits large topic partitions over more read tasks.
    ``group_id`` pins the consumer group (Spark generates a fresh one per
    query by default, which is what concurrent queries need).
    """
    opts = {
        "kafka.bootstrap.servers": bootstrap_list(servers),
        "subscribe": topic,
        "startingOffsets": starting_offsets,
    }
    if isolation_level:
        opts["kafka.isolation.level"] = isolation_level
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(int(max_offsets_per_trigger))
    if min_partitions:
        opts["minPartitions"] = str(int(min_partitions))
    if group_id:
        opts["kafka.group.id"] = group_id
    if fail_on_data_loss is not None:
        opts["failOnDataLoss"] = str(bool(fail_on_data_loss)).lower()
    return opts


def kafka_sink_options(servers: str | Iterable[str], topic: str = TOPIC) -> dict[str, str]:
    """Options for ``write.format("kafka")`` (K3 publish)."""
    return {"kafka.bootstrap.servers": bootstrap_list(servers), "topic": topic}


def read_kafka_stream(spark: SparkSession, **options) -> DataFrame:
    """A streaming DataFrame with the envelope schema."""
    return spark.readStream.format("kafka").options(**kafka_source_options(**options)).load()


def read_kafka_batch(spark: SparkSession, **options) -> DataFrame:
    """S6 on a live topic: every record from the starting offsets to the end."""
    opts = kafka_source_options(**options)
    opts.setdefault("endingOffsets", "latest")
    return spark.read.format("kafka").options(**opts).load()


def write_kafka(records: DataFrame, servers: str | Iterable[str], topic: str = TOPIC) -> None:
    """K3 publish: key/value (and partition, when present) go to the broker,
    which gives each record its offset and the time of its arrival: the record
    time of ``records`` is not sent (the connector has no column for it)."""
    cols = [c for c in ("key", "value", "partition") if c in records.columns]
    records.select(*cols).write.format("kafka").options(
        **kafka_sink_options(servers, topic)
    ).save()


class KafkaTopic:
    """A live topic with the same interface as ``FileTopic``: publish,
    read (batch) and read_stream, so every flow runs on either."""

    def __init__(self, spark: SparkSession, servers: str | Iterable[str], topic: str = TOPIC,
                 **source_options):
        self.spark = spark
        self.servers = servers
        self.topic = topic
        self.source_options = source_options

    @property
    def path(self) -> str:
        return f"kafka://{bootstrap_list(self.servers)}/{self.topic}"

    def publish(self, records: DataFrame, files: int | None = None) -> None:
        write_kafka(records, self.servers, self.topic)

    def read(self) -> DataFrame:
        return read_kafka_batch(
            self.spark, servers=self.servers, topic=self.topic, **self.source_options
        )

    def read_marked(self, checkpoint: str, at: Position) -> DataFrame:
        """Every record with ``is_read``: whether the query of that checkpoint had read it."""
        return self.read().withColumn("is_read", offsets_read(at, self.topic))

    def read_stream(self, per_trigger: int | None = None) -> DataFrame:
        """``per_trigger``: records of one micro-batch."""
        opts = dict(self.source_options)
        if per_trigger:
            opts["max_offsets_per_trigger"] = per_trigger
        return read_kafka_stream(self.spark, servers=self.servers, topic=self.topic, **opts)
