"""Event streams: Kafka topics and folders of JSON lines, one parser for both."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import WEB_EVENTS

# Fixed value: form of the event time in the messages.
EVENT_TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def kafka_options(
    servers: str, topic: str, group: str | None = None, user: str | None = None,
    password: str | None = None, starting: str = "latest",
) -> dict[str, str]:
    """Reader options: offsets to start from (``earliest`` skips none), and SASL_SSL with PLAIN if a user is given."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
    }
    if group:
        options["kafka.group.id"] = group
    if user:
        login = "org.apache.kafka.common.security.plain.PlainLoginModule"
        options |= {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": f'{login} required username="{user}" password="{password}";',
        }
    return options


def read_kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """Web events of a topic. Needs the Spark Kafka package on the class path."""
    return parse_events(spark.readStream.format("kafka").options(**options).load())


def read_event_files(
    spark: SparkSession, path: str, max_files: int | None = None
) -> DataFrame:
    """Web events from a folder that receives files of JSON lines."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return parse_events(reader.load(path))


def parse_events(messages: DataFrame) -> DataFrame:
    """Messages with a JSON ``value`` as web events with ``window_timestamp``.

    A message that is no JSON gives NULL columns and an unreadable time a NULL timestamp.
    """
    event = F.from_json(F.col("value").cast("string"), WEB_EVENTS)
    return with_event_time(messages.select(event.alias("event")).select("event.*"))


def with_event_time(events: DataFrame) -> DataFrame:
    """Add ``window_timestamp``, the event time read from its text."""
    parsed = F.try_to_timestamp("event_time", F.lit(EVENT_TIME_FORMAT))
    return events.withColumn("window_timestamp", parsed)
