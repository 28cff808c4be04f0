"""The given Parquet tables and the domain inputs built from them.

All bindings are projections, filters and joins on whole tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.skew import broadcast_if_small
from tidemark.sources.kafka import EVENT_TIME_FORMAT, with_event_time


class Tables:
    """Domain inputs over the Parquet files in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def state(self, name: str) -> tuple[int, tuple]:
        """Bytes of a table, and what tells whether its files have changed: their number, bytes and time."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(f"{self.folder}/{name}.parquet")
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = store.getContentSummary(place)
        size = found.getLength()
        return size, (size, found.getFileCount(), store.getFileStatus(place).getModificationTime())

    def orders(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Orders of the years ``first`` to ``last``: a range of dates, which reaches the scan."""
        orders, day = self.raw("orders"), F.to_date("o_orderdate")
        if first is not None:
            orders = orders.filter(day >= F.lit(dt.date(first, 1, 1)))
        return orders if last is None else orders.filter(day <= F.lit(dt.date(last, 12, 31)))

    # Customers as actors, their orders as films.
    def actor_films(self, first: int | None = None, last: int | None = None) -> DataFrame:
        orders = self.orders(first, last).select(
            F.col("o_custkey").alias("c_custkey"),
            F.col("o_custkey").cast("string").alias("actorid"),
            F.col("o_orderpriority").alias("film"),
            F.year("o_orderdate").alias("year"),
            F.floor("o_totalprice").cast("int").alias("votes"),
            (F.col("o_totalprice") / 50000).alias("rating"),
            F.col("o_orderkey").cast("string").alias("filmid"),
        )
        names = self.raw("customer").select("c_custkey", F.col("c_name").alias("actor"))
        return orders.join(names, "c_custkey").drop("c_custkey")

    def actor_ratings(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """Actor, year and rating only: what the tiers need, without the join for names."""
        return self.orders(first, last).select(
            F.col("o_custkey").cast("string").alias("actorid"),
            F.year("o_orderdate").alias("year"),
            (F.col("o_totalprice") / 50000).alias("rating"),
        )

    def player_seasons(self, first: int | None = None, last: int | None = None) -> DataFrame:
        return self.orders(first, last).select(
            F.col("o_custkey").cast("string").alias("player_name"),
            F.year("o_orderdate").alias("season"),
        )

    # Line items as box scores, orders as games.
    def game_details(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("game_id"),
            F.col("l_suppkey").alias("team_id"),
            F.col("l_partkey").alias("player_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_quantity").alias("pts"),
        )

    def box_scores(self) -> DataFrame:
        """Line items as rows with copies: one per (game, line), with text minutes and comments."""
        code = F.when(F.col("l_returnflag") == "R", "DNP - injury").when(
            F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "F", "NWT")
        ).otherwise(F.concat(F.lit("note "), F.col("l_linestatus")))
        seconds = F.lpad((F.col("l_discount") * 100).cast("int").cast("string"), 2, "0")
        minutes = F.col("l_quantity").cast("int").cast("string")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("game_id"),
            F.col("l_linenumber").cast("bigint").alias("team_id"),
            (F.col("l_orderkey") % 7).alias("player_id"),
            F.col("l_partkey").alias("part"),
            F.col("l_suppkey").alias("supplier"),
            code.alias("comment"),
            F.when(F.col("l_tax") > 0.01, F.concat_ws(":", minutes, seconds))
            .when(F.col("l_tax") > 0, minutes)
            .alias("min"),
            F.col("l_tax").alias("TO"),
            F.col("l_quantity").alias("pts"),
            F.col("l_discount").alias("discount"),
            F.concat("l_returnflag", "l_linestatus").alias("flags"),
        )

    def home_teams(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("game_id")).agg(
            F.min("l_suppkey").alias("home_team_id")
        )

    def games(self) -> DataFrame:
        return self.game_dates().join(self.home_teams(), "game_id")

    def game_dates(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("game_id"),
            F.to_date("o_orderdate").alias("game_date_est"),
            F.year("o_orderdate").alias("season"),
            (F.col("o_orderstatus") == "F").cast("int").alias("home_team_wins"),
        )

    def box_games(self) -> DataFrame:
        """Games of the box scores, whose teams are the line numbers 1 to 7."""
        return self.game_dates().withColumn("home_team_id", F.col("game_id") % 7 + 1)

    # Orders as matches, line items as performances and medals, parts as medal types.
    def matches(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("match_id"),
            (F.col("o_orderstatus") == "F").alias("is_team_game"),
            F.col("o_orderpriority").alias("playlist_id"),
            F.lit(None).cast("string").alias("game_variant_id"),
            (F.col("o_orderstatus") != "P").alias("is_match_over"),
            F.col("o_orderdate").alias("completion_date"),
            F.lit(None).cast("string").alias("match_duration"),
            F.col("o_orderstatus").alias("game_mode"),
            (F.col("o_custkey") % 20).alias("map_variant_id"),
        )

    def match_details(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("match_id"),
            F.col("l_suppkey").alias("player_gamertag"),
            F.col("l_quantity").cast("int").alias("player_total_kills"),
        )

    def match_medals(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("match_id"),
            F.col("l_suppkey").alias("player_gamertag"),
            F.col("l_partkey").alias("medal_id"),
            F.col("l_linenumber").alias("count"),
        )

    def medals(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("medal_id"), F.col("p_name").alias("name")
        )

    # Events as web traffic, parts as devices.
    def events(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            "event_id",
            "user_id",
            (k % 3 + 1).alias("device_id"),
            F.col("event_type").alias("host"),
            F.col("ts").alias("event_time"),
        )

    def user_hosts(self) -> DataFrame:
        """Events with one host per user: hosts that are absent on some days."""
        return self.raw("events").select(
            F.col("user_id").cast("string").alias("host"), "user_id",
            F.col("ts").alias("event_time"),
        )

    def user_type_hosts(self) -> DataFrame:
        """Events with one host per type and user: hosts that appear late in the month."""
        return self.raw("events").select(
            F.concat_ws("-", "event_type", "user_id").alias("host"),
            (F.col("event_id") % 4).alias("user_id"),
            F.col("ts").alias("event_time"),
        )

    def devices(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("record"),
            F.col("p_size").cast("bigint").alias("device_id"),
            F.col("p_type").alias("browser_type"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("device_type"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("os_type"),
            F.col("p_brand").alias("os_version_major"),
        )

    def device_events(self) -> DataFrame:
        """Events of devices that a user has several of, so that most have a device of their own."""
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.raw("events").select(
            "event_id", "user_id", (F.col("user_id") * 3 + k % 3).alias("device_id"), F.col("ts").alias("event_time"),
        )

    def device_changes(self) -> DataFrame:
        """Parts as changes of devices: four for each, ten days apart, the first before all events."""
        version = F.pmod("p_partkey", F.lit(4)).cast("int")
        return self.raw("part").select(
            F.floor(F.col("p_partkey") / 4).alias("device_id"),
            F.date_add(F.lit(dt.date(2023, 12, 25)), version * 10).cast("timestamp_ntz").alias("changed"),
            F.col("p_type").alias("browser_type"),
            F.split_part("p_name", F.lit(" "), F.lit(2)).alias("device_type"),
            F.split_part("p_name", F.lit(" "), F.lit(1)).alias("os_type"),
        )

    def web_events(self) -> DataFrame:
        """Web events with the event time parsed from text, as a message carries it."""
        return with_event_time(
            self.raw("events").select(
                F.col("user_id").cast("string").alias("ip"),
                F.date_format(F.col("ts").cast("timestamp"), EVENT_TIME_FORMAT).alias("event_time"),
                F.col("event_type").alias("host"),
            )
        )

    def locations(self) -> DataFrame:
        """One row per user; users outside the nations' number have no location."""
        nations, regions = self.raw("nation"), self.raw("region")
        places = nations.join(
            broadcast_if_small(regions), nations["n_regionkey"] == regions["r_regionkey"]
        )
        return places.select(
            F.col("n_nationkey").cast("string").alias("ip"),
            F.col("r_name").alias("country"),
            F.col("n_name").alias("state"),
            F.lit(None).cast("string").alias("city"),
        )
