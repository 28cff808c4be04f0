"""Named queries: every operator over the given tables.

Arrays are returned as text and dates as ISO strings, so results compare across engines.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import schemas
from tidemark.functions import bit_string, tier
from tidemark.operators import (
    cumulative,
    datelist,
    dedup,
    grouping,
    joins,
    layout,
    lifecycle,
    monthly,
    profile,
    rankings,
    scd,
    sequences,
)
from tidemark.plans.session import join_policy, shared_dir, sized_session
from tidemark.plans.skew import HotKeys, find_hot_keys, rows_bound
from tidemark.sources.files import bucket_count, read_csv, write_bucketed
from tidemark.sources.kafka import EVENT_TIME_FORMAT, parse_events, read_event_files
from tidemark.sources.snapshots import read_snapshot, upsert_snapshot, write_snapshot
from tidemark.sources.store import KeyedTable, SnapshotStore
from tidemark.sources.tables import Tables
from tidemark.sources.versions import VersionLog
from tidemark.streaming import runs, windows

# The periods of single steps; histories run from the first to the last period of their table.
FIRST_YEAR, STEP_YEAR = 1995, 1999
STEP_DAY = dt.date(2024, 1, 16)
MONTH, YESTERDAY = STEP_DAY.replace(day=1), STEP_DAY - dt.timedelta(days=1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
    return build


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


def _years(t: Tables) -> tuple[int, int]:
    """First and last year of the orders; a step's year if there are none."""
    year = F.year("o_orderdate")
    first, last = t.raw("orders").agg(F.min(year), F.max(year)).first()
    return (STEP_YEAR, STEP_YEAR) if last is None else (first, last)


def _last_day(t: Tables) -> dt.date:
    """Last day of the events; a step's day if there are none."""
    return t.raw("events").agg(F.max(F.to_date("ts"))).first()[0] or STEP_DAY


# Where a session has its stores. Steps go on from what a store has: the first one of a session lays it down with the
# period before, as an earlier run would have left it; each later one reads that period and stores its own anew.
_STORES: dict[tuple, str] = {}


def _store(
    t: Tables, name: str, schema: StructType, period: str, keys: Sequence[str], source: str, before: int | dt.date,
    build: Callable[[], DataFrame],
) -> SnapshotStore:
    """The store of that name for the tables of a folder, with the period ``before`` in it.

    Files that have changed since get a store of their own. Buckets are of about 128 MB of ``source``.
    """
    size, state = t.state(source)
    path = _STORES.setdefault((t.spark.sparkContext.applicationId, name, t.folder, state), shared_dir(t.spark, name))
    store = SnapshotStore(t.spark, path, schema, period, keys, max(8, -(-size // (128 << 20))))
    if str(before) not in store.periods():
        store.write(build(), before)
    return store


def _sized(t: Tables, source: str) -> Tables:
    """The same tables, read by a session with partitions enough for the rows of ``source``."""
    return Tables(sized_session(t.spark, t.state(source)[0]), t.folder)


def _list(array: str) -> Column:
    return F.array_join(F.col(array).cast("array<string>"), ",", "-")


# Entities


@query
def rating_tier(t: Tables) -> DataFrame:
    averages = t.actor_ratings().groupBy("actorid", "year").agg(F.avg("rating").alias("average"))
    return averages.select(
        "actorid", "year", F.round("average", 10).alias("avg_rating"),
        tier("average").alias("quality_class"),
    )


def _snapshot_view(df: DataFrame) -> DataFrame:
    films = F.transform("films", lambda f: F.concat_ws(":", f["year"].cast("string"), f["filmid"]))
    return df.withColumns(
        {"n_films": F.size("films").cast("bigint"), "films": F.array_join(films, ",")}
    )


def _actors(t: Tables) -> SnapshotStore:
    before = STEP_YEAR - 1
    return _store(
        t, "actors", schemas.ACTORS, "current_year", ["actorid"], "orders", before,
        lambda: cumulative.entity_history(t.actor_films(last=before), before, since=before),
    )


def _advance_actors(store: SnapshotStore, t: Tables) -> DataFrame:
    films = t.actor_films(STEP_YEAR, STEP_YEAR)
    return store.advance(
        STEP_YEAR - 1, STEP_YEAR, lambda stored: cumulative.cumulate_entities(stored, films, STEP_YEAR)
    )


@query
def entity_snapshot_step(t: Tables) -> DataFrame:
    return _snapshot_view(_advance_actors(_actors(t), t))


@query
def entity_snapshot_history(t: Tables) -> DataFrame:
    return _snapshot_view(cumulative.entity_history(t.actor_films(), _years(t)[1]))


@query
def entity_snapshot_paged(t: Tables) -> DataFrame:
    """A step over snapshots of four pages per entity; the pages are put together for the result."""
    before, pages = STEP_YEAR - 1, 4
    store = _store(
        t, "paged", schemas.ACTORS, "current_year", ["actorid", "page"], "orders", before,
        lambda: cumulative.entity_history(t.actor_films(last=before), before, pages=pages, since=before),
    )
    films = t.actor_films(STEP_YEAR, STEP_YEAR)
    paged = store.advance(
        before, STEP_YEAR, lambda stored: cumulative.cumulate_entities(stored, films, STEP_YEAR, pages=pages)
    )
    short = F.transform("films", lambda f: F.struct(f["year"].alias("year"), f["filmid"].alias("filmid")))
    whole = paged.groupBy("actorid", "actor", "quality_class", "is_active", "current_year").agg(
        F.count("page").alias("n_pages"), F.sort_array(F.flatten(F.collect_list(short))).alias("films")
    )
    return _snapshot_view(whole)


def _actor_states(t: Tables, through: int, since: int | None = None) -> DataFrame:
    return cumulative.entity_history(t.actor_ratings(), through, with_items=False, since=since)


@query
def scd_backfill(t: Tables) -> DataFrame:
    last = _years(t)[1]
    return scd.scd2_backfill(_actor_states(t, last), last)


@query
def scd_step(t: Tables) -> DataFrame:
    """Two stores with the same buckets: the histories as of last year, and this year's snapshot of the actors."""
    before, actors = STEP_YEAR - 1, _actors(t)
    if str(STEP_YEAR) not in actors.periods():
        _advance_actors(actors, t)
    store = _store(
        t, "scd", schemas.ACTORS_HISTORY_SCD, "current_year", ["actorid"], "orders", before,
        lambda: scd.scd2_backfill(_actor_states(t, before), before),
    )
    return store.advance(
        before, STEP_YEAR, lambda stored: scd.scd2_step(stored, actors.read(STEP_YEAR), STEP_YEAR)
    )


# Deduplication and profiles

BOX_ORDER = ["part", "supplier", "pts", "TO", "discount", "flags"]


@query
def fact_dedup(t: Tables) -> DataFrame:
    facts = dedup.dedup_facts(t.box_scores(), t.box_games(), BOX_ORDER)
    return facts.select(
        "game_id", "team_id", "player_id", "part", "supplier", "season", "home_team_id",
        _text("game_date_est").alias("game_date_est"),
    )


@query
def box_score_flags(t: Tables) -> DataFrame:
    facts = dedup.dedup_box_scores(t.box_scores(), t.box_games(), BOX_ORDER)
    return facts.select(
        "game_id", "team_id", "player_id", "dim_is_playing_at_home", "dim_did_not_play",
        "dim_did_not_dress", "dim_not_with_team", F.round("minutes", 6).alias("minutes"),
        "turnovers", "pts",
    )


@query
def device_dedup(t: Tables) -> DataFrame:
    return dedup.dedup_dimension(t.devices(), ["record"]).select(
        "device_id", "browser_type", "device_type", "os_type", "os_version_major", "record"
    )


@query
def profile_devices(t: Tables) -> DataFrame:
    return profile.profile(t.devices(), ["device_id", "browser_type"])


@query
def profile_events_by_day(t: Tables) -> DataFrame:
    daily = profile.profile(
        t.events(), ["user_id", "device_id"], by=[F.to_date("event_time").alias("day")]
    )
    return daily.withColumn("day", _text("day"))


@query
def duplicate_keys(t: Tables) -> DataFrame:
    return profile.key_violations(t.box_scores(), ["game_id", "team_id", "player_id"])


# Date lists


def _user_days(t: Tables) -> DataFrame:
    return datelist.device_days(t.events())


def _list_view(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "n_days": F.size("dates_active").cast("bigint"),
            "dates_active": _list("dates_active"),
            "date": _text("date"),
        }
    )


DEVICE_LISTS = StructType([f for f in schemas.USER_DEVICES_CUMULATED if f.name != "browser_type"])
DEVICE_BITS = StructType([f for f in schemas.USER_DEVICE_DATELIST_INT if f.name != "browser_type"])


def _step_lists(
    t: Tables, name: str, schema: StructType, days: DataFrame, keys: tuple[str, ...], **options
) -> DataFrame:
    newest_first = options.get("newest_first", True)
    store = _store(
        t, name, schema, "date", keys, "events", YESTERDAY,
        lambda: datelist.datelist_history(days, keys, YESTERDAY, newest_first, first_day=YESTERDAY),
    )
    return store.advance(
        YESTERDAY, STEP_DAY, lambda stored: datelist.cumulate_dates(stored, days, keys, STEP_DAY, **options)
    )


@query
def user_datelist_step(t: Tables) -> DataFrame:
    lists = _step_lists(t, "user_lists", DEVICE_LISTS, _user_days(t), datelist.DEVICE)
    return _list_view(datelist.with_browsers(lists, t.devices()))


@query
def user_datelist_active_only(t: Tables) -> DataFrame:
    lists = _step_lists(t, "active_lists", DEVICE_LISTS, _user_days(t), datelist.DEVICE, keep_inactive=False)
    return _list_view(datelist.with_browsers(lists, t.devices()))


@query
def user_datelist_history(t: Tables) -> DataFrame:
    lists = datelist.datelist_history(_user_days(t), datelist.DEVICE, _last_day(t))
    return datelist.with_browsers(_list_view(lists), t.devices())


@query
def host_datelist_step(t: Tables) -> DataFrame:
    days = datelist.active_days(t.user_hosts(), ["host"])
    return _list_view(
        _step_lists(t, "host_lists", schemas.HOSTS_CUMULATED, days, ("host",), newest_first=False)
    )


@query
def host_datelist_history(t: Tables) -> DataFrame:
    days = datelist.active_days(t.user_hosts(), ["host"])
    return _list_view(datelist.datelist_history(days, ["host"], _last_day(t), newest_first=False))


def _bits_of(t: Tables, day: dt.date, **options) -> DataFrame:
    lists = datelist.datelist_history(_user_days(t), datelist.DEVICE, day, first_day=day)
    return datelist.datelist_int(lists, datelist.DEVICE, day, **options)


def _bitmap_view(t: Tables, bits: DataFrame) -> DataFrame:
    found = datelist.with_browsers(bits, t.devices())
    return found.withColumns({"bits": bit_string("datelist_int"), "date": _text("date")})


def _bitmaps(t: Tables, **options) -> DataFrame:
    return _bitmap_view(t, _bits_of(t, _last_day(t), **options))


@query
def datelist_bitmap_step(t: Tables) -> DataFrame:
    """The bitmaps of a day from the stored ones of the day before."""
    store = _store(
        t, "bitmaps", DEVICE_BITS, "date", datelist.DEVICE, "events", YESTERDAY, lambda: _bits_of(t, YESTERDAY)
    )
    days = _user_days(t)
    return _bitmap_view(
        t, store.advance(YESTERDAY, STEP_DAY, lambda stored: datelist.bitmap_step(stored, days, datelist.DEVICE, STEP_DAY))
    )


@query
def datelist_bitmap(t: Tables) -> DataFrame:
    return _bitmaps(t)


@query
def datelist_bitmap_shifted(t: Tables) -> DataFrame:
    return _bitmaps(t, top=32)


# Monthly reduced facts


def _monthly_view(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "n_days": F.size("hit_array").cast("bigint"),
            "hit_array": _list("hit_array"),
            "unique_visitors": _list("unique_visitors"),
            **{c: _text(c) for c in ("month_start", "first_found_date", "date_partition")},
        }
    )


@query
def monthly_reduced_history(t: Tables) -> DataFrame:
    """The month of the last day, up to that day."""
    last = _last_day(t)
    return _monthly_view(monthly.monthly_history(t.user_type_hosts(), last.replace(day=1), last))


def _monthly_store(t: Tables, name: str, **options) -> SnapshotStore:
    return _store(
        t, name, schemas.HOST_ACTIVITY_REDUCED, "date_partition", ["host"], "events", YESTERDAY,
        lambda: monthly.monthly_history(t.user_type_hosts(), MONTH, YESTERDAY, since=YESTERDAY, **options),
    )


def _monthly_step(t: Tables, store: SnapshotStore, **options) -> DataFrame:
    events = t.user_type_hosts()
    return store.advance(
        YESTERDAY, STEP_DAY, lambda stored: monthly.monthly_reduce_step(stored, events, MONTH, STEP_DAY, **options)
    )


@query
def monthly_reduced_step(t: Tables) -> DataFrame:
    return _monthly_view(_monthly_step(t, _monthly_store(t, "monthly")))


@query
def monthly_reduced_zero_filled(t: Tables) -> DataFrame:
    store = _monthly_store(t, "monthly_zero", fill_zero=True)
    return _monthly_view(_monthly_step(t, store, fill_zero=True))


def _active_hosts(t: Tables, store: SnapshotStore) -> DataFrame:
    """The rows of today's snapshot whose host has events today."""
    return _monthly_step(t, store).filter(F.element_at("hit_array", -1).isNotNull())


def _updated_hosts(t: Tables) -> KeyedTable:
    """A table with yesterday's row of every host, then with today's rows in place of those of active hosts."""
    store = _monthly_store(t, "monthly")
    table = KeyedTable(t.spark, shared_dir(t.spark, "hosts"), store.schema, store.keys, store.buckets)
    table.upsert(store.read(YESTERDAY))
    table.upsert(_active_hosts(t, store))
    return table


@query
def monthly_upsert(t: Tables) -> DataFrame:
    """Yesterday's snapshot updated with the hosts of today's, one row per host."""
    return _monthly_view(_updated_hosts(t).read())


@query
def monthly_upsert_versions(t: Tables) -> DataFrame:
    """The table before and after the update, which rewrites the buckets of active hosts only."""
    table = _updated_hosts(t)
    both = [table.read(version).withColumn("version", F.lit(version)) for version in (1, 2)]
    return _monthly_view(both[0].unionByName(both[1]))


@query
def stored_upsert(t: Tables) -> DataFrame:
    """The updated table stored as the snapshot of today, beside that of yesterday."""
    source = _monthly_store(t, "monthly")
    store = SnapshotStore(
        t.spark, shared_dir(t.spark, "upserted"), source.schema, source.period, source.keys, source.buckets
    )
    store.write(source.read(YESTERDAY), YESTERDAY, clustered=True)
    active = _active_hosts(t, source)
    store.advance(
        YESTERDAY, STEP_DAY, lambda stored: upsert_snapshot(stored, active, ["host"], "date_partition", STEP_DAY)
    )
    return _monthly_view(store.read_all())


# Joins


@query
def join_without_auto_broadcast(t: Tables) -> DataFrame:
    plain = Tables(join_policy(t.spark, auto_broadcast=False), t.folder)
    orders, customers = plain.raw("orders"), plain.raw("customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


@query
def broadcast_lookup_join(t: Tables) -> DataFrame:
    names = t.raw("nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")
    )
    # Shifted keys: some find no nation.
    shifted = (F.col("c_nationkey") + 5).alias("c_nationkey")
    customers = t.raw("customer").select("c_custkey", shifted)
    return joins.broadcast_lookup(customers, names, "c_nationkey")


@query
def csv_lookup_join(t: Tables) -> DataFrame:
    """The same join over two datasets that are kept as CSV files with a header."""
    folder = shared_dir(t.spark, "csv")
    names = t.raw("nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")
    )
    customers = t.raw("customer").select("c_custkey", "c_nationkey", "c_name")
    stored = {}
    for name, df in {"customers": customers, "names": names}.items():
        df.write.option("header", True).csv(f"{folder}/{name}")
        stored[name] = read_csv(t.spark, f"{folder}/{name}", df.schema)
    return joins.broadcast_lookup(stored["customers"], stored["names"], "c_nationkey")


def _bucketed(t: Tables, hot: list[HotKeys | None]) -> dict[str, str]:
    """The match tables in buckets, in a new shared folder, under names that no other run has."""
    folder, run = shared_dir(t.spark, "bucketed"), uuid.uuid4().hex
    inputs = {
        "medals": t.match_medals(), "details": t.match_details(), "matches": t.matches()
    }
    n = bucket_count(inputs["medals"])
    return {
        name: write_bucketed(df, f"tidemark_{name}_{run}", "match_id", n, f"{folder}/{name}", hot=hot)
        for name, df in inputs.items()
    }


@query
def bucketed_match_join(t: Tables) -> DataFrame:
    hot = [find_hot_keys(df, ["match_id"]) for df in (t.match_medals(), t.match_details())]
    tables = _bucketed(t, hot)
    joined = joins.bucketed_match_join(t.spark, **tables, hot_medals=hot[0], hot_details=hot[1])
    if not any(hot):  # the frame has the files; only the parts of hot keys are found by way of the catalog
        for name in tables.values():
            t.spark.sql(f"DROP TABLE {name}")
    return joined.select(
        "player_gamertag_medal", "medal_id", "count", "match_id", "player_gamertag",
        "player_total_kills", "playlist_id", "map_variant_id", "is_team_game",
    )


@query
def location_enrichment(t: Tables) -> DataFrame:
    events = t.raw("events").select("event_id", F.col("user_id").cast("string").alias("ip"))
    return joins.enrich_location(events, t.locations())


@query
def event_enrichment(t: Tables) -> DataFrame:
    """Each event of the day with the device as it was at that time."""
    history = joins.device_history(t.device_changes())
    enriched = joins.enrich_events(t.device_events(), history, STEP_DAY)
    return enriched.select("event_id", "user_id", "device_id", "browser_type", "device_type", "os_type")


# Rankings


@query
def average_kills(t: Tables) -> DataFrame:
    return rankings.average_per_event(
        t.match_details(), "player_gamertag", "player_total_kills", "match_id"
    )


@query
def average_kills_joined_grain(t: Tables) -> DataFrame:
    return rankings.average_per_event(
        t.match_details(), "player_gamertag", "player_total_kills", "match_id", t.match_medals()
    )


@query
def top_average_kills(t: Tables) -> DataFrame:
    return rankings.top_average(
        t.match_details(), "player_gamertag", "player_total_kills", "match_id"
    )


def _played(t: Tables) -> DataFrame:
    return rankings.played_matches(t.matches(), t.match_details(), t.match_medals())


@query
def most_played_playlist(t: Tables) -> DataFrame:
    return rankings.most_frequent(_played(t), "playlist_id", "match_id")


@query
def most_played_map(t: Tables) -> DataFrame:
    return rankings.most_frequent(_played(t), "map_variant_id", "match_id")


MEDAL_NAME = "red plate"


@query
def map_with_most_medals(t: Tables) -> DataFrame:
    rows = rankings.medal_rows(t.match_medals(), t.matches())
    return rankings.top_group_for_lookup(rows, t.medals(), MEDAL_NAME, "map_variant_id", "count")


@query
def map_with_most_medals_joined_grain(t: Tables) -> DataFrame:
    rows = rankings.medal_rows(t.match_medals(), t.matches(), t.match_details())
    return rankings.top_group_for_lookup(rows, t.medals(), MEDAL_NAME, "map_variant_id", "count")


# Layout

LAYOUTS = {"none": [], "playlist": ["playlist_id"], "map": ["map_variant_id"]}


def _layouts(t: Tables, by: str) -> DataFrame:
    t = _sized(t, "lineitem")
    rows = t.match_details().join(
        t.matches().select("match_id", "playlist_id", "map_variant_id"), "match_id"
    )
    by_player = {"player": ["player_gamertag"]}
    return layout.layout_report(
        rows, LAYOUTS | by_player, shared_dir(t.spark, "layouts"),
        bucket_count(t.match_details()), by, ties=["match_id"],
    )


@query
def layout_rows(t: Tables) -> DataFrame:
    """Layouts by ranges of their keys."""
    return _layouts(t, "range").select("layout", "rows")


@query
def layout_sizes(t: Tables) -> DataFrame:
    """Layouts by hashes of their keys: figures of the written files that do not depend on the order of rows.

    All rows of a key are in one file, in order; ``measured`` tells that the files have a size.
    """
    return _layouts(t, "hash").select(
        "layout", "rows", "keys", "files_of_a_key", "unsorted", (F.col("bytes") > F.col("rows")).alias("measured")
    )


# Lifecycle


@query
def lifecycle_history(t: Tables) -> DataFrame:
    return lifecycle.lifecycle_history(t.player_seasons(), _years(t)[1])


@query
def lifecycle_step(t: Tables) -> DataFrame:
    before = STEP_YEAR - 1
    store = _store(
        t, "states", schemas.PLAYER_STATES, "season", ["player_name"], "orders", before,
        lambda: lifecycle.lifecycle_history(t.player_seasons(last=before), before, since=before),
    )
    seasons = t.player_seasons(STEP_YEAR, STEP_YEAR)
    return store.advance(before, STEP_YEAR, lambda stored: lifecycle.lifecycle_step(stored, seasons, STEP_YEAR))


def _season_store(t: Tables, path: str) -> SnapshotStore:
    return SnapshotStore(t.spark, path, schemas.PLAYER_STATES, "season", ["player_name"], 8)


def _season_step(t: Tables) -> Callable[[DataFrame, int], DataFrame]:
    return lambda stored, season: lifecycle.lifecycle_step(stored, t.player_seasons(season, season), season)


@query
def snapshot_store_fold(t: Tables) -> DataFrame:
    """The states built season by season through the snapshot store."""
    first, last = _years(t)
    return _season_store(t, shared_dir(t.spark, "fold")).fold(range(first, last + 1), _season_step(t))


@query
def snapshot_store_resumed(t: Tables) -> DataFrame:
    """The same fold in two runs: the second opens the store anew and goes on from what it has."""
    first, last = _years(t)
    path, half = shared_dir(t.spark, "resumed"), (first + last) // 2
    _season_store(t, path).fold(range(first, half + 1), _season_step(t))
    return _season_store(t, path).fold(range(half + 1, last + 1), _season_step(t))


@query
def snapshot_empty_rerun(t: Tables) -> DataFrame:
    """Two seasons stored, and the second once more from a source without rows, which clears it."""
    store = _season_store(t, shared_dir(t.spark, "cleared"))
    states = lifecycle.lifecycle_history(t.player_seasons(last=FIRST_YEAR + 1), FIRST_YEAR + 1)
    for season in (FIRST_YEAR, FIRST_YEAR + 1):
        store.write(states.filter(F.col("season") == season), season)
    store.write(states.limit(0), FIRST_YEAR + 1)
    return store.read_all()


@query
def snapshot_rewrite(t: Tables) -> DataFrame:
    """Two seasons stored, the second written twice: the first stays, the second is replaced."""
    path = shared_dir(t.spark, "rewrite")
    states = lifecycle.lifecycle_history(t.player_seasons(), FIRST_YEAR + 1)
    write_snapshot(states, path, "season")
    stored = read_snapshot(t.spark, path, schemas.PLAYER_STATES)
    step = lifecycle.lifecycle_step(stored, t.player_seasons(), FIRST_YEAR + 1)
    write_snapshot(step, path, "season")
    return read_snapshot(t.spark, path, schemas.PLAYER_STATES)


# Groupings


@query
def grouping_rollup(t: Tables) -> DataFrame:
    t = _sized(t, "lineitem")
    return grouping.grouping_rollup(t.game_details(), t.games())


def _leader(t: Tables, gid: int, measure: str, *columns: str) -> DataFrame:
    found = grouping.one_grouping(t.game_details(), t.games(), gid, measure)
    ties = [F.col(c).asc_nulls_last() for c in columns]
    return grouping.top_of_grouping(found, gid, measure, ties).select(*columns, measure)


@query
def top_scorer_for_one_team(t: Tables) -> DataFrame:
    return _leader(t, grouping.PLAYER_TEAM, "total_points", "player_id", "team_id")


@query
def top_scorer_in_one_season(t: Tables) -> DataFrame:
    return _leader(t, grouping.PLAYER_SEASON, "total_points", "player_id", "season")


@query
def team_with_most_wins(t: Tables) -> DataFrame:
    return _leader(t, grouping.TEAM, "total_wins", "team_id")


# Sequences

GAME_ORDER = ["game_date_est", "game_id"]


def _team_rows(t: Tables) -> int | None:
    """A team has at most as many games as detail rows, which are counted without a join."""
    return rows_bound(t.game_details(), ["team_id"])


def _stretch(t: Tables, games: DataFrame) -> DataFrame:
    return sequences.rolling_count_max(games, "team_id", GAME_ORDER, "won", 90, _team_rows(t))


@query
def best_home_stretch(t: Tables) -> DataFrame:
    return _stretch(t, sequences.team_games(t.games()))


@query
def best_stretch(t: Tables) -> DataFrame:
    return _stretch(t, sequences.team_games(t.games(), t.game_details()))


@query
def top_stretch(t: Tables) -> DataFrame:
    best = _stretch(t, sequences.team_games(t.games(), t.game_details()))
    return best.orderBy(F.col("max_in_stretch").desc(), "team_id").limit(1)


def _streaks(t: Tables) -> DataFrame:
    scores = t.game_details().join(t.game_dates(), "game_id", "left")
    order = ["game_date_est", "game_id", "line", "team_id"]
    bound = rows_bound(t.game_details(), ["player_id"])
    return sequences.streaks(scores, "player_id", order, F.col("pts") > 10, 2, bound)


@query
def scoring_streaks(t: Tables) -> DataFrame:
    return _streaks(t).withColumns({c: _text(c) for c in ("start_date", "end_date")})


@query
def longest_scoring_streaks(t: Tables) -> DataFrame:
    """The longest streak of every player, the earliest of equal ones."""
    order = [
        F.col("streak_length").desc(), F.col("start_date").asc_nulls_last(),
        F.col("end_date").asc_nulls_last(),
    ]
    longest = dedup.first_per_key(_streaks(t), ["player_id"], order)
    return longest.withColumns({c: _text(c) for c in ("start_date", "end_date")})


# Windows over event time


def _window_view(df: DataFrame) -> DataFrame:
    times = [c for c in ("window_start", "window_end") if c in df.columns]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS") for c in times})


@query
def tumbling_counts(t: Tables) -> DataFrame:
    return _window_view(windows.tumbling_counts(t.web_events()))


def _sessions(t: Tables, *keys: str, gap: str = "5 minutes") -> DataFrame:
    """Keys are counted on the raw events, before their time is parsed."""
    bound = rows_bound(t.events(), ["host"] if keys == ("host",) else ["user_id", "host"])
    return windows.session_counts(t.web_events(), keys, gap, max_rows=bound)


@query
def session_counts(t: Tables) -> DataFrame:
    return _window_view(_sessions(t, "ip", "host"))


@query
def host_session_counts(t: Tables) -> DataFrame:
    return _window_view(_sessions(t, "host"))


@query
def average_session_by_ip_host(t: Tables) -> DataFrame:
    sessions = _sessions(t, "ip", "host", gap="6 hours")
    return windows.average_session_size(sessions, ["ip", "host"], host_like="%i%")


@query
def average_session_by_host(t: Tables) -> DataFrame:
    return windows.average_session_size(_sessions(t, "ip", "host", gap="6 hours"), ["host"])


def _messages(t: Tables, events: DataFrame | None = None) -> DataFrame:
    """The events as JSON messages."""
    message = F.struct(
        F.col("user_id").cast("string").alias("ip"),
        F.date_format(F.col("ts").cast("timestamp"), EVENT_TIME_FORMAT).alias("event_time"),
        F.col("event_type").alias("host"),
    )
    return (t.raw("events") if events is None else events).select(F.to_json(message).alias("value"))


def _stream(t: Tables, closing: str) -> DataFrame:
    """The events as JSON messages, and the messages in the folder ``closing``, parsed."""
    events = t.raw("events")
    stored = t.spark.readStream.schema(events.schema).parquet(f"{t.folder}/events.parque[t]")
    last = t.spark.readStream.schema("value string").parquet(closing)
    return parse_events(_messages(t, stored).union(last))


def _closing(t: Tables, folder: str) -> str:
    """A folder with one message, later than every window of the events."""
    time = F.date_format(F.max("ts").cast("timestamp") + F.expr("INTERVAL 2 DAYS"), EVENT_TIME_FORMAT)
    message = t.raw("events").agg(F.to_json(F.struct(time.alias("event_time"))).alias("value"))
    message.write.parquet(f"{folder}/closing")
    return f"{folder}/closing"


def _drain(t: Tables, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run the stream to its end and read what it has written, the last windows included.

    The events come in one batch, and with them a message later than every window. It lifts the
    watermark over them, and its own window stays open, so it is not in the result.
    """
    folder = shared_dir(t.spark, "stream")
    counts = count(_stream(t, _closing(t, folder)))
    runs.append_to_files(counts, f"{folder}/out", f"{folder}/checkpoint", interval=None).awaitTermination()
    return t.spark.read.schema(counts.schema).parquet(f"{folder}/out")


@query
def streamed_tumbling_counts(t: Tables) -> DataFrame:
    return _window_view(_drain(t, windows.tumbling_counts))


def _send_again(t: Tables, checkpoint: str) -> None:
    """Leave a stream as a crash would after its last batch was written: the batch counts as not done."""
    log = VersionLog(t.spark, checkpoint)
    last = max(int(name) for name in log.names("commits") if name.isdigit())
    for name in (str(last), f".{last}.crc"):
        store, place = log.place(f"commits/{name}")
        store.delete(place, False)


@query
def streamed_keyed_counts(t: Tables) -> DataFrame:
    """Counts kept up to date by key: four batches of messages change the same windows, and the last comes twice."""
    folder = shared_dir(t.spark, "keyed")
    _messages(t).repartition(4).write.text(f"{folder}/messages")
    events = read_event_files(t.spark, f"{folder}/messages", max_files=1)
    counts = windows.tumbling_counts(events, lateness=None)
    table = KeyedTable(t.spark, f"{folder}/table", counts.schema, ["ip", "host", "window_start"], 8)
    for again in (False, True):
        if again:
            _send_again(t, f"{folder}/checkpoint")
        runs.upsert_to_table(counts, table, f"{folder}/checkpoint", interval=None).awaitTermination()
    return _window_view(table.read())


@query
def streamed_session_counts(t: Tables) -> DataFrame:
    return _window_view(_drain(t, lambda events: windows.session_counts(events, ["host"])))


def _streamed_sessions(t: Tables) -> DataFrame:
    return _drain(t, lambda events: windows.session_counts(events, gap="6 hours"))


@query
def streamed_session_averages(t: Tables) -> DataFrame:
    """Both stages: sessions streamed into a table, then averaged over it."""
    return windows.average_session_size(_streamed_sessions(t), ["host"])


@query
def streamed_running_averages(t: Tables) -> DataFrame:
    """The averages as a table that every batch of finished sessions brings up to date."""
    folder = shared_dir(t.spark, "running")
    sessions = windows.session_counts(_stream(t, _closing(t, folder)), gap="6 hours")
    sums = "host string, sessions bigint, logs bigint"
    table = KeyedTable(t.spark, f"{folder}/table", t.spark.createDataFrame([], sums).schema, ["host"], 8)
    runs.upsert_to_table(
        sessions, table, f"{folder}/checkpoint", None, "append", lambda batch: windows.session_sums(batch, ["host"])
    ).awaitTermination()
    return windows.averages_of_sums(table.read())


@query
def streamed_session_averages_by_ip_host(t: Tables) -> DataFrame:
    return windows.average_session_size(_streamed_sessions(t), ["ip", "host"], host_like="%i%")
