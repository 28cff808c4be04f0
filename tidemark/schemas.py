"""Schemas of the domain tables.

Spark enforces no keys; the key of each table is listed in ``KEYS`` and checked with
``tidemark.operators.profile.key_violations``.
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

BOOLEAN, DATE, TIMESTAMP = BooleanType(), DateType(), TimestampType()
INT, BIGINT, DOUBLE, STRING = IntegerType(), LongType(), DoubleType(), StringType()


def _schema(**columns: DataType) -> StructType:
    schema = StructType()
    for name, kind in columns.items():
        schema = schema.add(name, kind)
    return schema


FILM = _schema(
    year=INT, film=STRING, votes=INT, rating=DOUBLE, filmid=STRING,
)

ACTOR_FILMS = _schema(
    actor=STRING, actorid=STRING, film=STRING, year=INT, votes=INT, rating=DOUBLE, filmid=STRING,
)
ACTORS = _schema(
    actorid=STRING, page=INT, actor=STRING, films=ArrayType(FILM), quality_class=STRING,
    is_active=BOOLEAN, current_year=INT,
)
ACTORS_HISTORY_SCD = _schema(
    actorid=STRING, quality_class=STRING, is_active=BOOLEAN, start_year=INT, end_year=INT,
    current_year=INT,
)
GAME_DETAILS = _schema(
    game_id=BIGINT, team_id=BIGINT, player_id=BIGINT, player_name=STRING, start_position=STRING,
    comment=STRING, min=STRING, fgm=DOUBLE, fga=DOUBLE, fg3m=DOUBLE, fg3a=DOUBLE, ftm=DOUBLE,
    fta=DOUBLE, oreb=DOUBLE, dreb=DOUBLE, reb=DOUBLE, ast=DOUBLE, stl=DOUBLE, blk=DOUBLE,
    TO=DOUBLE, pf=DOUBLE, pts=DOUBLE, plus_minus=DOUBLE,
)
GAMES = _schema(
    game_id=BIGINT, game_date_est=DATE, season=INT, home_team_id=BIGINT, home_team_wins=INT,
)
PLAYER_SEASONS = _schema(
    player_name=STRING, season=INT,
)
PLAYER_STATES = _schema(
    player_name=STRING, status=STRING, season=INT,
)
DEVICES = _schema(
    device_id=BIGINT, browser_type=STRING, browser_version_major=INT, browser_version_minor=INT,
    browser_version_patch=INT, device_type=STRING, device_version_major=STRING,
    device_version_minor=INT, device_version_patch=INT, os_type=STRING, os_version_major=STRING,
    os_version_minor=INT, os_version_patch=INT,
)
EVENTS = _schema(
    user_id=BIGINT, device_id=BIGINT, host=STRING, event_time=TIMESTAMP,
)
USER_DEVICES_CUMULATED = _schema(
    user_id=STRING, device_id=STRING, browser_type=STRING, dates_active=ArrayType(DATE),
    date=DATE,
)
USER_DEVICE_DATELIST_INT = _schema(
    user_id=STRING, device_id=STRING, browser_type=STRING, datelist_int=BIGINT, date=DATE,
)
HOSTS_CUMULATED = _schema(
    host=STRING, dates_active=ArrayType(DATE), date=DATE,
)
HOST_ACTIVITY_REDUCED = _schema(
    host=STRING, hit_array=ArrayType(BIGINT), unique_visitors=ArrayType(BIGINT),
    month_start=DATE, first_found_date=DATE, date_partition=DATE,
)
MATCH_DETAILS = _schema(
    match_id=STRING, player_gamertag=STRING, player_total_kills=INT,
)
MATCHES = _schema(
    match_id=STRING, is_team_game=BOOLEAN, playlist_id=STRING, game_variant_id=STRING,
    is_match_over=BOOLEAN, completion_date=TIMESTAMP, match_duration=STRING, game_mode=STRING,
    map_variant_id=STRING,
)
MEDALS_MATCHES_PLAYERS = _schema(
    match_id=STRING, player_gamertag=STRING, medal_id=BIGINT, count=INT,
)
MEDALS = _schema(
    medal_id=BIGINT, name=STRING,
)
MAPS = _schema(
    mapid=STRING, name=STRING,
)
WEB_EVENTS = _schema(
    ip=STRING, event_time=STRING, referrer=STRING, host=STRING, url=STRING, geodata=STRING,
)
WINDOW_COUNTS = _schema(
    ip=STRING, host=STRING, window_start=TIMESTAMP, num_logs=BIGINT,
)

KEYS = {
    "actor_films": ("actorid", "filmid"),
    "actors": ("actorid", "page", "current_year"),
    "actors_history_scd": ("actorid", "start_year", "current_year"),
    "no_duplicate_devices": ("device_id", "browser_type", "device_type", "os_type"),
    "user_devices_cumulated": ("user_id", "device_id", "browser_type", "date"),
    "user_device_datelist_int": ("user_id", "device_id", "browser_type", "date"),
    "hosts_cumulated": ("host", "date"),
    "host_activity_reduced": ("host", "month_start", "date_partition"),
    "player_states": ("player_name", "season"),
}
