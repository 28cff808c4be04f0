"""SQL counterparts of the named queries, for a check by another engine.

They state the result in one pass over whole tables: closed forms, even where the query is a step.
"""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

# Common table expressions shared by several statements.

RATINGS = """
ratings AS (
  SELECT CAST(o_custkey AS VARCHAR) AS actorid, CAST(year(o_orderdate) AS INTEGER) AS year,
         o_totalprice / 50000 AS rating
  FROM orders),
yearly AS (SELECT actorid, year, avg(rating) AS average FROM ratings GROUP BY actorid, year)"""

TIER = """CASE WHEN average > 8 THEN 'star' WHEN average > 7 THEN 'good'
  WHEN average > 6 THEN 'average' WHEN average IS NOT NULL THEN 'bad' END"""


FIRST_YEAR = "(SELECT min(year(o_orderdate)) FROM orders)"
LAST_YEAR = "(SELECT max(year(o_orderdate)) FROM orders)"
FIRST_DAY = "(SELECT min(CAST(ts AS DATE)) FROM events)"
LAST_DAY = "(SELECT max(CAST(ts AS DATE)) FROM events)"


def _years(since: int | str, through: int | str) -> str:
    return f"""
years AS (SELECT CAST(unnest(range({since}, {through} + 1)) AS INTEGER) AS current_year)"""


def _states(since: int | str, through: int | str) -> str:
    """One row per actor and year from the first active year on."""
    return f"""{RATINGS}, {_years(since, through)},
latest AS (
  SELECT a.actorid, y.current_year, max(a.year) AS last_year
  FROM yearly a JOIN years y ON a.year <= y.current_year
  GROUP BY a.actorid, y.current_year),
states AS (
  SELECT l.actorid, l.current_year, {TIER} AS quality_class, l.last_year = l.current_year AS is_active
  FROM latest l JOIN yearly a ON a.actorid = l.actorid AND a.year = l.last_year)"""


def _entity_snapshot(since: int | str, through: int | str) -> str:
    return f"""
WITH {_states(since, through)},
films AS (
  SELECT CAST(o_custkey AS VARCHAR) AS actorid, c_name AS actor,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey AS VARCHAR) AS filmid
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s.actorid, CAST(0 AS INTEGER) AS page, max(f.actor) AS actor,
       string_agg(f.year || ':' || f.filmid, ',' ORDER BY f.year, f.filmid) AS films,
       CAST(count(*) AS BIGINT) AS n_films, s.quality_class, s.is_active, s.current_year
FROM states s JOIN films f ON f.actorid = s.actorid AND f.year <= s.current_year
GROUP BY s.actorid, s.quality_class, s.is_active, s.current_year"""


def _scd(through: int | str) -> str:
    return f"""
WITH {_states(FIRST_YEAR, through)},
flagged AS (
  SELECT *, CASE WHEN lag(current_year) OVER w IS NULL
      OR lag(quality_class) OVER w IS DISTINCT FROM quality_class
      OR lag(is_active) OVER w IS DISTINCT FROM is_active THEN 1 ELSE 0 END AS starts
  FROM states WINDOW w AS (PARTITION BY actorid ORDER BY current_year)),
runs AS (
  SELECT *, sum(starts) OVER (PARTITION BY actorid ORDER BY current_year) AS run FROM flagged)
SELECT actorid, quality_class, is_active, min(current_year) AS start_year,
       max(current_year) AS end_year, CAST({through} AS INTEGER) AS current_year
FROM runs GROUP BY actorid, run, quality_class, is_active"""


ORACLE_SQL["rating_tier"] = f"""
WITH {RATINGS}
SELECT actorid, year, round(average, 10) AS avg_rating, {TIER} AS quality_class FROM yearly"""
ORACLE_SQL["entity_snapshot_step"] = _entity_snapshot(1999, 1999)
ORACLE_SQL["entity_snapshot_history"] = _entity_snapshot(FIRST_YEAR, LAST_YEAR)
ORACLE_SQL["entity_snapshot_paged"] = f"""
SELECT * EXCLUDE (page), CAST(4 AS BIGINT) AS n_pages FROM ({_entity_snapshot(1999, 1999)})"""
ORACLE_SQL["scd_backfill"] = _scd(LAST_YEAR)
ORACLE_SQL["scd_step"] = _scd(1999)

BOX_SCORES = """
box_scores AS (
  SELECT l_orderkey AS game_id, CAST(l_linenumber AS BIGINT) AS team_id,
         l_orderkey % 7 AS player_id, l_partkey AS part, l_suppkey AS supplier,
         CASE WHEN l_returnflag = 'R' THEN 'DNP - injury'
              WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN 'NWT' END
              ELSE 'note ' || l_linestatus END AS comment,
         CASE WHEN l_tax > 0 THEN CAST(l_quantity AS INTEGER) END AS whole,
         CASE WHEN l_tax > 0.01 THEN CAST(trunc(l_discount * 100) AS INTEGER) ELSE 0 END AS seconds,
         l_tax AS turnovers, l_quantity AS pts,
         row_number() OVER (
           PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_partkey, l_suppkey, l_quantity, l_tax, l_discount,
             l_returnflag || l_linestatus) AS place
  FROM lineitem),
box_games AS (
  SELECT o_orderkey AS game_id, strftime(o_orderdate, '%Y-%m-%d') AS game_date_est,
         CAST(year(o_orderdate) AS INTEGER) AS season, o_orderkey % 7 + 1 AS home_team_id
  FROM orders)"""

ORACLE_SQL["fact_dedup"] = f"""
WITH {BOX_SCORES}
SELECT game_id, team_id, player_id, part, supplier, season, home_team_id, game_date_est
FROM box_scores JOIN box_games USING (game_id) WHERE place = 1"""
ORACLE_SQL["box_score_flags"] = f"""
WITH {BOX_SCORES}
SELECT game_id, team_id, player_id, team_id = home_team_id AS dim_is_playing_at_home,
       coalesce(contains(comment, 'DNP'), false) AS dim_did_not_play,
       coalesce(contains(comment, 'DND'), false) AS dim_did_not_dress,
       coalesce(contains(comment, 'NWT'), false) AS dim_not_with_team,
       round(whole + seconds / 60.0, 6) AS minutes, turnovers, pts
FROM box_scores JOIN box_games USING (game_id) WHERE place = 1"""
ORACLE_SQL["duplicate_keys"] = f"""
WITH {BOX_SCORES}
SELECT game_id, team_id, player_id, CAST(count(*) AS BIGINT) AS n_rows
FROM box_scores GROUP BY game_id, team_id, player_id HAVING count(*) > 1"""

DEVICES = """
device_rows AS (
  SELECT p_partkey AS record, CAST(p_size AS BIGINT) AS device_id, p_type AS browser_type,
         split_part(p_name, ' ', 2) AS device_type, split_part(p_name, ' ', 1) AS os_type,
         p_brand AS os_version_major
  FROM part)"""

ORACLE_SQL["device_dedup"] = f"""
WITH {DEVICES},
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY device_id, browser_type, device_type, os_type ORDER BY record) AS place
  FROM device_rows)
SELECT CAST(device_id AS VARCHAR) AS device_id, browser_type, device_type, os_type,
       os_version_major, record
FROM placed WHERE place = 1"""
ORACLE_SQL["profile_devices"] = f"""
WITH {DEVICES}
SELECT CAST(count(*) AS BIGINT) AS n_rows, count(device_id) AS device_id_non_null,
       count(DISTINCT device_id) AS device_id_distinct, max(device_id) AS device_id_max,
       count(browser_type) AS browser_type_non_null,
       count(DISTINCT browser_type) AS browser_type_distinct, max(browser_type) AS browser_type_max
FROM device_rows"""

EVENTS = """
web AS (
  SELECT event_id, user_id, event_type AS host, ts, CAST(ts AS DATE) AS day,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1 AS device_id
  FROM events)"""

ORACLE_SQL["profile_events_by_day"] = f"""
WITH {EVENTS}
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n_rows,
       count(user_id) AS user_id_non_null, count(DISTINCT user_id) AS user_id_distinct,
       max(user_id) AS user_id_max, count(device_id) AS device_id_non_null,
       count(DISTINCT device_id) AS device_id_distinct, max(device_id) AS device_id_max
FROM web GROUP BY day"""

# Date lists.

USER_DAYS = f"""{EVENTS}, {DEVICES},
days AS (
  SELECT DISTINCT CAST(w.user_id AS VARCHAR) AS user_id, CAST(w.device_id AS VARCHAR) AS device_id,
         d.browser_type, w.day
  FROM web w JOIN device_rows d ON w.device_id = d.device_id
  WHERE w.user_id IS NOT NULL AND d.browser_type IS NOT NULL)"""
HOST_DAYS = """
days AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS host, CAST(ts AS DATE) AS day
  FROM events WHERE user_id IS NOT NULL)"""
USER_KEYS = "user_id, device_id, browser_type"


def _calendar(since: str, through: str) -> str:
    return f"""
calendar AS (
  SELECT CAST({since} + CAST(unnest(range(0, CAST({through} - {since} AS BIGINT) + 1)) AS INTEGER) AS DATE) AS date)"""


def _lists(days: str, keys: str, since: str, through: str, order: str, having: str = "") -> str:
    return f"""
WITH {days}, {_calendar(since, through)}
SELECT {keys}, string_agg(strftime(day, '%Y-%m-%d'), ',' ORDER BY day {order}) AS dates_active,
       CAST(count(*) AS BIGINT) AS n_days, strftime(date, '%Y-%m-%d') AS date
FROM days JOIN calendar ON day <= date
GROUP BY {keys}, calendar.date {having}"""


STEP_DAY = "DATE '2024-01-16'"
ORACLE_SQL["user_datelist_step"] = _lists(USER_DAYS, USER_KEYS, STEP_DAY, STEP_DAY, "DESC")
ORACLE_SQL["user_datelist_active_only"] = _lists(
    USER_DAYS, USER_KEYS, STEP_DAY, STEP_DAY, "DESC", "HAVING max(day) = calendar.date"
)
ORACLE_SQL["user_datelist_history"] = _lists(
    USER_DAYS, USER_KEYS, FIRST_DAY, LAST_DAY, "DESC"
)
ORACLE_SQL["host_datelist_step"] = _lists(HOST_DAYS, "host", STEP_DAY, STEP_DAY, "ASC")
ORACLE_SQL["host_datelist_history"] = _lists(HOST_DAYS, "host", FIRST_DAY, LAST_DAY, "ASC")


def _bitmap(weight: str, day: str = LAST_DAY) -> str:
    return f"""
WITH {USER_DAYS},
bits AS (
  SELECT {USER_KEYS}, CAST(sum({weight}) AS BIGINT) AS datelist_int
  FROM (SELECT *, CAST({day} - day AS BIGINT) AS back FROM days WHERE day <= {day}) AS aged
  GROUP BY {USER_KEYS})
SELECT *, right(repeat('0', 32) || bin(datelist_int), 32) AS bits, strftime({day}, '%Y-%m-%d') AS date FROM bits"""


NEWEST_HIGHEST = "CASE WHEN back BETWEEN 0 AND 31 THEN CAST(pow(2, 31 - back) AS BIGINT) ELSE 0 END"
ORACLE_SQL["datelist_bitmap"] = _bitmap(NEWEST_HIGHEST)
ORACLE_SQL["datelist_bitmap_step"] = _bitmap(NEWEST_HIGHEST, STEP_DAY)
ORACLE_SQL["datelist_bitmap_shifted"] = _bitmap(
    "CASE WHEN back BETWEEN 1 AND 31 THEN CAST(pow(2, 32 - back) AS BIGINT) ELSE 0 END"
)

# Monthly reduced facts.


MONTH_OF = "CAST(date_trunc('month', {}) AS DATE)"


def _monthly(since: str, through: str, empty: str = "'-'") -> str:
    return f"""
WITH daily AS (
  SELECT event_type || '-' || user_id AS host, CAST(ts AS DATE) AS day, count(*) AS hits,
         count(DISTINCT event_id % 4) AS visitors
  FROM events WHERE CAST(ts AS DATE) >= {MONTH_OF.format(through)} GROUP BY ALL),
hosts AS (SELECT host, min(day) AS first_day FROM daily GROUP BY host),
{_calendar(since, through)},
month_days AS (
  SELECT CAST({MONTH_OF.format(through)} + CAST(range AS INTEGER) AS DATE) AS day FROM range(0, 31)),
cells AS (
  SELECT h.host, h.first_day, c.date, m.day, d.hits, d.visitors
  FROM hosts h JOIN calendar c ON h.first_day <= c.date JOIN month_days m ON m.day <= c.date
  LEFT JOIN daily d ON d.host = h.host AND d.day = m.day)
SELECT host,
       string_agg(coalesce(CAST(hits AS VARCHAR), {empty}), ',' ORDER BY day) AS hit_array,
       string_agg(coalesce(CAST(visitors AS VARCHAR), {empty}), ',' ORDER BY day)
         AS unique_visitors,
       CAST(count(*) AS BIGINT) AS n_days,
       strftime({MONTH_OF.format(through)}, '%Y-%m-%d') AS month_start,
       strftime(first_day, '%Y-%m-%d') AS first_found_date,
       strftime(date, '%Y-%m-%d') AS date_partition
FROM cells GROUP BY host, first_day, date"""


YESTERDAY = "DATE '2024-01-15'"
ORACLE_SQL["monthly_reduced_history"] = _monthly(MONTH_OF.format(LAST_DAY), LAST_DAY)
ORACLE_SQL["monthly_reduced_step"] = _monthly(STEP_DAY, STEP_DAY)
ORACLE_SQL["monthly_reduced_zero_filled"] = _monthly(STEP_DAY, STEP_DAY, "'0'")
UPDATED = f"""
WITH snapshots AS ({_monthly(YESTERDAY, STEP_DAY)}),
active AS (
  SELECT DISTINCT event_type || '-' || user_id AS host FROM events
  WHERE CAST(ts AS DATE) = DATE '2024-01-16'),
updated AS (
  SELECT * FROM snapshots
  WHERE (date_partition = '2024-01-16') = (host IN (SELECT host FROM active)))"""
ORACLE_SQL["monthly_upsert"] = f"{UPDATED} SELECT * FROM updated"
ORACLE_SQL["monthly_upsert_versions"] = f"""{UPDATED}
SELECT *, 1 AS version FROM snapshots WHERE date_partition = '2024-01-15'
UNION ALL SELECT *, 2 AS version FROM updated"""
ORACLE_SQL["stored_upsert"] = f"""{UPDATED}
SELECT * FROM snapshots WHERE date_partition = '2024-01-15'
UNION ALL SELECT * REPLACE ('2024-01-16' AS date_partition) FROM updated"""

# Joins.

ORACLE_SQL["join_without_auto_broadcast"] = """
SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n_orders, round(sum(o_totalprice), 2) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"""
ORACLE_SQL["broadcast_lookup_join"] = """
SELECT c_custkey, c_nationkey + 5 AS c_nationkey, n_name AS name
FROM customer LEFT JOIN nation ON c_nationkey + 5 = n_nationkey"""
ORACLE_SQL["csv_lookup_join"] = """
SELECT c_nationkey, c_custkey, c_name, n_name AS name
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
ORACLE_SQL["bucketed_match_join"] = """
SELECT a.l_suppkey AS player_gamertag_medal, a.l_partkey AS medal_id, a.l_linenumber AS count,
       b.l_orderkey AS match_id, b.l_suppkey AS player_gamertag,
       CAST(b.l_quantity AS INTEGER) AS player_total_kills, o_orderpriority AS playlist_id,
       o_custkey % 20 AS map_variant_id, o_orderstatus = 'F' AS is_team_game
FROM lineitem a LEFT JOIN lineitem b ON a.l_orderkey = b.l_orderkey
LEFT JOIN orders ON b.l_orderkey = o_orderkey"""
ORACLE_SQL["location_enrichment"] = """
SELECT CAST(user_id AS VARCHAR) AS ip, event_id,
       CASE WHEN n_name IS NULL THEN '{}'
            ELSE '{"country":"' || r_name || '","state":"' || n_name || '","city":""}' END AS geodata
FROM events LEFT JOIN nation ON user_id = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey"""
ORACLE_SQL["event_enrichment"] = """
WITH device_events AS (
  SELECT event_id, user_id, ts, user_id * 3 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS device_id
  FROM events),
versions AS (
  SELECT p_partkey // 4 AS device_id, DATE '2023-12-25' + CAST(p_partkey % 4 * 10 AS INTEGER) AS since,
         p_type AS browser_type, split_part(p_name, ' ', 2) AS device_type, split_part(p_name, ' ', 1) AS os_type
  FROM part),
held AS (
  SELECT *, lead(since) OVER (PARTITION BY device_id ORDER BY since) AS until FROM versions)
SELECT event_id, user_id, device_id, browser_type, device_type, os_type
FROM device_events JOIN held USING (device_id)
WHERE CAST(ts AS DATE) = DATE '2024-01-16' AND user_id IS NOT NULL
  AND ts >= since AND (until IS NULL OR ts < until)"""

# Rankings.

KILLS = """
SELECT l_suppkey AS player_gamertag, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS num_events,
       CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS total,
       sum(l_quantity) / count(DISTINCT l_orderkey) AS average
FROM lineitem GROUP BY l_suppkey"""
ORACLE_SQL["average_kills"] = KILLS
ORACLE_SQL["top_average_kills"] = f"{KILLS} ORDER BY average DESC, player_gamertag LIMIT 1"
ORACLE_SQL["average_kills_joined_grain"] = """
SELECT b.l_suppkey AS player_gamertag, CAST(count(b.l_orderkey) AS BIGINT) AS num_events,
       CAST(sum(CAST(b.l_quantity AS INTEGER)) AS BIGINT) AS total,
       sum(b.l_quantity) / count(b.l_orderkey) AS average
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY b.l_suppkey"""
ORACLE_SQL["most_played_playlist"] = """
SELECT o_orderpriority AS playlist_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS num_keys
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_orderpriority ORDER BY num_keys DESC, playlist_id LIMIT 1"""
ORACLE_SQL["most_played_map"] = """
SELECT o_custkey % 20 AS map_variant_id, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS num_keys
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY o_custkey % 20 ORDER BY num_keys DESC, map_variant_id LIMIT 1"""
ORACLE_SQL["map_with_most_medals"] = """
SELECT o_custkey % 20 AS map_variant_id, CAST(sum(l_linenumber) AS BIGINT) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
WHERE p_name = 'red plate' GROUP BY o_custkey % 20
ORDER BY total DESC, map_variant_id LIMIT 1"""
ORACLE_SQL["map_with_most_medals_joined_grain"] = """
SELECT o_custkey % 20 AS map_variant_id, CAST(sum(a.l_linenumber) AS BIGINT) AS total
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
JOIN orders ON b.l_orderkey = o_orderkey JOIN part ON a.l_partkey = p_partkey
WHERE p_name = 'red plate' GROUP BY o_custkey % 20
ORDER BY total DESC, map_variant_id LIMIT 1"""

# Layout: what holds for every layout, whatever the order of the rows that come in.

ORACLE_SQL["layout_rows"] = """
SELECT layout, CAST(count(*) AS BIGINT) AS rows
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
CROSS JOIN (VALUES ('none'), ('playlist'), ('map'), ('player')) AS names(layout)
GROUP BY layout"""

ORACLE_SQL["layout_sizes"] = """
SELECT layout, CAST(count(*) AS BIGINT) AS rows,
       nullif(CAST(count(DISTINCT CASE layout WHEN 'playlist' THEN o_orderpriority
         WHEN 'map' THEN CAST(o_custkey % 20 AS VARCHAR)
         WHEN 'player' THEN CAST(l_suppkey AS VARCHAR) END) AS BIGINT), 0) AS keys,
       CASE WHEN layout <> 'none' THEN CAST(1 AS BIGINT) END AS files_of_a_key,
       CASE WHEN layout <> 'none' THEN CAST(0 AS BIGINT) END AS unsorted, true AS measured
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
CROSS JOIN (VALUES ('none'), ('playlist'), ('map'), ('player')) AS names(layout)
GROUP BY layout"""

# Lifecycle.


def _lifecycle(since: int | str, through: int | str) -> str:
    return f"""
WITH seasons AS (
  SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS player_name,
         CAST(year(o_orderdate) AS INTEGER) AS season
  FROM orders),
players AS (SELECT player_name, min(season) AS first_season FROM seasons GROUP BY player_name),
{_years(FIRST_YEAR, through)},
grid AS (
  SELECT player_name, first_season, current_year AS season
  FROM players JOIN years ON first_season <= current_year)
SELECT g.player_name, g.season,
  CASE WHEN g.season = g.first_season THEN 'New'
       WHEN now.season IS NOT NULL AND before.season IS NOT NULL THEN 'Continued Playing'
       WHEN now.season IS NOT NULL THEN 'Returned from Retirement'
       WHEN before.season IS NOT NULL THEN 'Retired'
       ELSE 'Stayed Retired' END AS status
FROM grid g
LEFT JOIN seasons now ON now.player_name = g.player_name AND now.season = g.season
LEFT JOIN seasons before ON before.player_name = g.player_name AND before.season = g.season - 1
WHERE g.season >= {since}"""


ORACLE_SQL["lifecycle_history"] = _lifecycle(FIRST_YEAR, LAST_YEAR)
ORACLE_SQL["lifecycle_step"] = _lifecycle(1999, 1999)
ORACLE_SQL["snapshot_store_fold"] = _lifecycle(FIRST_YEAR, LAST_YEAR)
ORACLE_SQL["snapshot_store_resumed"] = _lifecycle(FIRST_YEAR, LAST_YEAR)
ORACLE_SQL["snapshot_empty_rerun"] = _lifecycle(FIRST_YEAR, 1995)
ORACLE_SQL["snapshot_rewrite"] = _lifecycle(FIRST_YEAR, 1996)

# Groupings.

GAMES = """
games AS (
  SELECT o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date_est,
         CAST(year(o_orderdate) AS INTEGER) AS season, home_team_id,
         CAST(o_orderstatus = 'F' AS INTEGER) AS home_team_wins
  FROM orders
  JOIN (SELECT l_orderkey, min(l_suppkey) AS home_team_id FROM lineitem GROUP BY l_orderkey) AS home
    ON l_orderkey = o_orderkey)"""
ROLLUP = f"""{GAMES},
facts AS (
  SELECT l_partkey AS player_id, l_suppkey AS team_id, season, l_quantity AS pts, home_team_wins,
         CASE WHEN (l_suppkey = home_team_id) = (home_team_wins = 1)
              THEN l_orderkey || '/' || l_suppkey END AS won_game
  FROM lineitem LEFT JOIN games ON l_orderkey = game_id),
rolled AS (
  SELECT player_id, team_id, season,
         CAST(grouping(player_id, team_id, season) AS INTEGER) AS gid, sum(pts) AS total_points,
         CAST(count(DISTINCT won_game) AS BIGINT) AS total_wins,
         CAST(sum(home_team_wins) AS BIGINT) AS home_win_rows
  FROM facts
  GROUP BY GROUPING SETS ((player_id, team_id), (player_id, season), (team_id)))"""

ORACLE_SQL["grouping_rollup"] = f"WITH {ROLLUP} SELECT * FROM rolled"
ORACLE_SQL["top_scorer_for_one_team"] = f"""
WITH {ROLLUP} SELECT player_id, team_id, total_points FROM rolled WHERE gid = 1
ORDER BY total_points DESC NULLS LAST, player_id, team_id LIMIT 1"""
ORACLE_SQL["top_scorer_in_one_season"] = f"""
WITH {ROLLUP} SELECT player_id, season, total_points FROM rolled WHERE gid = 2
ORDER BY total_points DESC NULLS LAST, player_id, season LIMIT 1"""
ORACLE_SQL["team_with_most_wins"] = f"""
WITH {ROLLUP} SELECT team_id, total_wins FROM rolled WHERE gid = 5
ORDER BY total_wins DESC, team_id LIMIT 1"""

# Sequences.

ROLLED = """
rolling AS (
  SELECT team_id, count(*) FILTER (WHERE won) OVER (
    PARTITION BY team_id ORDER BY game_date_est, game_id
    ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS in_frame
  FROM team_games),
best AS (
  SELECT team_id, CAST(max(in_frame) AS BIGINT) AS max_in_stretch FROM rolling GROUP BY team_id)"""
HOME_GAMES = """
team_games AS (
  SELECT home_team_id AS team_id, game_date_est, game_id, home_team_wins = 1 AS won FROM games)"""
ALL_GAMES = """
team_games AS (
  SELECT DISTINCT l_suppkey AS team_id, game_date_est, game_id,
         (l_suppkey = home_team_id) = (home_team_wins = 1) AS won
  FROM lineitem JOIN games ON l_orderkey = game_id)"""

ORACLE_SQL["best_home_stretch"] = f"WITH {GAMES}, {HOME_GAMES}, {ROLLED} SELECT * FROM best"
ORACLE_SQL["best_stretch"] = f"WITH {GAMES}, {ALL_GAMES}, {ROLLED} SELECT * FROM best"
ORACLE_SQL["top_stretch"] = f"""
WITH {GAMES}, {ALL_GAMES}, {ROLLED}
SELECT * FROM best ORDER BY max_in_stretch DESC, team_id LIMIT 1"""

STREAKS = """
scores AS (
  SELECT l_partkey AS player_id, CAST(o_orderdate AS DATE) AS day, l_orderkey, l_linenumber,
         l_suppkey, coalesce(l_quantity > 10, false) AS met
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
islands AS (
  SELECT *, sum(CASE WHEN met THEN 0 ELSE 1 END) OVER (
    PARTITION BY player_id ORDER BY day NULLS LAST, l_orderkey, l_linenumber, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
  FROM scores),
streaks AS (
  SELECT player_id, strftime(min(day), '%Y-%m-%d') AS start_date,
         strftime(max(day), '%Y-%m-%d') AS end_date, CAST(count(*) AS BIGINT) AS streak_length
  FROM islands WHERE met GROUP BY player_id, island HAVING count(*) >= 2)"""

ORACLE_SQL["scoring_streaks"] = f"WITH {STREAKS} SELECT * FROM streaks"
ORACLE_SQL["longest_scoring_streaks"] = f"""
WITH {STREAKS},
placed AS (
  SELECT *, row_number() OVER (
    PARTITION BY player_id
    ORDER BY streak_length DESC, start_date NULLS LAST, end_date NULLS LAST) AS place
  FROM streaks)
SELECT player_id, start_date, end_date, streak_length FROM placed WHERE place = 1"""

# Windows over event time, which messages carry in milliseconds.

WEB = """
web AS (
  SELECT CAST(user_id AS VARCHAR) AS ip, event_type AS host, date_trunc('millisecond', ts) AS ts
  FROM events)"""
TUMBLING = f"""
WITH {WEB}
SELECT ip, host, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S.%g')
         AS window_start,
       CAST(count(*) AS BIGINT) AS num_logs
FROM web GROUP BY ip, host, time_bucket(INTERVAL 5 MINUTE, ts)"""


def _sessions(keys: str, gap: str) -> str:
    return f"""{WEB},
gaps AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) + INTERVAL {gap}
    THEN 0 ELSE 1 END AS starts
  FROM web),
numbered AS (
  SELECT *, sum(starts) OVER (
    PARTITION BY {keys} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session
  FROM gaps),
sessions AS (
  SELECT {keys}, min(ts) AS started, max(ts) + INTERVAL {gap} AS ended,
         CAST(count(*) AS BIGINT) AS num_logs
  FROM numbered GROUP BY {keys}, session)"""


SESSION_VIEW = """strftime(started, '%Y-%m-%d %H:%M:%S.%g') AS window_start,
  strftime(ended, '%Y-%m-%d %H:%M:%S.%g') AS window_end, num_logs"""

ORACLE_SQL["tumbling_counts"] = TUMBLING
ORACLE_SQL["session_counts"] = f"""
WITH {_sessions("ip, host", "5 MINUTE")} SELECT ip, host, {SESSION_VIEW} FROM sessions"""
ORACLE_SQL["host_session_counts"] = f"""
WITH {_sessions("host", "5 MINUTE")} SELECT host, {SESSION_VIEW} FROM sessions"""
ORACLE_SQL["average_session_by_ip_host"] = f"""
WITH {_sessions("ip, host", "6 HOUR")}
SELECT ip, host, avg(num_logs) AS avg_events, CAST(floor(avg(num_logs)) AS BIGINT) AS avg_events_int
FROM sessions WHERE host LIKE '%i%' GROUP BY ip, host"""
ORACLE_SQL["average_session_by_host"] = f"""
WITH {_sessions("ip, host", "6 HOUR")}
SELECT host, avg(num_logs) AS avg_events,
       CAST(floor(avg(num_logs)) AS BIGINT) AS avg_events_int
FROM sessions GROUP BY host"""

# A stream that is read to its end gives what the table gives.

ORACLE_SQL["streamed_tumbling_counts"] = ORACLE_SQL["tumbling_counts"]
ORACLE_SQL["streamed_keyed_counts"] = ORACLE_SQL["tumbling_counts"]
ORACLE_SQL["streamed_session_counts"] = ORACLE_SQL["host_session_counts"]
ORACLE_SQL["streamed_session_averages"] = ORACLE_SQL["average_session_by_host"]
ORACLE_SQL["streamed_running_averages"] = ORACLE_SQL["average_session_by_host"]
ORACLE_SQL["streamed_session_averages_by_ip_host"] = ORACLE_SQL["average_session_by_ip_host"]
