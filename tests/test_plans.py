"""What reaches the scan and what is shuffled."""

import datetime as dt
import re

import pytest
from helpers import plan

from tidemark.operators import cumulative, datelist, joins, monthly, scd
from tidemark.plans.session import join_policy, set_join_policy
from tidemark.queries import QUERIES
from tidemark.sources.tables import Tables
from tidemark.streaming import windows

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(join_policy(spark, auto_broadcast=False), FOLDER)


def exchanges(df):
    return len(re.findall(r"\bExchange\b", plan(df)))


def formatted(df):
    import io
    from contextlib import redirect_stdout

    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_day_filter_reaches_the_scan(tables):
    day = dt.date(2024, 1, 16)
    text = formatted(joins.enrich_events(tables.events(), tables.devices(), day))
    assert "GreaterThanOrEqual(ts,2024-01-16T00:00)" in text
    assert "LessThan(ts,2024-01-17T00:00)" in text


def test_only_needed_columns_are_read(tables):
    text = formatted(monthly.daily_figures(tables.user_hosts()))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["ts:timestamp_ntz,user_id:bigint"]


def test_history_adds_no_shuffle_to_its_averages(tables):
    ratings = tables.actor_ratings()
    # Averages per year, then the years of an entity; the intervals reuse that partitioning.
    states = cumulative.entity_history(ratings, 2001, with_items=False)
    assert exchanges(states) == 2
    assert exchanges(scd.scd2_backfill(states, 2001)) == 2


def test_items_are_shuffled_once(tables):
    films = tables.actor_films().cache()
    whole = cumulative.entity_history(films, 2001)
    assert exchanges(whole) - exchanges(films) == 1
    films.unpersist()


def test_sessions_and_streaks_are_one_shuffle(tables):
    events = tables.web_events()
    assert exchanges(windows.session_counts(events, max_rows=None)) == 1
    text = plan(windows.session_counts(events, max_rows=None))
    assert text.count("Sort [") == 1


def test_date_lists_shuffle_only_distinct_days(tables):
    days = datelist.active_days(tables.user_hosts(), ["host"])
    whole = datelist.datelist_history(days, ["host"], dt.date(2024, 1, 30))
    text = plan(whole)
    assert text.rindex("HashAggregate") > text.rindex("Exchange")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"layout_rows", "layout_sizes"}))
def test_no_query_needs_a_cross_join_or_a_single_task(spark, name):
    """No product of two tables and no ordered window over a whole table."""
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A global aggregate gathers one row per task; nothing else may meet in one place.
    assert "SinglePartition" not in text or name == "profile_devices"


def test_policy_does_not_leak(spark):
    apart = set_join_policy(spark.newSession(), False)
    assert apart.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_partitions_grow_with_the_input(spark):
    """A session for a large table has a partition for every 16 MB of it, and merges none beyond 32 MB."""
    from tidemark.plans.session import sized_session

    key, before = "spark.sql.shuffle.partitions", int(spark.conf.get("spark.sql.shuffle.partitions"))
    large, small = sized_session(spark, 640 << 20), sized_session(spark, 1)
    assert int(large.conf.get(key)) == 40 and int(small.conf.get(key)) == before == int(spark.conf.get(key))
    assert large.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "32m"
    rows = large.range(2_000_000).selectExpr("id % 1000003 AS k").groupBy("k").count()
    assert rows.filter("count > 1").count() == 999_997
