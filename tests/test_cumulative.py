import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators.cumulative import cumulate_entities, entity_history
from tidemark.operators.profile import key_violations
from tidemark.plans.session import shared_dir
from tidemark.sources.snapshots import fold_periods

FIRST, LAST = 1990, 1995


@pytest.fixture(scope="module")
def films(spark):
    rng = random.Random(1)
    data = []
    for n in range(300):
        # One actor has a third of all films.
        actor = 0 if n % 3 == 0 else rng.randrange(1, 20)
        rating = rng.choice([5.0, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, None])
        year = rng.choice(range(FIRST, LAST + 1))
        data.append((f"name{actor}", f"a{actor}", f"film{n}", year, n, rating, f"f{n:03d}"))
    return spark.createDataFrame(data, schemas.ACTOR_FILMS).cache()


def test_step_by_hand(spark):
    films = spark.createDataFrame(
        [("A", "a", "one", 1990, 1, 9.0, "f1"), ("A", "a", "two", 1990, 1, 7.0, "f2"),
         ("B", "b", "three", 1991, 1, None, "f3"), ("C", "c", "four", 1990, 1, 6.0, "f4"),
         ("C", "c", "five", 1991, 1, 8.5, "f5")],
        schemas.ACTOR_FILMS,
    )
    start = spark.createDataFrame([], schemas.ACTORS)
    first = cumulate_entities(start, films, 1990)
    second = cumulate_entities(first, films, 1991)
    ids = F.transform("films", lambda f: f["filmid"]).alias("ids")
    assert rows(first.select("actorid", ids, "quality_class", "is_active", "current_year")) == [
        ("a", ["f1", "f2"], "good", True, 1990), ("c", ["f4"], "bad", True, 1990)
    ]
    assert rows(second.select("actorid", ids, "quality_class", "is_active", "current_year")) == [
        ("a", ["f1", "f2"], "good", False, 1991), ("b", ["f3"], None, True, 1991),
        ("c", ["f4", "f5"], "star", True, 1991),
    ]


@pytest.mark.parametrize("pages", [1, 5])
def test_fold_equals_history(spark, films, pages):
    folded = fold_periods(
        spark, shared_dir(spark, "actors"), schemas.ACTORS, "current_year", range(FIRST, LAST + 1),
        lambda stored, year: cumulate_entities(stored, films, year, pages=pages),
    )
    whole = entity_history(films, LAST, pages=pages)
    assert rows(folded, *whole.columns) == rows(whole)
    assert key_violations(whole, schemas.KEYS["actors"]).isEmpty()


def test_pages_hold_every_film_once_and_stay_small(spark, films):
    paged = entity_history(films, LAST, pages=5, since=LAST)
    flat = entity_history(films, LAST, since=LAST)
    assert paged.count() == 5 * flat.count()
    one = paged.select("actorid", F.explode("films").alias("f")).select("actorid", "f.*")
    other = flat.select("actorid", F.explode("films").alias("f")).select("actorid", "f.*")
    assert rows(one) == rows(other)
    attributes = ["actorid", "actor", "quality_class", "is_active"]
    for page in range(5):
        assert rows(paged.filter(F.col("page") == page), *attributes) == rows(flat, *attributes)
    largest = paged.filter("actorid = 'a0'").agg(F.max(F.size("films"))).first()[0]
    assert largest < 100


def test_states_without_items(films):
    with_items = entity_history(films, LAST)
    without = entity_history(films, LAST, with_items=False)
    assert rows(with_items, *without.columns) == rows(without)
