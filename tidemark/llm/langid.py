"""Language identification with rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import column, schema_of, slices

UNKNOWN = "und"
PROFILE = 400  # n-grams of a profile
BLANK = 1  # not 0, which would make a gram with a leading blank the code of the shorter one
ORDERS = (1, 2, 3)  # lengths of n-grams; three code points of 21 bits fill a long
FLUSH = 500_000  # distinct n-grams that a training task holds before it emits their counts
LONGEST = 1 << 20  # code points counted at once; the counts of longer texts are added up


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, and their counts; empty if it has no letter.

    Letters are lower-cased; every run of other characters, and either end, is one blank.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, BLANK).astype(np.int64)
    points = np.concatenate(([BLANK], points, [BLANK]))
    points = points[np.concatenate(([True], (points[1:] > BLANK) | (points[:-1] > BLANK)))]
    if points.max() == BLANK:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found: dict[int, int] = {}
    parts = []
    for at in range(0, len(points), LONGEST):
        for n in ORDERS:
            window = points[at : at + LONGEST + n - 1]
            if len(window) < n:
                continue
            codes = window[: len(window) - n + 1].copy()
            for i in range(1, n):
                codes = (codes << 21) | window[i : len(window) - n + 1 + i]
            if n == 1:
                codes = codes[codes > BLANK]
            parts.append(np.unique(codes, return_counts=True))
    if len(points) <= LONGEST:  # no two lengths have a code in common
        codes = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
    else:
        for codes, counts in parts:
            for code, count in zip(codes.tolist(), counts.tolist(), strict=True):
                found[code] = found.get(code, 0) + count
        codes, counts = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams first, smaller numbers first among equals."""
    return codes[np.lexsort((codes, -counts))[:size]]


def train_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE
) -> dict[str, list[int]]:
    """Profile of every language: its ``size`` most frequent n-grams over all rows of ``docs``.

    Rows with NULL language or without letters teach nothing. Tasks add up counts before the
    shuffle, and the driver gets ``size`` numbers for each language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, dict[int, int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(k, c, n) for k, own in sums.items() for c, n in own.items()]
            sums.clear()
            names, codes, counts = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())],
                names=["lang", "gram", "n"],
            )

        for batch in slices(batches):
            pending: dict[str, list] = {}
            for name, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                codes, counts = grams(value)
                if len(codes):
                    pending.setdefault(name, []).append((codes, counts))
            for name, parts in pending.items():
                codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                total = np.bincount(where, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
                own = sums.setdefault(name, {})
                for code, n in zip(codes.tolist(), total.tolist(), strict=True):
                    own[code] = own.get(code, 0) + n
            if sum(map(len, sums.values())) > FLUSH:
                yield flush()
        yield flush()

    rows = docs.select(column(lang).alias("lang"), column(text).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        rows.mapInArrow(count, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= size)
    )
    profiles: dict[str, list[int]] = {}
    for row in sorted(top.collect(), key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Classifier:
    """Out-of-place distances of a text to a set of profiles."""

    def __init__(self, profiles: Mapping[str, list[int]], size: int = PROFILE):
        self.size = size
        self.names = sorted(profiles)
        every = sorted({g for p in profiles.values() for g in p})
        self.codes = np.array(every, np.int64)
        place = {g: i for i, g in enumerate(every)}
        # Rank of each known n-gram in each language; the last column is for unknown ones.
        self.ranks = np.full((len(self.names), len(every) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            for rank, gram in enumerate(profiles[name]):
                self.ranks[i, place[gram]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language with the smallest distance, the first by name among equals, and its closeness.

        Closeness is one less the distance over the largest possible one. Without letters, or
        without any profile, the language is ``und`` and the closeness 0.
        """
        codes, counts = grams(text or "")
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == own[known]
        ranks = self.ranks[:, np.where(known, at, len(self.codes))]
        out = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        distance = out.sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], 1.0 - float(distance[best]) / (self.size * len(own))


def with_language(
    docs: DataFrame, profiles: Mapping[str, list[int]], text: str = "text", size: int = PROFILE,
    into: tuple[str, str] = ("_lang", "_score"),
) -> DataFrame:
    """``docs`` with language and score as the columns ``into``, from the text alone.

    Text NULL or without letters: und, 0. A column of ``docs`` must not have one of the new names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Classifier(profiles, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column(text).to_pylist()]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *added], names=[*batch.schema.names, *into]
            )

    return docs.mapInArrow(run, schema_of(docs, **dict(zip(into, (T.StringType(), T.DoubleType()), strict=True))))


def held_out(key: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text falls into the held-out fold; a NULL key is never learned from."""
    crc = F.crc32(column(key).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(True))


def identify(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    folds: int = 4,
    fold: int = 2,
    size: int = PROFILE,
) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row of ``docs``, repeated rows included.

    Profiles are counted over all rows outside the held-out fold. Predictions see the text only.
    An empty table gives no rows; without training rows every language is ``und``.
    """
    rows = docs.select(
        column(key).alias("doc_id"), column(text).alias("text"), column(lang).alias("lang"),
        held_out(key, folds, fold).alias("held_out"),
    )
    profiles = train_profiles(rows.filter("NOT held_out"), size=size)
    scored = with_language(rows.select("doc_id", "held_out", "text"), profiles, size=size)
    return scored.select(
        "doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )
