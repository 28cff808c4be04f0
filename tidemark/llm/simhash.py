"""Near-duplicates by SimHash: exact search within a Hamming radius over tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_rows, column, discard, gathered, lists, numbered, release, schema_of, slices, staged, unused
from tidemark.llm.components import components
from tidemark.llm.setjoin import candidates

SEED = 42
WORDS = 3
RADIUS = 2
TILE = 2048  # fingerprints of a tile: 16 KB
WIDE_RADIUS = 10  # of the search whose links are checked on the texts
CHECKED_WORDS = 5  # shingles of that check, and how similar their sets have to be
SIMILARITY = 0.8
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CHUNK = 1 << 16
ROWS_AT_ONCE = 64


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of the shingles of a text, repeats included; zero without words."""
    tokens = text.encode().translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    line, digest = b" ".join, xxhash.xxh64_intdigest
    shingles = map(line, zip(*(tokens[i:] for i in range(words)), strict=False))
    count = len(tokens) - words + 1
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, into: str = "_fp") -> DataFrame:
    """``docs`` with the fingerprint of the text as a signed long in ``into``, a name that no column of ``docs`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(t or "", words) for t in batch.column(text).to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(signed)], names=[*batch.schema.names, into]
            )

    return docs.mapInArrow(run, schema_of(docs, **{into: T.LongType()}))


def _parts(radius: int) -> int:
    """In how many parts the bits of a fingerprint are counted: with more, more cells are in reach, and smaller ones."""
    return 4 if radius <= 2 else 1


def _offsets(radius: int) -> list[int]:
    """Differences of cell numbers between cells that can hold fingerprints within the radius.

    A flipped bit changes one population count by one, so the counts of the parts differ by at most
    ``radius`` in total. One of each pair of opposite differences, and zero.
    """
    steps = range(-radius, radius + 1)
    near = [d for d in product(steps, repeat=_parts(radius)) if sum(map(abs, d)) <= radius]
    codes = [sum(x << (7 * i) for i, x in enumerate(d)) for d in near]
    return sorted(c for c in codes if c >= 0)


def tile_links(
    tiles_a: list[np.ndarray], tiles_b: list[np.ndarray], same: list[bool], radius: int
) -> tuple[list[int], list[int]]:
    """Links of tile pairs, reduced to stars: same components, at most a link for each fingerprint."""
    left: list[int] = []
    right: list[int] = []
    for a, b, own in zip(tiles_a, tiles_b, same, strict=True):
        a, b = a.view(np.uint64), b.view(np.uint64)
        near = np.zeros((len(a), len(b)), bool)
        for at in range(0, len(a), ROWS_AT_ONCE):
            differ = np.bitwise_count(a[at : at + ROWS_AT_ONCE, None] ^ b[None, :])
            near[at : at + ROWS_AT_ONCE] = differ <= radius
        if own:
            np.fill_diagonal(near, False)
        rows = np.flatnonzero(near.any(axis=1))
        open_rows = np.zeros(len(a), bool)
        open_rows[rows] = True
        for first in rows:
            if not open_rows[first]:
                continue
            found_a = np.zeros(len(a), bool)
            found_b = np.zeros(len(b), bool)
            fresh = np.array([first])
            while len(fresh):
                found_a[fresh] = True
                reached = near[fresh].any(axis=0) & ~found_b
                found_b |= reached
                fresh = np.flatnonzero(near[:, reached].any(axis=1) & ~found_a)
            open_rows &= ~found_a
            members = np.concatenate([a[found_a], b[found_b]])
            members = np.unique(members[members != a[first]]).view(np.int64)
            left.extend([int(a[first : first + 1].view(np.int64)[0])] * len(members))
            right.extend(members.tolist())
    return left, right


def closest_links(
    tiles_a: list[np.ndarray], tiles_b: list[np.ndarray], same: list[bool], radius: int
) -> tuple[list[int], list[int]]:
    """Links of every fingerprint of a tile pair with the closest one of the other tile, if within the radius."""
    left: list[int] = []
    right: list[int] = []
    for a, b, own in zip(tiles_a, tiles_b, same, strict=True):
        u, v = a.view(np.uint64), b.view(np.uint64)
        best = np.full(len(b), 65, np.uint8)
        who = np.zeros(len(b), np.int64)
        for at in range(0, len(u), ROWS_AT_ONCE):
            differ = np.bitwise_count(u[at : at + ROWS_AT_ONCE, None] ^ v[None, :])
            if own:
                step = np.arange(len(differ))
                differ[step, at + step] = 65
            rows = np.flatnonzero(differ.min(axis=1, initial=65) <= radius)
            if len(rows):
                left.extend(a[at + rows].tolist())
                right.extend(b[differ[rows].argmin(axis=1)].tolist())
                if not own:
                    least = differ[rows].argmin(axis=0)
                    value = differ[rows[least], np.arange(len(v))]
                    better = value < best
                    best[better], who[better] = value[better], (at + rows[least])[better]
        found = np.flatnonzero(best <= radius)
        left.extend(b[found].tolist())
        right.extend(a[who[found]].tolist())
    return left, right


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, links=tile_links) -> DataFrame:
    """Stored links (a, b) within ``radius`` bits: by default some that connect whatever all of them connect.

    ``prints`` has one row per fingerprint, ``_fp``. Tiles hold fingerprints of one cell, that is,
    with the same population counts, of their four quarters if the radius is small; a cell of many
    fingerprints has many tiles. A tile meets only the tiles of cells whose counts differ by at most the radius in total;
    all other tile pairs are skipped, and exactly, since each differing bit moves one count by one.
    Every pair of tiles is a row of a join on the cell, compared by exclusive-or and bit counts.
    """
    spark = prints.sparkSession
    parts = _parts(radius)
    mask = F.lit((1 << (64 // parts)) - 1 if parts > 1 else -1).cast("long")
    cell = F.lit(0)
    for i in range(parts):
        ones = F.bit_count(F.shiftrightunsigned("_fp", 64 // parts * i).bitwiseAND(mask)).cast("int")
        cell = cell + F.shiftleft(ones + F.lit(radius), 7 * i)
    placed = prints.select("_fp", cell.cast("int").alias("cell"))
    # At most 17 ** 4 cells, so this table is of bounded size.
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    number = F.pmod(F.xxhash64("_fp"), F.ceil(F.col("n") / F.lit(tile))).cast("int")
    tiles = staged(
        placed.join(F.broadcast(sizes), "cell")
        .groupBy("cell", number.alias("tile"))
        .agg(F.sort_array(F.collect_list("_fp")).alias("fps")),  # in order, so that ties fall alike in every run
        "tiles",
    )
    offsets = F.array(*(F.lit(o) for o in _offsets(radius)))
    sent = tiles.select(
        F.explode(F.transform(offsets, lambda o: F.col("cell") + o)).alias("cell"),
        F.col("cell").alias("from_cell"), F.col("tile").alias("from_tile"), F.col("fps").alias("from_fps"),
    )
    own = F.col("cell") == F.col("from_cell")
    pairs = (
        sent.join(tiles, "cell")
        .filter(~own | (F.col("from_tile") <= F.col("tile")))
        .select("from_fps", "fps", (own & (F.col("from_tile") == F.col("tile"))).alias("same"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = links(
                lists(batch.column("from_fps")), lists(batch.column("fps")),
                batch.column("same").to_pylist(), radius,
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    with arrow_rows(spark, 256):
        found = staged(pairs.mapInArrow(run, "a long, b long"), "links")
    discard(tiles)
    return found


def classes(prints: DataFrame, key: str, radius: int = RADIUS) -> DataFrame:
    """Rows (_fp, least): the smallest ``key`` of all rows connected with a fingerprint.

    ``prints`` has columns ``_fp`` and ``key``. Copies are merged per fingerprint before anything
    else, so a group of copies of any size is one row. ``key`` NULL never wins unless it is alone.
    """
    per_print = prints.groupBy("_fp").agg(F.min(key).alias("own"))
    member = components(near_links(per_print.select("_fp"), radius), "a", "b")
    joined = per_print.join(member.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", "own", F.coalesce("component", "_fp").alias("component")
    )
    least = joined.groupBy("component").agg(F.min("own").alias("least"))
    return joined.join(least, "component").select("_fp", "least")


def simhash_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    radius: int = RADIUS,
) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs``.

    Words are runs of bytes other than blank and the five ASCII control blanks, A-Z lower-cased.
    Text NULL, empty or blank: fingerprint zero, linked like any other. Repeated rows stay as many
    rows. A NULL key is never a component id unless no other key is in reach. Other columns of
    ``docs`` are not looked at.
    """
    rows = docs.select(column(key).alias("doc_id"), column(text).alias("text"))
    prints = staged(with_fingerprints(rows, words=words).select("doc_id", "_fp"), "prints")
    found = classes(prints, "doc_id", radius)
    return prints.join(found, "_fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )


def similar(a: str, b: str, words: int, similarity: float) -> bool:
    """Whether the sets of shingles have a Jaccard similarity of at least ``similarity``."""
    if a == b:
        return True
    sets = []
    for text in (a, b):
        tokens = text.encode().translate(LOWER).split()
        sets.append({tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))} if tokens else set())
    both = len(sets[0] & sets[1])
    return both >= similarity * (len(sets[0]) + len(sets[1]) - both)


def keep_one(
    docs: DataFrame,
    text: str = "text",
    words: int = WORDS,
    radius: int = WIDE_RADIUS,
    checked_words: int = CHECKED_WORDS,
    similarity: float = SIMILARITY,
) -> DataFrame:
    """The rows of ``docs`` without near copies: one row, the first as stored, of each group.

    Groups are connected by pairs whose sets of shingles of ``checked_words`` words have a similarity of ``similarity``,
    all of them. Rows of one text are merged first. Then fingerprints within a wide radius suggest copies: each is
    compared, on the texts, with the closest one of every tile, and every text with the first one of its own fingerprint.
    That joins large groups with a few comparisons for each text. Whatever it leaves apart goes through an exact join
    on shared shingles, so no pair depends on fingerprints.

    ``docs`` must be a stored table, read the same way each time. Rows without words are similar to each other only. Keys do not matter: repeated and NULL ones are compared like any
    other. All columns are kept as they are.
    """
    row = unused(docs, "_row")
    marked = numbered(docs, row)
    every = marked.select(F.col(row).alias("_row"), F.coalesce(column(text), F.lit("")).alias("text"))
    worded = F.col("text").rlike(r"[^ \t\n\x0B\f\r]")
    spark = docs.sparkSession
    same = F.when(worded, F.unhex(F.sha2("text", 256))).otherwise(F.lit(b"")).alias("same")
    keyed = staged(every.select("_row", same), "same")
    firsts = gathered(keyed.groupBy("same").agg(F.min("_row").alias("first")), "firsts")
    # Every later step reads these texts: one shuffle of the texts instead of one for each of them.
    texts = staged(every.join(firsts.select(F.col("first").alias("_row")), "_row", "left_semi"), "texts")
    release(spark)
    prints = staged(with_fingerprints(texts, "text", words).select("_row", "_fp"), "prints")
    per_print = gathered(prints.groupBy("_fp").agg(F.min("_row").alias("first")), "prints")
    links = near_links(per_print.select("_fp"), radius, links=closest_links)
    apart = links.select(F.least("a", "b").alias("_fp"), F.greatest("a", "b").alias("other")).distinct()
    others = per_print.select(F.col("_fp").alias("other"), F.col("first").alias("b"))
    pairs = (
        apart.join(per_print, "_fp").join(others, "other").select(F.col("first").alias("a"), "b")
        .union(prints.join(per_print, "_fp").filter("_row <> first").select("_row", "first"))
    )
    values = texts.select(F.col("_row").alias("a"), F.col("text").alias("text_a"))
    other_values = values.withColumnsRenamed({"a": "b", "text_a": "text_b"})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)
            found = pa.array([similar(a, b, checked_words, similarity) for a, b in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(found), batch.column("b").filter(found)], names=["a", "b"]
            )

    def checked(pairs: DataFrame) -> DataFrame:
        with arrow_rows(docs.sparkSession, 1000):
            joined = pairs.join(values, "a").join(other_values, "b")
            found = gathered(joined.mapInArrow(compare, "a long, b long"), "checked")
            release(spark)
            return found

    near = checked(pairs)
    discard(prints)
    rest = candidates(texts, components(near, "a", "b"), checked_words, similarity)
    release(spark)
    groups = components(near.union(checked(rest)), "a", "b")
    discard(texts)
    copies = keyed.join(firsts, "same").filter("_row <> first").select(F.col("_row").alias(row))
    gone = groups.filter("node <> component").select(F.col("node").alias(row)).union(copies)
    return marked.join(gone, row, "left_anti").select(*(column(c) for c in docs.columns))
