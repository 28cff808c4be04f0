"""Periodic runs of words: a suffix automaton, whose link tree is accessed as a link-cut tree.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. The states on the
path from the state of a prefix to the root are the suffixes of that prefix, and each carries its last occurrence.
Equal last occurrences form segments of the path, deeper ones being older, so a path segment is a preferred path of a
link-cut tree with one colour. Appending word i accesses its state: every segment it passes gives the longest suffix,
L words, that ended last at e, and is then recoloured with i. If the distance d = i - e is at most L, the L + d words
up to i have period d: at least a square, and d is their smallest period, since a smaller one would be a later
occurrence. Squares of one start and period, seen at every word of a run, extend each other to the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, slices

LEAST_WORDS = 6
LEAST_PERIODS = 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def suffix_automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Link and longest suffix of every state, and the state of every prefix. State 0 is the empty word."""
    link, longest, edges, prefixes = [-1], [0], [{}], []
    last = 0
    for word in words:
        state = len(link)
        link.append(0)
        longest.append(longest[last] + 1)
        edges.append({})
        at = last
        while at >= 0 and word not in edges[at]:
            edges[at][word] = state
            at = link[at]
        if at >= 0:
            target = edges[at][word]
            if longest[target] == longest[at] + 1:
                link[state] = target
            else:
                clone = len(link)
                link.append(link[target])
                longest.append(longest[at] + 1)
                edges.append(edges[target].copy())
                link[target] = link[state] = clone
                while at >= 0 and edges[at].get(word) == target:
                    edges[at][word] = clone
                    at = link[at]
        prefixes.append(state)
        last = state
    return link, longest, prefixes


def squares(words: list[int], least_words: int, least_periods: int) -> dict[tuple[int, int], int]:
    """End (exclusive) of the periodic stretch of every (start, period), long enough, found by accesses.

    The link tree is complete before the first access, so no node is linked or cut; its preferred paths are splay
    trees by depth. ``colour`` holds at the root of each splay tree, for all its nodes.
    """
    up, longest, prefixes = suffix_automaton(words)  # up: parent in the splay tree, or of the whole path
    n = len(up)
    left, right, colour = [-1] * n, [-1] * n, [-1] * n
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes):
        below, x = -1, state
        while x >= 0:
            # Splay x to the root of its path.
            y = up[x]
            inner = y >= 0 and (left[y] == x or right[y] == x)
            if inner:
                while True:
                    z = up[y]
                    deep = z >= 0 and (left[z] == y or right[z] == y)
                    on_left = left[y] == x
                    if deep and (left[z] == y) == on_left:  # rotate y over z first
                        if on_left:
                            c = left[z] = right[y]
                            right[y] = z
                        else:
                            c = right[z] = left[y]
                            left[y] = z
                        if c >= 0:
                            up[c] = z
                        w = up[y] = up[z]
                        up[z] = y
                        higher = w >= 0 and (left[w] == z or right[w] == z)
                        if higher:
                            if left[w] == z:
                                left[w] = y
                            else:
                                right[w] = y
                        else:
                            colour[y] = colour[z]
                        z, deep = w, higher
                        again = False
                    else:
                        again = deep
                    if on_left:
                        c = left[y] = right[x]
                        right[x] = y
                    else:
                        c = right[y] = left[x]
                        left[x] = y
                    if c >= 0:
                        up[c] = y
                    up[x] = z
                    up[y] = x
                    if deep:
                        if left[z] == y:
                            left[z] = x
                        else:
                            right[z] = x
                    else:
                        colour[x] = colour[y]
                    if again or deep:
                        y = z
                        continue
                    break
            end = colour[x]
            if end >= 0:
                size, distance = longest[x], i - end
                total = size + distance
                if size >= distance and total >= least_words and total >= least_periods * distance:
                    found[i + 1 - total, distance] = i + 1
            c = right[x]
            if c >= 0:
                colour[c] = end  # what is deeper keeps its last occurrence
            right[x] = below
            below, x = x, up[x]
        colour[below] = i
    return found


def runs_of(
    words: list[bytes], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS
) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run with at least so many words and periods, by start, then period."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")
    known: dict[bytes, int] = {}
    found = squares([known.setdefault(w, len(known)) for w in words], least_words, least_periods)
    return [(start, end - start, period) for (start, period), end in sorted(found.items())]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what repeats the first period of a run, joined by a space."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed), one for each row of ``docs``.

    Words are what stands between ASCII blanks (space, tab, line feeds). ``runs`` are all runs with at least
    ``least_words`` words and ``least_periods`` periods, by start and period; ``collapsed`` is the text without their
    repetitions. A NULL or empty text has no words, no runs and an empty ``collapsed``. Rows do not depend on one
    another: repeated rows and NULL keys are kept as they are, an empty table gives no rows, and other columns are not
    read, whatever their names. A text is one row and handled whole: the automaton of the longest text has to fit a
    worker, about 1 KB for each of its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, runs, texts = [], [], []
            for value in batch.column("text").to_pylist():
                words = (value or b"").split()  # of bytes: splits at ASCII blanks alone
                found = runs_of(words, least_words, least_periods)
                counts.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                texts.append(collapsed(words, found))
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    rows = docs.select(column(key).alias("doc_id"), column(text).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: str = "runs") -> F.Column:
    """The run with most words; of equal ones the first, then that with the smallest period. NULL without runs."""
    order = F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run")))
    return F.array_max(order)["run"]
