"""Importance resampling towards a target: hashed runs of words, a gain for each bucket, Gumbel scores.

A feature is a run of 1 to 3 words, its bucket the CRC-32 of its bytes. A head vocabulary spares most of that work: the
CRC of a text that goes on with a known word follows from the CRC so far and that of the word (shifting a CRC over n
bytes is linear, a table for each n), so features of frequent words are put together from broadcast word states, and
frequent pairs have their state and bucket in a table. Features with any other word take the CRC of their bytes. Both
are exact, so the vocabulary decides speed alone, never a result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, discard, staged

BUCKETS = 10_000
LONGEST = 3
HEAD_WORDS = 32_768
HEAD_PAIRS = 65_536
HEAD_BYTES = 40  # longer words are never in the head
COUNTED = 1 << 18  # words, and pairs, that a task counts at a time
LEAST = 8  # times that a group of texts has a word, or pair, that may be in the head
GROUP = 2 << 20  # bytes of text that are handled together
SLOTS = 1 << 18
POLYNOMIAL = 0xEDB88320  # of CRC-32

#: Letters A-Z to lower case; whatever is neither letter, digit nor outside ASCII to a blank.
BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def shifts(longest: int) -> np.ndarray:
    """Tables [n][k][b]: the CRC whose only byte, the k-th, is b, after n zero bytes more."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    found = [now]
    for _ in range(longest):
        now = (now >> np.uint32(8)) ^ step[now & np.uint32(255)]
        found.append(now)
    return np.stack(found)


class Head:
    """CRC states of frequent words and of frequent pairs of them."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]]):
        self.number = {w: i for i, w in enumerate(words)}
        self.state = np.array([zlib.crc32(w) for w in words] or [0], np.uint32)
        self.spaced = np.array([zlib.crc32(b" " + w) for w in words] or [0], np.uint32)
        self.size = np.array([len(w) + 1 for w in words] or [1], np.int64)
        self.tables = shifts(HEAD_BYTES + 1)
        known = [(self.number[a], self.number[b], a, b) for a, b in pairs if a in self.number and b in self.number]
        self.key = np.full(SLOTS, -1, np.int64)
        self.pair_state = np.zeros(SLOTS, np.uint32)
        for a, b, first, second in reversed(known):  # of pairs with one slot the most frequent stays
            key = a << 32 | b
            slot = int(self.slot(np.array([key]))[0])
            self.key[slot], self.pair_state[slot] = key, zlib.crc32(first + b" " + second)
        self.pair_bucket = (self.pair_state % BUCKETS).astype(np.int32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def extend(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """States after a blank and a head word more."""
        size, t = self.size[word], self.tables
        return (
            t[size, 0, state & 255] ^ t[size, 1, state >> 8 & 255] ^ t[size, 2, state >> 16 & 255] ^ t[size, 3, state >> 24]
        ) ^ self.spaced[word]

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States and buckets of pairs of head words: looked up, or put together."""
        keys = first << 32 | second
        slots = self.slot(keys)
        state, bucket = self.pair_state[slots], self.pair_bucket[slots]
        rare = np.flatnonzero(self.key[slots] != keys)
        state[rare] = self.extend(self.state[first[rare]], second[rare])
        bucket[rare] = state[rare] % BUCKETS
        return state, bucket

    def buckets(self, words: list[bytes], place: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For runs of 1, 2 and 3 words: the numbers of their last words, and their buckets.

        ``place`` counts the words before each word in its own text; no run begins in another text.
        """
        n = len(words)
        ids = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, n)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        begins = np.r_[0, ends[:-1] + 1]
        text = memoryview(b" ".join(words))
        head = ids >= 0
        known = head  # runs that end here and have head words only
        state = np.zeros(n, np.uint32)
        found = []
        for size in range(1, LONGEST + 1):
            own = place >= size - 1
            now, bucket = np.zeros(n, np.uint32), np.zeros(n, np.int32)
            if size > 1:
                known = head & own & np.r_[False, known[:-1]]
            at = np.flatnonzero(known)
            if size == 1:
                now[at] = self.state[ids[at]]
                bucket[at] = now[at] % BUCKETS
            elif size == 2:
                now[at], bucket[at] = self.pairs(ids[at - 1], ids[at])
            else:
                now[at] = self.extend(state[at - 1], ids[at])
                bucket[at] = now[at] % BUCKETS
            tail = np.flatnonzero(own & ~known)
            spans = zip(begins[tail - size + 1].tolist(), ends[tail].tolist(), strict=True)
            bucket[tail] = [zlib.crc32(text[a:b]) % BUCKETS for a, b in spans]
            state = now
            last = np.flatnonzero(own)
            found.append((last, bucket[last]))
        return found


def pieces(text: bytes, size: int = GROUP) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in parts of about ``size`` bytes, and how many of them the part before had too."""
    text = text.translate(BYTES)
    at, carried = 0, []
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        words = carried + text[at:end].split()
        yield words, len(carried)
        at, carried = end, words[1 - LONGEST :]


def groups(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words of several texts together: the words, their place in the text or part, their row, whether they are new."""
    words, places, rows, fresh = [], [], [], []
    for row, text in enumerate(texts):
        for own, carried in pieces(text or b""):
            words += own
            places.append(np.arange(len(own)))
            rows.append(np.full(len(own), row))
            fresh.append(np.arange(len(own)) >= carried)
            if len(words) > GROUP // 8:
                yield words, np.concatenate(places), np.concatenate(rows), np.concatenate(fresh)
                words, places, rows, fresh = [], [], [], []
    if words:
        yield words, np.concatenate(places), np.concatenate(rows), np.concatenate(fresh)


def batches_of(batches: Iterator[pa.RecordBatch], size: int = 4 * GROUP) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes of text, so that few texts are Python objects at a time."""
    for batch in batches:
        lengths = np.asarray(pa.compute.binary_length(batch.column("text")).fill_null(0))
        part = np.cumsum(lengths, dtype=np.int64) // size
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield batch.slice(a, b - a)


def _texts(docs: DataFrame, text: str, **more: Column) -> DataFrame:
    return docs.select(*(c.alias(n) for n, c in more.items()), column(text).cast("binary").alias("text"))


def frequent(words: list[bytes], place: np.ndarray, fresh: np.ndarray, least: int = LEAST) -> tuple[Counter, Counter]:
    """Words, and pairs of neighbours, that a group has ``least`` times or more.

    A pair is no more frequent than its words, so only pairs of frequent words are counted.
    """
    n = len(words)
    known: dict[bytes, int] = {}
    first = np.fromiter(map(known.setdefault, words, range(n)), np.int64, n)  # where each word stands first
    counts = np.bincount(first[fresh], minlength=n)
    often = counts >= least
    single = Counter({words[i]: int(counts[i]) for i in np.flatnonzero(often)})
    last = np.flatnonzero(fresh & (place > 0) & often[first])
    last = last[often[first[last - 1]]]
    codes, times = np.unique(first[last - 1] * n + first[last], return_counts=True)
    kept = times >= least
    double = Counter({
        (words[c // n], words[c % n]): m for c, m in zip(codes[kept].tolist(), times[kept].tolist(), strict=True)
    })
    return single, double


def train_head(docs: DataFrame, text: str = "text", words: int = HEAD_WORDS, pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words and pairs of all texts, at most so many.

    Tasks pass on what is frequent in some of their groups of texts, the most frequent first and as many as the head has
    places for; rarer words and pairs would gain nothing. As the head decides speed alone, no result depends on them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = Counter(), Counter()
        for batch in batches_of(batches):
            for own, place, _, fresh in groups(batch.column("text").to_pylist()):
                one, two = frequent(own, place, fresh)
                single.update(one)
                double.update(two)
                single, double = (c if len(c) < 2 * COUNTED else Counter(dict(c.most_common(COUNTED))) for c in (single, double))
        one = [(w, None, n) for w, n in single.most_common(words) if len(w) <= HEAD_BYTES]
        two = [(*p, n) for p, n in double.most_common(pairs) if max(map(len, p)) <= HEAD_BYTES]
        first, second, n = zip(*one, *two, strict=True) if one or two else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(n, pa.int64())],
            names=["first", "second", "n"],
        )

    found = _texts(docs, text).mapInArrow(count, "first binary, second binary, n long")
    octave = F.floor(F.log2("n") * 8).cast("int").alias("octave")  # eight for each doubling of the count
    summed = staged(found.groupBy("first", "second").agg(F.sum("n").alias("n")).select("*", octave), "head")
    sizes = summed.groupBy(F.col("second").isNotNull().alias("pair"), "octave").count().collect()

    def top(pair: bool, most: int) -> list:
        """The octaves from above that fit: the driver gets ``most`` rows at most."""
        total, least = 0, 1 << 30
        for row in sorted((r for r in sizes if r["pair"] == pair), key=lambda r: -r["octave"]):
            total += row["count"]
            if total > most:
                break
            least = row["octave"]
        rows = summed.filter((F.col("second").isNotNull() == pair) & (F.col("octave") >= least))
        return sorted(rows.collect(), key=lambda r: (-r["n"], r["first"], r["second"] or b""))

    one, two = top(False, words), top(True, pairs)
    return Head([bytes(r["first"]) for r in one], [(bytes(r["first"]), bytes(r["second"])) for r in two])


def bucket_totals(docs: DataFrame, head, text: str = "text") -> np.ndarray:
    """Features of all texts in every bucket. ``head`` is a broadcast ``Head``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches_of(batches):
            for words, place, _, fresh in groups(batch.column("text").to_pylist()):
                for last, bucket in head.value.buckets(words, place):
                    total += np.bincount(bucket[fresh[last]], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    found = _texts(docs, text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = np.zeros(BUCKETS, np.int64)
    for row in found.collect():  # a row for each bucket
        total[row["bucket"]] = row["n"]
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's share of each bucket to the source's, one added to each count."""
    many, few = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    ratios = ((float(t) + 1) * many / ((float(s) + 1) * few) for s, t in zip(source, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, head, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the sum of the gains of all features of each text."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            n = batch.num_rows
            n_words, n_features, weight = (np.zeros(n, np.int64) for _ in range(3))
            for words, place, row, fresh in groups(batch.column("text").to_pylist()):
                n_words += np.bincount(row[fresh], minlength=n)
                for last, bucket in head.value.buckets(words, place):
                    new = fresh[last]
                    own, last_row = gain[bucket[new]], row[last[new]]
                    n_features += np.bincount(last_row, minlength=n)
                    # Exact: sums of longs between the borders of rows.
                    border = np.flatnonzero(np.diff(last_row, prepend=-1))
                    if len(border):
                        weight[last_row[border]] += np.add.reduceat(own, border)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    rows = _texts(docs, text, doc_id=column(key))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)) for a number u between 0 and 1 that the key and the seed fix."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their number, from 1, in the given order: ranges sorted apart, and their sizes added up.

    The ranges are written, so a repeated task can't deal rows otherwise. The driver gets a number for each range.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    part, at = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    stored = staged(dealt.select("*", part.alias("_part"), (at + 1).alias("_at")), "ranked")
    sizes = dict(stored.groupBy("_part").count().collect())
    before, total = [], 0
    for p in range(parts):
        before.append(total)
        total += sizes.get(p, 0)
    offset = F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_part") + 1)
    return stored.withColumn(name, offset + F.col("_at")).drop("_part", "_at")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    seed: int = 42,
    least_words: int = 20,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of ``docs``.

    Words are runs of letters a-z (A-Z lower-cased), digits and characters outside ASCII. ``score`` is the weight with
    Gumbel noise; of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) with the
    highest scores are drawn and get ranks from 1, the others NULL. Ties go to the smaller key. NULL and empty texts
    have no features, weight 0 and are never drawn if ``least_words`` is positive. A NULL key has the noise of an empty
    one and comes last among equals; repeated rows are drawn apart, with ranks of their own. Empty tables give no rows;
    an empty target makes all buckets gain by their rarity. Texts are handled in parts, so their length is not bounded.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    head = spark.sparkContext.broadcast(train_head(docs, text))
    gain = gains(bucket_totals(docs, head, text), bucket_totals(target, head, target_text))
    found = weights(docs, gain, head, key, text)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    fit = (F.col("n_words") >= least_words).alias("_fit")
    # Written first: ranges are cut by a look at the rows, which would weigh all texts once more.
    scored = staged(found.select("doc_id", "n_features", "weight", score.alias("score"), fit), "scores")
    placed = ranked(scored, [F.desc("_fit"), F.desc("score"), F.col("doc_id").asc_nulls_last()])
    # Counted on what is written: documents that may be drawn come first.
    n = placed.filter("_fit").count()
    discard(scored)
    drawn = F.col("_fit") & (F.col("rank") <= n * percent // 100)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, for keys that no two rows share."""
    chosen = resample(docs, target, key=key, **options).filter("rank IS NOT NULL").select("doc_id")
    return docs.join(chosen, docs[f"`{key}`"] == chosen["doc_id"], "left_semi")
