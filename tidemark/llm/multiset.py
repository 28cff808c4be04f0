"""Fingerprints of documents as homomorphic multiset hashes of their paragraphs.

DataFrame functions only. A paragraph is hashed to a wide vector, and a document's fingerprint is the
sum of the vectors of its paragraphs, lane by lane modulo a power of two. So the order of paragraphs
does not matter, and one is put in or taken out by adding or subtracting its vector.

The vector has two parts. ``EXACT`` lanes of 32 bits hold hashes of the whole paragraph: they tell
equal multisets from others. ``SIGNED`` lanes of 32 bits are the sum of +1 or -1 for every three words in a
row of the paragraph: the cosine of these parts of two fingerprints estimates how much text two
documents share, with an error of about 1 / sqrt(SIGNED). A lane is no larger than the number of shingles, so it keeps
its value up to 2 ** 31 of them, more than fit a text of 2 GB; the lanes of several documents added up may pass that.

Signed lanes are kept as an array of 16-bit numbers: ``SIGNED`` of them if all fit, else as many low and then as many
high halves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import column, numbered, staged

EXACT = 8
SIGNED = 128
EXACT_MODULUS = 1 << 32
SIGNED_MODULUS = 1 << 32
WORDS = 3  # of a shingle


def _units(text: Column) -> Column:
    """Every paragraph, marked, and every three words in a row of it, or all if it has fewer."""
    paragraphs = F.split(text, "\n")
    return F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.concat(
                F.array(F.struct(F.lit(True).alias("whole"), p.alias("value"))),
                F.flatten(F.transform(
                    F.array(F.regexp_extract_all(p, F.lit(r"\S+"), F.lit(0))),  # split once, used by every shingle
                    lambda words: F.transform(
                        F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (WORDS - 1))))
                        .otherwise(F.array().cast("array<int>")),
                        lambda i: F.struct(F.lit(False).alias("whole"), F.array_join(F.slice(words, i, WORDS), " ").alias("value")),
                    ),
                )),
            ),
        )
    )


def lanes(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per ``keys`` with ``exact`` and ``signed``, the lanes of the sum over all its paragraphs.

    Added up per task before any shuffle. NULL is the empty text, which is one empty paragraph.
    """
    unit = df.select(*keys, F.explode(_units(F.coalesce(F.col(text), F.lit("")))).alias("unit")).select(
        *keys, F.col("unit.whole").alias("whole"), F.col("unit.value").alias("value")
    )
    hashed = unit.select(
        *keys, "whole",
        F.when(~F.col("whole"), F.xxhash64("value")).alias("h0"),
        F.when(~F.col("whole"), F.xxhash64("value", F.lit(1))).alias("h1"),
        *(F.when(F.col("whole"), F.xxhash64("value", F.lit(2 + i))).alias(f"e{i}") for i in range(EXACT // 2)),
    )
    sums = [F.sum(F.when(F.col("whole"), 0).otherwise(1)).alias("n")]
    # Two lanes are counted in the halves of one long: at most 2 ** 31 units of a document.
    for i in range(SIGNED // 2):
        bits = F.shiftrightunsigned(f"h{i // 32}", i % 32).bitwiseAND(F.lit((1 << 32) + 1))
        sums.append(F.sum(bits).alias(f"s{i}"))
    for i in range(EXACT // 2):
        sums.append(F.sum(F.col(f"e{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"low{i}"))
        sums.append(F.sum(F.shiftrightunsigned(f"e{i}", 32)).alias(f"high{i}"))
    added = hashed.groupBy(*keys).agg(*sums)
    signed = []
    for i in range(SIGNED // 2):
        found = F.coalesce(F.col(f"s{i}"), F.lit(0))
        for ones in (found.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(found, 32)):
            signed.append(2 * ones - F.col("n"))
    exact = [F.pmod(F.col(f"{half}{i}"), F.lit(EXACT_MODULUS)) for i in range(EXACT // 2) for half in ("low", "high")]
    return added.select(
        *keys, F.array(*exact).alias("exact"), _kept(F.array(*signed)).alias("signed")
    )


def _kept(values: Column) -> Column:
    """Lanes modulo the power, from minus a half of it up to the other half, as 16-bit numbers."""
    half = SIGNED_MODULUS // 2
    lanes_ = F.transform(values, lambda v: F.pmod(v + half, F.lit(SIGNED_MODULUS)) - half)
    low = F.transform(lanes_, lambda v: (F.pmod(v + 32768, F.lit(65536)) - 32768).cast("short"))
    high = F.transform(lanes_, lambda v: F.shiftright(v + 32768, 16).cast("short"))
    return F.when(F.exists(high, lambda v: v != 0), F.concat(low, high)).otherwise(low)


def _wide(kept: Column) -> Column:
    """The lanes of ``_kept`` as longs."""
    low = F.slice(kept, 1, SIGNED)
    both = F.zip_with(low, F.slice(kept, SIGNED + 1, SIGNED), lambda a, b: a.cast("long") + F.coalesce(b, F.lit(0)) * 65536)
    return F.when(F.size(kept) == SIGNED, F.transform(low, lambda a: a.cast("long"))).otherwise(both)


def combine(left: tuple[Column, Column], right: tuple[Column, Column], sign: int = 1) -> tuple[Column, Column]:
    """Lanes (exact, signed) of two multisets taken together, or with ``sign`` -1 of the first without the second."""
    exact = F.zip_with(left[0], right[0], lambda a, b: F.pmod(a + sign * b, F.lit(EXACT_MODULUS)))
    signed = _kept(F.zip_with(_wide(left[1]), _wide(right[1]), lambda a, b: a + sign * b))
    return exact, signed


def as_text(exact: Column, signed: Column) -> Column:
    """Lower-case hexadecimal digits: 8 for each exact lane, then 8 for each signed lane."""

    def digits(values: Column, size: int, width: int, per: int) -> list[Column]:
        parts = []
        for i in range(0, size, per):
            packed = F.lit(0).cast("long")
            for j in range(per):
                lane = F.get(values, F.lit(i + j)).cast("long").bitwiseAND(F.lit((1 << (4 * width)) - 1))
                packed = packed.bitwiseOR(F.shiftleft(lane, 4 * width * (per - 1 - j)))
            parts.append(F.lpad(F.hex(packed), 16, "0"))
        return parts

    return F.lower(F.concat(*digits(exact, EXACT, 8, 2), *digits(_wide(signed), SIGNED, 8, 2)))


def likeness(left: tuple[Column, Column], right: tuple[Column, Column]) -> Column:
    """From 0 to 1: the cosine of the signed lanes, at least 0; 1 for equal fingerprints."""

    def dot(a: Column, b: Column) -> Column:
        products = F.zip_with(_wide(a), _wide(b), lambda x, y: x.cast("double") * y)
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    size = F.sqrt(dot(left[1], left[1]) * dot(right[1], right[1]))
    cosine = F.when(size > 0, dot(left[1], right[1]) / size).otherwise(F.lit(0.0))
    same = (left[0] == right[0]) & (left[1] == right[1])
    return F.when(same, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint) for a table of unique keys. Text NULL is the empty text."""
    rows = docs.select(column(key).alias("doc_id"), column(text).alias("text"))
    found = lanes(rows, ["doc_id"], "text")
    return found.select("doc_id", as_text(F.col("exact"), F.col("signed")).alias("fingerprint"))


def successors(rows: DataFrame, order: list[str], key: str) -> DataFrame:
    """(key, next_key) in the given order; after the last row comes the first.

    The rows are cut into ranges, which are stored so that their numbers stay as they are. Inside a range
    a window finds the next row; between ranges, a table with a row for each range does.
    """
    ranges = staged(
        rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges"
    )
    inside = Window.partitionBy("range").orderBy(*order)
    firsts = ranges.withColumn("place", F.row_number().over(inside)).filter("place = 1")
    # A row for each range: as many as there are shuffle partitions.
    by_range = Window.orderBy("range")
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select(
        "range", F.coalesce(F.lead(key).over(by_range), F.first(key).over(everything)).alias("over")
    )
    return (
        ranges.withColumn("within", F.lead(key).over(inside))
        .join(F.broadcast(after), "range")
        .select(key, F.coalesce("within", "over").alias(f"next_{key}"))
    )


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text: the last floor(n / 2) of n code points give way to the first as many, or all, of
    the next text in ascending order of the key, after the last row the first. Rows (doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id, next_n_chars).

    ``docs`` must be a stored table, read the same way each time. Text NULL is the empty text. Rows with a NULL key
    come first; repeated keys keep the stored order. Every row is a document of its own, of any length. An empty table
    gives no rows. Other columns are not read, whatever their names.
    """
    texts = docs.select(column(key).alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    rows = numbered(texts, "uid").withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    next_to = successors(rows.select("doc_id", "uid"), ["doc_id", "uid"], "uid")
    own = staged(lanes(rows.select("uid", "text"), ["uid"], "text"), "lanes")
    # The texts are shuffled by their number once; both sides of the join below read that shuffle. Then only the
    # part of a text that stays travels on, to the next text.
    moved = rows.repartition("uid")
    heads = moved.join(next_to, "uid").select(
        "uid", "next_uid", "doc_id", "n_chars", half.alias("half"),
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")).alias("head"),
    )
    nexts = moved.select(
        F.col("uid").alias("next_uid"), F.col("doc_id").alias("next_doc_id"), F.col("n_chars").alias("next_n_chars"),
        F.col("text").alias("next_text"),
    )
    edited = (
        heads.join(nexts, "next_uid")
        .select(
            "uid", "next_uid", "doc_id", "n_chars", "next_doc_id", "next_n_chars",
            F.concat("head", F.substring(F.col("next_text"), F.lit(1), F.col("half"))).alias("edited"),
        )
        .withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    )
    kept = ["uid", "next_uid", "doc_id", "n_chars", "next_doc_id", "next_n_chars", "edited_sha256"]
    new = lanes(edited, kept, "edited")
    a, b, c = ((F.col(f"{p}exact"), F.col(f"{p}signed")) for p in ("own_", "new_", "next_"))

    def named(df: DataFrame, prefix: str) -> DataFrame:
        return df.withColumnsRenamed({"exact": f"{prefix}exact", "signed": f"{prefix}signed"})

    joined = (
        named(new, "new_").join(named(own, "next_").withColumnRenamed("uid", "next_uid"), "next_uid")
        .join(named(own, "own_"), "uid")
    )
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", as_text(*a).alias("fingerprint"), as_text(*b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), "next_doc_id", "next_n_chars",
    )
