"""Mixing sources to target weights: budgets in a tree, token prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import column, discard, gathered, staged
from tidemark.llm.kdtree import with_slots
from tidemark.plans.skew import broadcast_if_small

LEVELS = ("domain", "lang", "source")
BUCKETS = 1 << 16  # parts of an epoch, by the leading bits of the order
PIECES = r"(?<=\S)(?=\s)"  # cuts a text after each word, blanks go with the next


def _matched(left: DataFrame, right: DataFrame, names: Sequence[str], prefix: str = "_", how: str = "inner") -> DataFrame:
    """The rows of ``left`` with those of ``right`` that have the same names, NULL being one, under names with a prefix."""
    others = right.withColumnsRenamed({n: f"{prefix}{n}" for n in names})
    same = reduce(Column.__and__, (left[n].eqNullSafe(others[f"{prefix}{n}"]) for n in names))
    return left.join(broadcast_if_small(others), same, how).drop(*(f"{prefix}{n}" for n in names))


def _weight(name: str, listed: Mapping[str | None, float], default: float) -> Column:
    """The weight of a name: a table of the names that the caller lists."""
    found = F.lit(float(listed.get(None, default)))
    known = {k: float(v) for k, v in listed.items() if k is not None}
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
    usual = F.lit(float(default)) if table is None else F.coalesce(F.try_element_at(table, F.col(name)), F.lit(float(default)))
    return F.when(F.col(name).isNull(), found).otherwise(usual)


def dealt_out(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """``given`` for each child: the budget of its parent dealt out by weight, none above its supply.

    ``children`` has the columns ``parents``, ``name``, ``weight``, ``supply`` and the parent's ``budget``. What some
    lack goes to the others by weight: children that their share would overfill are filled, and the rest is shared
    anew, until no more are. That is a few rounds, each a sum for each parent. Whole tokens: what rounding leaves goes to
    the largest fractions, the first name among equals. With weights of zero only, nothing is dealt out.
    """
    rows = gathered(children.withColumn("open", (F.col("weight") > 0) & (F.col("supply") > 0)), "children")
    share = F.when(F.col("of") > 0, F.col("rest") * F.col("weight") / F.col("of")).otherwise(F.lit(0.0))
    full = F.col("open") & (share >= F.col("supply"))

    def added(condition: Column, value: str, nothing: float) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(nothing)))

    state = gathered(
        rows.groupBy(*parents).agg(
            F.least(F.first("budget"), added(F.col("open"), "supply", 0)).alias("whole"),
            added(F.col("open"), "weight", 0.0).alias("of"),
        ).withColumn("rest", F.col("whole")),
        "shares",
    )

    def joined(state: DataFrame) -> DataFrame:
        """Each child with what its parent has left, ``rest``, for the weights ``of`` the children that are not full."""
        if not parents:
            found = state.first() or {"whole": 0, "of": 0.0, "rest": 0}
            return rows.withColumns({c: F.lit(found[c]).cast(state.schema[c].dataType) for c in ("whole", "of", "rest")})
        return _matched(rows, state, parents)

    while True:
        after = gathered(
            joined(state).groupBy(*parents).agg(
                F.first("whole").alias("whole"), F.first("of").alias("old_of"), F.first("rest").alias("old_rest"),
                added(F.col("open") & ~full, "weight", 0.0).alias("of"),
                (F.first("whole") - added(full, "supply", 0)).alias("rest"),
            ),
            "shares",
        )
        if after.filter("of < old_of AND of > 0").isEmpty():
            break
        # A parent whose children are all full keeps the state that says so.
        discard(state)
        kept = (F.when(F.col("of") > 0, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("of", "rest"))
        state = after.select(*parents, "whole", *kept)
    exact = F.when(F.col("open"), share).otherwise(F.lit(0.0))
    given = F.when(full, F.col("supply")).otherwise(F.floor(exact))
    parent = F.xxhash64(F.lit(1), *parents)
    parted = joined(state).select(
        *rows.columns, given.alias("given"), "whole", parent.alias("parent"),
        F.when(F.col("open") & ~full, F.floor(exact) - exact).otherwise(F.lit(1.0)).alias("fraction"),
        F.col(name).isNull().alias("unnamed"),
    )
    placed = with_slots(parted, "parent", "fraction", "unnamed", name)
    spare = placed.groupBy("parent").agg((F.first("whole") - F.sum("given")).alias("spare"))
    more = F.when((F.col("slot") < F.col("spare")) & (F.col("given") < F.col("supply")) & F.col("open"), 1).otherwise(0)
    return placed.join(broadcast_if_small(spare), "parent").select(
        *parents, name, "supply", (F.col("given") + more).cast("long").alias("given")
    )


def budgets(
    leaves: DataFrame,
    total: int,
    weights: Sequence[Mapping[str | None, float]],
    epochs: int,
    default: float = 1.0,
    names: Sequence[str] = LEVELS,
) -> DataFrame:
    """Rows of ``leaves`` (``names`` and ``tokens``) with ``given``, the tokens that each leaf is to give.

    ``weights`` has a mapping of names to weights for each level. A leaf can give its tokens ``epochs`` times. Going down
    from the root, a node's budget is dealt out among its children by weight, and what a child lacks goes to its
    siblings; since a subtree never gets more than all its leaves can give, a shortage reaches the ancestors' siblings
    only when its own are used up. Names that ``weights`` does not list have the weight ``default``. Each level is a
    table, so the number of leaves is not bounded.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * epochs)
    above: DataFrame | None = None
    for depth, name in enumerate(names):
        parents = list(names[:depth])
        level = leaves.groupBy(*parents, name).agg(F.sum("supply").alias("supply"))
        level = level.withColumn("weight", _weight(name, weights[depth], default))
        if above is None:
            children = level.withColumn("budget", F.lit(total).cast("long"))
        else:
            children = _matched(level, above.select(*parents, F.col("given").alias("budget")), parents)
        above = gathered(dealt_out(children, parents, name), "budgets")
    return above.select(*names, F.floor(F.col("supply") / epochs).cast("long").alias("tokens"), "given")


def count_tokens(text: Column) -> Column:
    """Words of a text; 0 for NULL or blank ones."""
    blanks = F.when(text.rlike(r"^\s"), 1).otherwise(0) + F.when(text.rlike(r"\s$"), 1).otherwise(0)
    return F.when(text.rlike(r"\S"), F.size(F.split(text, r"\s+")) - blanks).otherwise(0).cast("long")


def mix(
    docs: DataFrame,
    total: int | float,
    weights: Sequence[Mapping[str | None, float]],
    domain: Column,
    epochs: int = 1,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    default: float = 1.0,
    with_text: bool = True,
) -> DataFrame:
    """The selection: ``doc``, a row of ``docs`` as a struct, ``domain``, ``epoch``, ``tokens``, ``take`` and ``cut``.

    One row per document and epoch. ``total`` is a number of tokens, or a float: that share of all tokens of ``docs``.
    Tokens are words. A leaf's stream is its documents in the order of a hash of seed, epoch and key, once for
    each epoch; it gives exactly its budget, the first tokens of that stream. ``take`` is how many
    tokens of the document belong to it: fewer than ``tokens`` for the last document of a leaf only, which ``cut`` marks.

    NULL domain, language or source is a leaf name like any other. Documents without tokens belong to no
    prefix and are left out. Repeated keys are ordered by a hash of their texts; repeated rows are alike, so which
    of them comes last makes no difference. An empty table gives no rows; texts may have any length and columns any
    name. Tokens are counted once and stored, without the texts. With ``with_text`` False the text is left out of ``doc``; with it
    the texts are read again for the selection, and ``tokens`` of whole documents are counted again only if they are asked for.

    Counts are aggregated before the shuffle. Whole epochs need no order. In the last one the
    documents fall into ``BUCKETS`` parts by the leading bits of the hash; sums per part find the
    one in which the prefix ends, and only the documents of that part are sorted, and their tokens counted.
    """
    held = F.struct(*(column(c).alias(c) for c in docs.columns if with_text or c != text))
    leaf = (
        domain.cast("string").alias("domain"), column(lang).cast("string").alias("lang"), column(source).cast("string").alias("source"),
        column(key).alias("key"),
    )
    facts = {"tokens": count_tokens, "tie": F.xxhash64}
    own = [f(column(text)).alias(name) for name, f in facts.items()]
    worded = docs.filter(column(text).rlike(r"\S"))  # a filter on the count would count again
    if with_text:
        marked = staged(worded.select(*leaf, own[0]), "counted")
        rows = worded.select(held.alias("doc"), *leaf)
    else:
        rows = marked = staged(worded.select(held.alias("doc"), *leaf, *own), "counted")

    def told(found: DataFrame) -> DataFrame:
        """``found`` with tokens and tie, which a row with its text has not yet."""
        return found.withColumns({name: f(F.col("doc").getField(text)) for name, f in facts.items()}) if with_text else found

    leaves = gathered(marked.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "leaves")
    if isinstance(total, float):
        total = int(total * (leaves.agg(F.sum("tokens")).first()[0] or 0))
    given = budgets(leaves, total, weights, epochs, default).select(
        *LEVELS, F.floor(F.col("given") / F.col("tokens")).alias("whole"), (F.col("given") % F.col("tokens")).alias("rest")
    )
    given = gathered(given, "given")
    order = F.xxhash64(F.lit(seed), F.col("whole"), F.col("key"))
    bucket = F.shiftrightunsigned(order, 48).cast("int")
    partial = _matched(marked.select(*LEVELS, "key", "tokens"), given.filter("rest > 0"), LEVELS)
    ending = Window.partitionBy(*LEVELS).orderBy("bucket")
    ends = (
        partial.groupBy(*LEVELS, bucket.alias("bucket")).agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
        .withColumn("upto", F.sum("n").over(ending))
        .filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
        .select(*LEVELS, F.col("bucket").alias("end"), (F.col("upto") - F.col("n")).alias("before"))
    )
    limits = gathered(_matched(given, gathered(ends, "ends"), LEVELS, how="left"), "limits")
    placed = _matched(rows, limits, LEVELS).withColumn("bucket", bucket)
    columns = ["doc", *LEVELS, "key", "tie", "tokens"]
    whole = (F.col("whole") - 1 + F.coalesce(F.col("bucket") < F.col("end"), F.lit(False)).cast("int")).cast("int")  # the last whole epoch
    inside = placed.filter(whole >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), whole)))
    inside = told(inside).select(*columns, "epoch", F.col("tokens").alias("take"), F.lit(False).alias("cut"))
    by_leaf = Window.partitionBy(*LEVELS).orderBy("order", "key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("tokens").over(by_leaf), F.lit(0))
    border = (
        told(placed.filter("bucket = end")).withColumn("order", order).withColumn("left", left).filter("left > 0")
        .select(*columns, F.col("whole").cast("int").alias("epoch"), F.least("left", "tokens").alias("take"), (F.col("left") < F.col("tokens")).alias("cut"))
    )
    return inside.unionByName(border)


def prefix(text: Column, tokens: Column) -> Column:
    """The first ``tokens`` words of a text, with the blanks before each."""
    return F.array_join(F.slice(F.split(text, PIECES), F.lit(1), tokens.cast("int")), "")


def mixed_documents(docs: DataFrame, *args, text: str = "text", chars: str = "n_chars", **options) -> DataFrame:
    """Selected documents with the columns of ``docs``; a text of which fewer tokens belong to the mix is cut there."""
    found = mix(docs, *args, text=text, **options)
    whole = ~F.col("cut")
    body = F.col("doc").getField(text)
    cut = F.when(whole, body).otherwise(prefix(body, F.col("take")))
    new = {text: cut}
    if chars in docs.columns:
        new[chars] = F.when(whole, F.col("doc").getField(chars)).otherwise(F.char_length(cut).cast(docs.schema[chars].dataType))
    return found.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def mixed_prefixes(docs: DataFrame, *args, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The selection without texts: (key, domain, lang, source, epoch, tokens, take, chars, crc32) of each prefix.

    ``chars`` and ``crc32`` are the code points of the selected text and the CRC of its UTF-8 bytes. Those of whole
    texts are taken in the pass that counts tokens. Texts that are cut, one for each leaf at most, are looked up.
    """
    body = column(text)
    facts = F.struct(F.char_length(body).cast("long").alias("chars"), F.crc32(body.cast("binary")).alias("crc32"))
    found = staged(mix(
        docs.select(*(column(c) for c in docs.columns), facts.alias("_facts")), *args, key=key, text=text, with_text=False, **options
    ).select("key", *LEVELS, "tie", "epoch", "tokens", "take", "doc._facts.chars", "doc._facts.crc32"), "mixed")
    cut = found.filter("take < tokens")
    wanted = cut.select(F.col("key").alias("cut_key"), F.col("tie").alias("cut_tie")).distinct()
    texts = docs.select(column(key).alias("key"), F.xxhash64(body).alias("tie"), body.alias("text"))
    same = texts["key"].eqNullSafe(wanted["cut_key"]) & (texts["tie"] == wanted["cut_tie"])
    kept = texts.join(broadcast_if_small(wanted), same).select("cut_key", "cut_tie", "text").dropDuplicates(["cut_key", "cut_tie"])
    again = cut["key"].eqNullSafe(kept["cut_key"]) & (cut["tie"] == kept["cut_tie"])
    parts = cut.drop("chars", "crc32").join(kept, again).withColumn("part", prefix(F.col("text"), F.col("take")))
    names = ["key", *LEVELS, "epoch", "tokens", "take", "chars", "crc32"]
    of_parts = parts.withColumns({"chars": F.char_length("part").cast("long"), "crc32": F.crc32(F.col("part").cast("binary"))})
    return found.filter("take = tokens").select(*names).unionByName(of_parts.select(*names))
