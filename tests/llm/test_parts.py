"""Parts of the operators, and odd tables: NULLs, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import io
import random
import re
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import (
    common, components,
    embedding, langid, mixing, multiset, packing, passages, setjoin, simhash, tokenbin, tokens, toxicity, warc,
)
from tidemark.llm.common import numbered
from tidemark.llm.queries import BYTE_TOKENIZER, WEIGHTS, WORD_TOKENIZER, domain_of
from tidemark.llm.tokens import Encoder
from test_queries import brute_budgets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, _row long, seed string"
PROSE = "the quick brown fox jumps over the lazy dog and runs through the old wood by the river. "
ODD = [
    (1, PROSE * 9, "en", "src1", 700, 5, 5, "a"),
    (1, PROSE * 9, "en", "src1", 700, 5, 5, "a"),
    (None, PROSE * 8, "en", None, None, None, None, None),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "src3", 0, 1, 1, ""),
    (4, " \n\t ", None, "x", 4, 1, 1, ""),
    (5, "12 345 ...", "de", "src2", 10, 1, 1, ""),
    (6, "word " * 40_000, "en", "src0", 200_000, 1, 1, ""),
    (7, "été à la mer, où êtes-vous donc ce matin?", "fr", "src9", 40, 1, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(ODD, SCHEMA).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


LABELS = "doc_id long, toxic int"
OPERATORS = {
    "tokens": lambda d: tokenbin.round_trip(d, public_tokenizers.path(WORD_TOKENIZER)),
    "simhash": simhash.simhash_components,
    "language": langid.identify,
    "mixing": lambda d: mixing.mix(d, 0.5, WEIGHTS, domain_of(), 2),
    "packing": lambda d: packing.pack(d, public_tokenizers.path(BYTE_TOKENIZER)),
    "multiset": multiset.compare_edited,
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(1, 1), (3, 0), (None, None)], LABELS)),
    "warc": lambda d: warc.round_trip(d, "doc_id", "lang", "text"),
    "passages": passages.repeated_passages,
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", ["tokens", "simhash", "language", "multiset", "toxicity", "warc"])
def test_a_row_for_each_row(odd, name):
    assert OPERATORS[name](odd).count() == len(ODD)


def test_odd_tokens(odd):
    got = OPERATORS["tokens"](odd).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    at = 0
    for r in got:
        assert r["start"] == at
        at += len(r["ids"]) // 4
    assert all(len(r["ids"]) == 4 for r in got if r["doc_id"] in (2, 3, 4))


def test_odd_simhash(odd):
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in OPERATORS["simhash"](odd).collect()}
    blank = {r for r in got if r[1] == "0" * 16}
    assert blank == {(d, "0" * 16, 2) for d in (2, 3, 4)}
    assert {r[2] for r in got if r[0] == 1} == {1}


def test_odd_language(odd):
    got = {r["doc_id"]: r for r in OPERATORS["language"](odd).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (2, 3, 4, 5))
    assert got[None]["held_out"]


def test_odd_packing(odd):
    got = OPERATORS["packing"](odd).collect()
    assert sum(r["length"] for r in got) == sum(len(r["ids"]) // 4 for r in got)
    assert sorted(r["doc_id"] for r in got if r["doc_tokens"] == 1) == [2, 3]


def test_odd_multiset(odd):
    got = {r["doc_id"]: r for r in OPERATORS["multiset"](odd).collect()}
    assert got[2]["fingerprint"] == got[3]["fingerprint"] != got[4]["fingerprint"]
    assert got[7]["next_doc_id"] is None and got[2]["next_doc_id"] == 3 and got[2]["near_next"] == 1.0


def test_odd_passages(odd):
    got = OPERATORS["passages"](odd).collect()
    assert {r["doc_id"] for r in got} == {1, None}
    left = {(r["doc_id"], r["text"]) for r in passages.without_passages(odd).collect()}
    assert (2, None) in left and (3, "") in left and sum(d == 1 for d, _ in left) == 1


def test_columns_of_clashing_names_keep_their_values(odd):
    given = {(r[0], r[6]) for r in ODD}
    for found in (simhash.keep_one(odd), passages.without_passages(odd)):
        assert {(r["doc_id"], r["_row"]) for r in found.collect()} <= given


# Every name that an operator gives to a column of its own.
OWN_NAMES = """_tokens _domain _tie _bucket _epoch _take _order _whole _left _level0 _lang _score _toxic _fp _row _cuts _text _facts
doc domain epoch tokens take key tie bucket order whole rest left end before upto n parent slot part at shard uid same first
known node component a b seed place ref low high begin id own row shingle size text_a text_b doc_tokens sequence_id offset
start length ids sentences exact signed _part _at _fit rank score weight""".split()


def test_own_names_of_operators_are_free_for_columns(spark, tmp_path):
    """A table that has them all goes through every stage, and its values come out as they went in."""
    kept = {n.lower() for n in ("doc_id", "text", "lang", "source", "n_chars")}
    frame = spark.createDataFrame([r[:5] for r in ODD if r[0] != 6], "doc_id long, text string, lang string, source string, n_chars long")
    frame = frame.withColumns({n: F.lit(f"mine {n}") for n in OWN_NAMES if n not in kept})
    frame.write.parquet(str(tmp_path / "t"))
    now = spark.read.parquet(str(tmp_path / "t"))
    names = now.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        now = corpus_pipeline.staged(stage(spark, now, ""), name)
        assert now.columns == names and now.count() > 0
        for row in now.collect():
            assert all(row[n] == f"mine {n}" for n in OWN_NAMES if n not in kept)
    assert corpus_pipeline.STAGES[4][1](spark, now, "").count() > 0


def test_odd_stages(spark, odd, empty):
    for frame, some in ((odd, True), (empty, False)):
        now = frame
        for name, stage in corpus_pipeline.STAGES[:4]:
            now = corpus_pipeline.staged(stage(spark, now, ""), name)
            assert now.columns == frame.columns
        assert (now.count() > 0) == some
        assert (corpus_pipeline.STAGES[4][1](spark, now, "").count() > 0) == some


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]),
        (7, [inf, 0.0]), (8, [1.0, None]), (9, [1.0]), (10, [3.0]), (None, [1.0, 0.1]), (11, [-1.0, 0.0]), (12, [-0.0, -2.0]), (13, [0.0, -2.0]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding.embedding_classes(frame).collect()), key=repr)
    alone = [(v, 0, v) for v in (3, 4, 5, 6, 7, 8, 11)]
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (None, 3, 1), (9, 1, 9), (10, 1, 9), (12, 1, 12), (13, 1, 12), *alone], key=repr)
    assert embedding.embedding_classes(frame.limit(0)).count() == 0


def test_pieces_are_exact():
    dice = random.Random(5)
    texts = ["".join(dice.choices(" \n.,aBé1_'\t²…́日s\0", k=dice.randint(0, 14))) for _ in range(4000)]
    for name in (WORD_TOKENIZER, BYTE_TOKENIZER):
        path = public_tokenizers.path(name)
        tool = tokenizers.Tokenizer.from_file(path)
        tool.encode_special_tokens = True
        want = [array("I", e.ids).tobytes() for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
        assert list(Encoder(path).many(texts)) == want


def test_one_document_is_read_alone(spark, odd, tmp_path):
    listed, dictionary = tokenbin.write_tokens(odd, public_tokenizers.path(WORD_TOKENIZER), str(tmp_path / "t"))
    whole = {r["start"]: bytes(r["ids"]) for r in tokenbin.read_tokens(spark, listed, dictionary).collect()}
    for row in listed.collect():
        reader = tokenbin.Reader(row["address"], dictionary)
        for number in reversed(range(row["documents"])):
            entry, ids = reader.document(number)
            assert ids == whole[row["before"] + int(entry["start"])]
        with pytest.raises(ValueError):
            tokenbin.Reader(row["address"], b"another dictionary")


def test_dictionary_helps():
    dice = np.random.default_rng(1)
    samples = [np.repeat(dice.integers(0, 300, 40), 3).astype("<u4").tobytes() for _ in range(800)]
    shared, plain = tokenbin.Codec(tokenbin.train_dictionary(samples)), tokenbin.Codec(b"")
    assert sum(len(shared.pack(s)) for s in samples) < sum(len(plain.pack(s)) for s in samples)
    assert all(shared.unpack(shared.pack(s)) == s for s in samples)


def test_broken_archives_are_refused():
    body = b"x" * 200_000
    fields = [("WARC-Payload-Digest", f"sha1:{warc.digest(body)}")]
    good = warc.record("response", fields, body) + warc.record("response", [], b"")
    assert [c for _, c in warc.read_records(io.BytesIO(good))] == [body, b""]
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(good[:100])))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(warc.record("response", fields, body[1:]))))


def test_paragraphs_in_and_out(spark):
    rows = [("whole", "a b c d\ne f\ne f"), ("first", "a b c d\ne f"), ("rest", "e f"), ("turned", "e f\na b c d\ne f")]
    found = multiset.lanes(spark.createDataFrame(rows, "k string, text string"), ["k"], "text")
    by = {r["k"]: (r["exact"], r["signed"]) for r in found.collect()}
    assert by["whole"] == by["turned"] != by["first"]
    both = spark.createDataFrame([(*by["whole"], *by["first"], *by["rest"])], "a array<long>, b array<short>, c array<long>, d array<short>, e array<long>, f array<short>")
    whole, first, rest = (F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (F.col("e"), F.col("f"))
    added, left = multiset.combine(first, rest), multiset.combine(whole, rest, -1)
    got = both.select(*added, *left).first()
    assert (got[0], got[1]) == by["whole"] and (got[2], got[3]) == by["first"]


def leaf_rows(spark, tokens):
    return spark.createDataFrame([(*leaf, n) for leaf, n in tokens.items()], "domain string, lang string, source string, tokens long")


@pytest.mark.parametrize("seed", range(6))
def test_budgets_of_random_trees(spark, seed):
    """Against the definition, node by node: shortages, weights of zero, NULL names, many equal children."""
    dice = random.Random(seed)
    names = [None, *(f"n{i}" for i in range(dice.choice((2, 5, 30))))]
    tokens = {(dice.choice("ab"), dice.choice(names), dice.choice(names)): dice.choice((1, 7, dice.randrange(1, 5000))) for _ in range(120)}
    weights = [{"a": dice.random()}, {"n1": 0, None: 3}, {"n0": 5, "n2": 0.5}]
    total, epochs = dice.choice((0, 10, 10_000, 10**7)), dice.choice((1, 3))
    got = mixing.budgets(leaf_rows(spark, tokens), total, weights, epochs)
    found = {(r["domain"], r["lang"], r["source"]): r["given"] for r in got.collect()}
    assert found == brute_budgets(tokens, total, weights, epochs)
    assert got.filter("tokens IS NULL").count() == 0 and {tuple(r)[:3]: r["tokens"] for r in got.collect()} == tokens


def test_budgets_by_hand(spark):
    tokens = {("a", "x", "1"): 1, ("a", "y", "1"): 9, ("b", "x", "1"): 90}
    got = mixing.budgets(leaf_rows(spark, tokens), 20, ({}, {}, {}), 1).collect()
    assert {(r["domain"], r["lang"], r["source"]): r["given"] for r in got} == {
        ("a", "x", "1"): 1, ("a", "y", "1"): 9, ("b", "x", "1"): 10
    }
    assert mixing.budgets(leaf_rows(spark, {("a", "b", "c"): 1}).limit(0), 20, ({}, {}, {}), 1).collect() == []


def test_toxic_sentences_are_found():
    dice = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(600):
        sentences = [" ".join(dice.choices(words, k=8)) for _ in range(10)]
        if i % 4 == 0:
            sentences[5] += " vile rotten"
        docs.append(". ".join(sentences) + ".")
        labels.append(int(i % 4 == 0))
    model = toxicity.fit(docs[:400], labels[:400])
    for doc, label in zip(docs[400:], labels[400:], strict=True):
        found = [doc[a:b] for a, b, s in model.sentences(doc) if s >= 0.5]
        assert len(found) == label and all("vile" in f for f in found)


def test_numbers_do_not_follow_the_cores(spark, tmp_path):
    """Row numbers come out alike when the number of cores changes between two scans."""
    path = str(tmp_path / "rows")
    spark.range(0, 20_000, 1, 1).write.option("parquet.block.size", 4096).parquet(path)
    held = {"spark.sql.files.openCostInBytes": "1024", "spark.sql.files.minPartitionNum": None}
    before = {k: spark.conf.get(k, None) for k in [*held, "spark.sql.leafNodeDefaultParallelism"]}
    try:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        found = []
        for cores in (2, 7):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
            df = numbered(spark.read.parquet(path), "n")
            found.append(sorted(map(tuple, df.collect())))
        assert found[0] == found[1]
        assert len({n for _, n in found[0]}) == 20_000
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def test_tiles_do_not_depend_on_the_order_of_rows(spark):
    """Ties for the closest fingerprint fall alike, however the rows arrive."""
    prints = [(1 << i,) for i in range(20)]
    found = []
    for rows in (prints, prints[::-1]):
        df = spark.createDataFrame(rows, "_fp long").repartition(5)
        links = simhash.near_links(df, 4, links=simhash.closest_links).distinct()
        found.append(sorted(map(tuple, links.collect())))
    assert found[0] and found[0] == found[1]


def alike(a, b):
    return simhash.similar(a, b, simhash.CHECKED_WORDS, simhash.SIMILARITY)


def kept_texts(spark, texts, path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return {r["doc_id"] for r in simhash.keep_one(spark.read.parquet(path)).collect()}


def test_copies_behind_another_text_of_their_fingerprint(spark, tmp_path):
    """One shingle makes up over half of each text, so all have one fingerprint; the first is unlike the others."""
    dice = random.Random(1)
    rule = "--- " * 300
    texts = [rule + " ".join(f"w{dice.random()}" for _ in range(100)) for _ in range(3)]
    texts = [texts[0], texts[1], texts[1], texts[2], texts[2] + " end"]
    assert len({simhash.fingerprint(t) for t in texts}) == 1
    assert kept_texts(spark, texts, str(tmp_path / "d")) == {0, 1, 3}


def test_copies_near_the_threshold(spark, tmp_path):
    """Recall by bands of similarity, over distinct texts: every pair at 0.8 or more, however far the fingerprints."""
    dice = random.Random(2)
    texts = []
    for _ in range(400):
        words = [f"w{dice.randrange(10**6)}" for _ in range(dice.randint(60, 300))]
        edited = list(words)
        for at in dice.sample(range(len(words)), round(len(words) * dice.choice((0.01, 0.015, 0.02, 0.025)))):
            edited[at] = f"v{dice.randrange(10**6)}"
        texts += [" ".join(words), " ".join(edited)]
    kept = kept_texts(spark, texts, str(tmp_path / "d"))
    prints = [simhash.fingerprint(t) for t in texts]
    similar = [i for i in range(0, 800, 2) if alike(texts[i], texts[i + 1])]
    far = [i for i in similar if (prints[i] ^ prints[i + 1]).bit_count() > simhash.WIDE_RADIUS]
    assert far and set(range(800)) - kept == {i + 1 for i in similar}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        band = [i for i in similar if low <= jaccard(texts[i], texts[i + 1]) < high]
        assert len(band) > 30 and not any(i + 1 in kept for i in band)


def jaccard(a, b):
    one, two = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(one & two) / len(one | two)


@pytest.mark.parametrize("share", [0, 1])
def test_frequent_shingles_are_dealt_to_every_pair_of_blocks(share):
    """Two rows of a shingle meet under one key at least, whatever their blocks; of other shingles under itself."""
    shingle = np.array([5, 9], np.int64)
    keys = [set(setjoin.dealt(shingle, np.arange(2), np.array([7, 1 + 3 * share]), row)[0].tolist()) for row in range(60)]
    assert all(a & b for a in keys for b in keys)
    assert all(len(k) == 8 + 3 * share for k in keys) and len(set.union(*keys)) == 28 + (10 if share else 1)


def stored_texts(spark, texts, path):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def random_words(dice, count):
    return [f"w{dice.randrange(10**7)}" for _ in range(count)]


def test_a_rejected_chain_hides_no_passage(spark, tmp_path):
    """A sparse chain with an earlier document runs over an exact copy from another one, and is rejected itself."""
    dice = random.Random(6)
    head, phrase, tail = (random_words(dice, 32) for _ in range(3))
    copy = random_words(dice, 18) + phrase + random_words(dice, 18)
    first = head + random_words(dice, 18) + phrase + random_words(dice, 18) + tail
    middle, last = random_words(dice, 20) + copy, head + copy + tail
    frame = stored_texts(spark, [" ".join(t) for t in (first, middle, last)], str(tmp_path / "d"))
    got = [r for r in passages.repeated_passages(frame).collect() if r["doc_id"] == 2]
    assert [(r["other_doc_id"], r["n_words"]) for r in got] == [(1, 68)]


def test_frequent_seeds_have_the_same_links(spark):
    """Scanned in ranges of documents or not, seeds have the same links, those at many places too."""
    dice = random.Random(7)
    rows = []
    for seed in range(12):
        for uid in sorted(dice.sample(range(300), 200)):
            places = np.array(sorted(dice.sample(range(500), dice.choice((1, 2, 20)))))
            key, order = passages.keys_of(np.full(len(places), seed, np.int64), np.zeros(len(places), np.int64))
            rows += zip(key.tolist(), [uid] * len(key), (8 * places[order] + 4 * (seed % 2)).tolist(), strict=True)
    found = spark.createDataFrame(rows, "seed long, uid long, place long")
    keys = [r["seed"] for r in found.select("seed").distinct().collect()]
    often = F.col("seed").isin(keys[::2])
    place = lambda at: F.transform(at, lambda v: v.bitwiseAND(F.lit(~2)))  # noqa: E731  # whether few have it is no part of a link
    single = lambda links: sorted(map(tuple, links.select("uid", "ref", F.explode(place("ats"))).collect()))
    usual = single(passages.linked(found))
    steps = [20, 40, 41, 150, 299]
    apart = single(passages.linked(found.filter(~often), found.filter(often), steps))
    assert usual == apart and len(usual) > len(rows)


def test_seeds_of_texts_together_are_those_of_each(monkeypatch):
    """Words, places, runs and keys do not depend on the texts that come before or behind."""
    dice = random.Random(14)
    texts = [" ".join(dice.choice("abcdefgh") * 3 for _ in range(dice.choice((0, 3, 5, 6, 40, 200)))) for _ in range(60)]
    text, key, place = passages.seeds_of(texts, 5, 4, 12)
    for i, one in enumerate(texts):
        _, own_key, own_place = passages.seeds_of([one], 5, 4, 12)
        assert sorted(zip(key[text == i], place[text == i])) == sorted(zip(own_key, own_place))
        words = one.split()
        starts = {p // 2 for p in own_place if p % 2 == 0}
        assert len(words) < 5 or {0, len(words) - 5} <= starts
        assert all(any(at + j in starts for j in range(4)) for at in range(len(words) - 7))
        same = {}
        for k, p in zip(own_key.tolist(), own_place.tolist()):
            if p % 2 and p // 2 + 12 + 4 <= len(words):
                same.setdefault(k, set()).add(tuple(words[p // 2 : p // 2 + 8 + 5]))
        assert all(len(s) == 1 for s in same.values())


def recall(length, edits, tries=300, seed=8):
    """Share of planted passages with so many words changed that are found between two documents."""
    dice = np.random.default_rng(seed)
    k, found = passages.K, 0
    for _ in range(tries):
        a, b = (dice.integers(0, 1 << 63, 400, np.uint64) for _ in range(2))
        b[150 : 150 + length] = a[200 : 200 + length]
        b[150 + dice.choice(length, edits, replace=False)] += np.uint64(1)
        (s, x), (t, y) = passages.seeds(a), passages.seeds(b)
        i, j = np.nonzero(s[:, None] == t[None, :])
        ref = np.zeros(len(i), np.int64)
        chains = passages.chains_of(ref, x[i], y[j], k, passages.MAX_GAP, 20)
        spans = [p for _, xs, ys in chains for p in passages.align(a, b, np.array(xs), np.array(ys), k, 50, 0.8)]
        found += any(p[0] < 200 + length and p[1] > 200 for p in spans)
    return found / tries


@pytest.mark.parametrize(
    ("length", "edits", "least"),
    [(50, 5, 0.99), (50, 8, 0.95), (50, 10, 0.92), (55, 8, 0.98), (55, 11, 0.93), (60, 8, 0.99), (60, 12, 0.94), (80, 16, 0.97), (100, 20, 0.98)],
)
def test_recall_of_fuzzy_passages(length, edits, least):
    assert recall(length, edits) >= least


def test_recall_by_length_and_similarity_in_a_table(spark, tmp_path):
    """Passages planted into a table of many documents, which also share phrases and lines, through the whole query."""
    dice = random.Random(31)
    phrases = [random_words(dice, n) for n in (4, 6, 9, 14) for _ in range(5)]
    line = random_words(dice, 25)

    def prose(count):
        words = []
        while len(words) < count:
            words += random_words(dice, dice.randint(5, 40)) + dice.choice(phrases)
        return words[:count]

    cells = [(length, share) for length in (50, 60, 80, 120) for share in (0, 0.05, 0.1, 0.15, 0.2)]
    texts, planted = [], []
    for length, share in cells * 20:
        passage = prose(length)
        edited = list(passage)
        for at in dice.sample(range(length), int(length * share)):
            edited[at] = f"x{dice.randrange(10**7)}"
        for words in (passage, edited):
            texts.append(prose(dice.randint(0, 200)) + words + prose(dice.randint(0, 200)))
            if dice.random() < 0.3:
                texts[-1] += line
        planted.append((length, share))
    order = list(range(len(texts)))
    dice.shuffle(order)
    place = {t: i for i, t in enumerate(order)}
    got = passages.repeated_passages(stored_texts(spark, [" ".join(texts[t]) for t in order], str(tmp_path / "d"))).collect()
    pairs = {frozenset((r["doc_id"], r["other_doc_id"])) for r in got}
    found = Counter()
    for n, cell in enumerate(planted):
        found[cell] += frozenset((place[2 * n], place[2 * n + 1])) in pairs
    for low, high in ((0, 0.05), (0.1, 0.15), (0.2, 0.2)):
        for length in (50, 60, 80, 120):
            assert sum(found[length, s] for s in {low, high}) >= 0.9 * 20 * len({low, high}), (length, low, found)
    true = {frozenset((place[2 * n], place[2 * n + 1])) for n in range(len(planted))}
    assert len(pairs - true) <= 0.02 * len(pairs)  # documents that share phrases and lines only are left alone


def test_quotes_of_halves_hide_no_passage(spark, tmp_path):
    """Between two full copies of a passage, other documents quote one half or the other."""
    dice = random.Random(9)
    copy = random_words(dice, 60)
    parts = [copy[:30], copy[30:], copy, copy[:30], copy[30:], copy[:30], copy[30:], copy]
    texts = [" ".join(random_words(dice, 40) + p + random_words(dice, 40)) for p in parts]
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["other_doc_id"], r["n_words"]) for r in got) == [(2, 7, 60), (7, 2, 60)]


def covered(got, key, texts):
    """Numbers of the words of a text that its passages cover."""
    starts = [m.start() for m in passages.WORD.finditer(texts[key])]
    return {i for i, at in enumerate(starts) for r in got if r["doc_id"] == key and r["start"] <= at < r["end"]}


def test_holders_of_a_part_hide_no_passage(spark, tmp_path):
    """The first holder, and those between two whole copies, have no more than parts of 44 of its 50 words."""
    dice = random.Random(21)
    copy = random_words(dice, 50)
    texts = []
    for n in range(17):
        parts = [copy] if n in (1, 14) else [copy[i : i + 44] for i in range(7)]
        texts.append(" ".join(w for p in parts for w in random_words(dice, 60) + p + random_words(dice, 60)))
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["other_doc_id"], r["n_words"]) for r in got) == [(1, 14, 50), (14, 1, 50)]


def test_copies_have_the_first_as_their_partner(spark, tmp_path):
    """Equal texts, one that shares a passage with them, and a short text that comes twice."""
    dice = random.Random(24)
    text, other = random_words(dice, 200), random_words(dice, 80)
    texts = ["short words"] + [" ".join(w) for w in (other + text[40:120], text, text, text)] + ["short words"]
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    found = sorted((r["doc_id"], r["other_doc_id"], r["n_words"], r["later"]) for r in got)
    assert found == [(1, 2, 80, False), (2, 1, 80, True), (2, 4, 200, False), (3, 2, 200, True), (4, 2, 200, True)]


def test_a_later_holder_is_a_partner_too(spark, tmp_path):
    """All seeds that two documents share have an earlier holder, in another order."""
    dice = random.Random(22)
    pieces = [random_words(dice, 15) for _ in range(4)]
    first = [w for piece in pieces[::-1] for w in piece + random_words(dice, 60)]
    copies = [[w for piece in pieces for w in piece + random_words(dice, 1)] for _ in range(2)]
    texts = [" ".join(first), *(" ".join(random_words(dice, 40) + c + random_words(dice, 40)) for c in copies)]
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    assert sorted((r["doc_id"], r["other_doc_id"]) for r in got) == [(1, 2), (2, 1)]


def test_every_place_of_a_repeated_passage_is_found(spark, tmp_path):
    """One document has a passage at more than ``PLACES`` places, the other once; so with many more documents."""
    dice = random.Random(23)
    copy = random_words(dice, 60)
    often = [w for _ in range(20) for w in random_words(dice, 20) + copy]
    for others in (1, 12):
        texts = [" ".join(often), *(" ".join(random_words(dice, 30) + copy) for _ in range(others))]
        got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / f"d{others}"))).collect()
        assert covered(got, 0, texts) == {80 * n + i for n in range(20) for i in range(20, 80)}


def test_a_repeated_word_has_no_chain_for_every_place(spark, tmp_path, monkeypatch):
    """Texts of one word, or of three in turn, many hundred times: chains as long as the shorter text, all words covered."""
    sizes, stored = {}, passages.staged

    def counted(df, purpose):
        frame = stored(df, purpose)
        sizes[purpose] = frame.count()
        return frame

    monkeypatch.setattr(passages, "staged", counted)
    texts = [" ".join(["thor"] * n) for n in (200, 900, 1000)] + [" ".join(["ode", "to", "joy"] * n) for n in (100, 400)]
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    assert [len(covered(got, key, texts)) for key in range(5)] == [200, 900, 1000, 300, 1200]
    assert sizes["chains"] < 200


def test_words_of_texts_are_in_lower_case_each_by_itself():
    for text in ("One TWO one", "\u0130stanbul ISTANBUL", "\u039f\u0394\u039f\u03a3'\u0391 \u039f\u0394\u039f\u03a3", "a_b 1\u00b2 x-Y", ""):
        assert passages.words_of(text) == [w.lower() for w in passages.WORD.findall(text)]
    one, two = passages.numbers("a B c", "b A d")
    assert (one[:2] == two[1::-1]).all() and len({*one.tolist(), *two.tolist()}) == 4


@pytest.mark.parametrize("forward", [True, False])
def test_quotes_before_the_whole_hide_no_passage(spark, tmp_path, forward):
    """A document has parts of a passage in another order before the passage itself; its copy has some words changed."""
    dice = random.Random(12)
    copy = random_words(dice, 100)
    quoting = copy[:45] + random_words(dice, 30) + copy[55:] + random_words(dice, 30) + copy[45:55] + random_words(dice, 30) + copy
    changed = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(copy)]
    texts = [" ".join(quoting), " ".join(random_words(dice, 30) + changed)]
    texts = texts if forward else texts[::-1]
    got = passages.repeated_passages(stored_texts(spark, texts, str(tmp_path / "d"))).collect()
    whole = [r for r in got if r["n_words"] >= 95]
    assert {r["doc_id"] for r in whole} == {0, 1} and all(r["similarity"] >= 0.9 for r in whole)


def test_passages_do_not_depend_on_passes_or_frequent_seeds(spark, tmp_path, monkeypatch):
    dice = random.Random(15)
    line = random_words(dice, 60)
    texts = [" ".join(random_words(dice, dice.randrange(60)) + line[: dice.randrange(40, 61)]) for _ in range(150)]
    frame = stored_texts(spark, texts, str(tmp_path / "d"))
    found = []
    for passes, count, sample in ((1, 10**9, 64), (4, 1, 1), (3, 1, 2)):
        for name, value in (("PASSES", passes), ("HOT_COUNT", count), ("HOT_SAMPLE", sample)):
            monkeypatch.setattr(passages, name, value)
        found.append(sorted(map(tuple, passages.repeated_passages(frame).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_a_word_more_at_the_front_keeps_texts_alike(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [("own", " ".join(words)), ("more", " ".join(["new", *words])), ("less", " ".join(words[1:])), ("none", "  ")]
    found = multiset.lanes(spark.createDataFrame(rows, "k string, text string"), ["k"], "text")
    by = {r["k"]: (r["exact"], r["signed"]) for r in found.collect()}
    assert not any(by["none"][1])
    kind = "a array<long>, b array<short>, c array<long>, d array<short>"
    pairs = spark.createDataFrame([(*by["own"], *by[k]) for k in ("more", "less")], kind)
    got = pairs.select(multiset.likeness((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("near")).collect()
    assert all(r["near"] > 0.95 for r in got)


def brute_lanes(text):
    """Exact and signed lanes from the definition: hashes of paragraphs and of every three words in a row."""
    exact, signed = np.zeros(multiset.EXACT, np.int64), np.zeros(multiset.SIGNED, np.int64)
    again = lambda h, i: xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
    for paragraph in text.split("\n"):
        first = xxhash.xxh64_intdigest(paragraph.encode(), 42)
        for i in range(multiset.EXACT // 2):
            h = again(first, 2 + i)
            exact[2 * i] += h & 0xFFFFFFFF
            exact[2 * i + 1] += h >> 32
        words = re.findall(r"[^\s]+", paragraph, re.ASCII)
        for i in range(max(1, len(words) - 2) if words else 0):
            h0 = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
            for half, h in enumerate((h0, again(h0, 1))):
                for b in range(32):
                    at = half * 64 + 2 * b
                    signed[at] += 1 if h >> b & 1 else -1
                    signed[at + 1] += 1 if h >> (b + 32) & 1 else -1
    return exact % (1 << 32), signed


def test_likeness_of_lanes_computed_anew(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    texts = ["", "one", "a b c\n\nd e f g", " ".join(words * 5), " ".join(words * 4) + "\n" + " ".join(words[::-1])]
    texts += ["same " * 10_000, "same " * 40_000, "same " * 65_538]
    found = multiset.lanes(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"], "text")
    want = [brute_lanes(t) for t in texts]
    got = {r["k"]: r for r in found.select("k", "exact", multiset._wide(F.col("signed")).alias("signed"), multiset.as_text(F.col("exact"), F.col("signed")).alias("text")).collect()}
    for k, (exact, signed) in enumerate(want):
        assert got[k]["exact"] == exact.tolist() and got[k]["signed"] == signed.tolist()
        assert got[k]["text"] == "".join(f"{int(v) & 0xFFFFFFFF:08x}" for v in [*exact, *signed])
    two = found.toDF("k", "a", "b").crossJoin(found.toDF("l", "c", "d"))
    near = two.select("k", "l", multiset.likeness((F.col("a"), F.col("b")), (F.col("c"), F.col("d"))).alias("near"))
    for r in near.collect():
        (e, x), (f, y) = want[r["k"]], want[r["l"]]
        size = np.sqrt(float(x @ x) * float(y @ y))
        cosine = 1.0 if (e == f).all() and (x == y).all() else max(0.0, float(x @ y) / size) if size else 0.0
        assert r["near"] == pytest.approx(min(1.0, cosine), abs=1e-12)
        if r["k"] in (5, 6, 7) and r["l"] in (5, 6, 7):
            assert r["near"] > 0.999


def test_lanes_beyond_sixteen_bits_are_added_and_taken_away(spark):
    rows = [("a", "same " * 40_000), ("b", "same " * 30_000), ("ab", "same " * 40_000 + "\n" + "same " * 30_000)]
    found = multiset.lanes(spark.createDataFrame(rows, "k string, text string"), ["k"], "text")
    a, b, ab = (found.filter(F.col("k") == k).toDF("k", f"{k}e", f"{k}s").drop("k") for k in ("a", "b", "ab"))
    one = a.crossJoin(b).crossJoin(ab)
    pair = lambda k: (F.col(f"{k}e"), F.col(f"{k}s"))
    added, left = multiset.combine(pair("a"), pair("b")), multiset.combine(pair("ab"), pair("b"), -1)
    assert one.filter((added[0] == F.col("abe")) & (added[1] == F.col("abs"))).count() == 1
    assert one.filter((left[0] == F.col("ae")) & (left[1] == F.col("as"))).count() == 1


def test_words_with_one_hash_are_told_apart():
    """The Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever its base."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    draw = random.Random(3)
    long = ["".join(draw.choice("ab") for _ in range(3000)) for _ in range(5)]
    texts = [word, other, f"{word} {other}", f"{other} x {word}", None, "", *long, " ".join(long)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        tool = tokenizers.Tokenizer.from_file(path)
        tool.encode_special_tokens = True
        want = [np.array(tool.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert list(tokens.Encoder(path).many(texts)) == want
        one = tokens.Encoder(path)
        assert [next(one.many([t])) for t in texts] == want


def test_pieces_unlike_their_model():
    points = np.frombuffer("ab ab abc xy".encode("utf-32-le"), np.uint32)
    starts, stops = np.array([0, 2, 5, 9]), np.array([2, 5, 9, 12])
    assert tokens.differing(points, starts, stops, np.array([0, 1, 2, 3])).tolist() == []
    assert tokens.differing(points, starts, stops, np.array([0, 1, 1, 1])).tolist() == [2, 3]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_of_odd_characters(name):
    """Blanks of all kinds, marks, letters whose lower case or normal form ends with a mark, next to signs."""
    draw = random.Random(21)
    signs = " \n\t.,ab1é中\U0001f600-'_\xa0　İß̇क़Ω²½\x1c\x85​"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(60))) for _ in range(2000)]
    texts += ["İ, aक़. İ. b", " a", "a ", "\na\n", " ", ""]
    path = public_tokenizers.path(name)
    tool = tokenizers.Tokenizer.from_file(path)
    tool.encode_special_tokens = True
    want = [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch_fast(texts, add_special_tokens=False)]
    assert list(tokens.Encoder(path).many(texts)) == want


def test_vectors_of_any_size_are_compared(spark):
    """Components near the ends of the range of doubles: products of them are infinite or zero."""
    draw = np.random.default_rng(4)
    rows, key = [], 0
    for _ in range(12):
        v = draw.normal(size=8)
        for size in (1.0, 1e200, 1e-200, 1e-310):
            rows.append((key, [float(x) for x in v * size * (1 + 0.01 * draw.normal(size=8))]))
            key += 1
    got = embedding.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    units = embedding.balanced(np.array([v for _, v in rows]))
    units = units / np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.9
    assert {r["vec_id"]: r["n_links"] for r in got} == {i: int(near[i].sum()) - 1 for i in range(len(rows))}


def test_pivots_stop_where_they_only_add_guests():
    draw = np.random.default_rng(5)
    spread = draw.normal(size=(2000, 64))
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    assert len(embedding.few_guests(spread, embedding.choose_pivots(spread, 256), 0.447)) < 32
    centres = np.eye(64)[draw.integers(0, 64, 2000)] + 0.01 * draw.normal(size=(2000, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    assert len(embedding.few_guests(centres, embedding.choose_pivots(centres, 64), 0.447)) == 64


def test_languages_predicted_anew(spark):
    """Profiles, ranks and out-of-place distances of every document, from the definition."""
    from test_queries import result, stored

    docs = stored("documents")

    def ranks(counter):
        return sorted(counter, key=lambda g: (-counter[g], g))[: langid.PROFILE]

    def grams(text):
        runs = re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower()))
        line = [1, *(ord(c) for c in "\1".join(runs)), 1] if runs else []
        found = Counter()
        for n in (1, 2, 3):
            for i in range(len(line) - n + 1):
                code = 0
                for p in line[i : i + n]:
                    code = code << 21 | p
                if n > 1 or code > 1:
                    found[code] += 1
        return found

    own = {d["doc_id"]: grams(d["text"]) for d in docs}
    held = {d["doc_id"]: zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2 for d in docs}
    sums = {}
    for d in docs:
        if d["lang"] is not None and not held[d["doc_id"]] and own[d["doc_id"]]:
            sums.setdefault(d["lang"], Counter()).update(own[d["doc_id"]])
    profiles = {k: {g: i for i, g in enumerate(ranks(c))} for k, c in sums.items()}
    got = {r["doc_id"]: r for r in result(spark, "op3_language_id")}
    for doc_id, counter in own.items():
        r, mine = got[doc_id], ranks(counter)
        assert r["held_out"] == held[doc_id]
        if not mine:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {k: sum(abs(p[g] - i) if g in p else langid.PROFILE for i, g in enumerate(mine)) for k, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert r["lang_pred"] == best and r["score"] == pytest.approx(1 - far[best] / (langid.PROFILE * len(mine)))


def test_toxicity_scored_anew(spark):
    """Scores of every document from the weights of the model: logistic of each sentence, then noisy-or."""
    from test_queries import FOLDER, result, stored

    docs = {d["doc_id"]: d["text"] or "" for d in stored("documents")}
    frames = [spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")]
    model = toxicity.train(*frames)
    assert model.weights
    for r in result(spark, "op7_toxicity"):
        clean, toxic = 1.0, 0
        for sentence in re.split(r"(?<=[.!?\n])(?![.!?\n])", docs[r["doc_id"]]):
            words = re.findall(r"\w+", sentence.lower())
            if words:
                parts = [w for w in words] + [w[:5] + "*" for w in words if len(w) > 5]
                logit = model.bias + sum(model.weights.get(p, 0.0) for p in parts)
                s = 1 / (1 + np.exp(-max(-30.0, min(30.0, logit))))
                clean *= 1 - min(s, 1 - 1e-12)
                toxic += s >= 0.5
        assert r["score"] == pytest.approx(1 - clean, abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.5) and r["n_toxic_sentences"] == toxic
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_noisy_or_is_fitted_to_its_likelihood():
    """The fit is close to where the likelihood cannot grow: steps along any weight do not raise it much."""
    draw = random.Random(2)
    bad, good = [f"bad{i}" for i in range(4)], [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(draw.choices(good, k=6)) for _ in range(4)]
        if i % 3 == 0:
            sentences[draw.randrange(4)] += " " + draw.choice(bad)
        texts.append(". ".join(sentences))
        labels.append(int(i % 3 == 0))
    model = toxicity.fit(texts, labels)
    scores = [toxicity.noisy_or(np.array([s for _, _, s in model.sentences(t)])) for t in texts]
    assert all((s >= 0.5) == bool(y) for s, y in zip(scores, labels, strict=True))
    found = [t[a:b] for t, y in zip(texts, labels, strict=True) if y for a, b, s in model.sentences(t) if s >= 0.5]
    assert all("bad" in f for f in found) and len(found) == sum(labels)


def test_rows_of_a_computed_frame_are_not_numbered(spark, tmp_path):
    frame = spark.range(50).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert numbered(stored.filter("doc_id > 3").select("text"), "n").count() == 46
    for computed in (stored.repartition(3), stored.orderBy("text"), stored.distinct(), stored.limit(5), stored.union(stored)):
        with pytest.raises(ValueError, match="stored table"):
            numbered(computed, "n")


def test_passages_left_unaligned_are_those_that_others_cover():
    """Chains are aligned as needed, with the passages that are kept if all are; few of the chains of a document are."""
    dice = random.Random(41)
    calls = 0
    for _ in range(200):
        chains, every = [], []
        for i in range(dice.randrange(1, 30)):
            low = dice.randrange(150)
            high, later, ref = dice.randrange(low + 10, 210), dice.random() < 0.5, dice.randrange(9)
            ends = (low + dice.randrange(3), high - dice.randrange(3))
            cuts = sorted(dice.sample(range(ends[0], ends[1] + 1), 2 * dice.randrange(1, 3)))
            spans = [ends] if dice.random() < 0.5 else [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
            chains.append((later, ref, low, high, i))
            every.append((ends, [(a, b, (n, i)) for n, (a, b) in enumerate(spans)]))
        whole = [(True, 200, 3, 5, (0, "whole"))] if dice.random() < 0.3 else []

        def aligned(i, every=every):
            nonlocal calls
            calls += 1
            return every[i][1]

        before = calls
        got = passages.kept_passages(chains, whole, 210, 5, lambda i, every=every: every[i][0], aligned)
        assert calls - before <= len(chains)
        rows = [(not r[0], a - b, r[1], a, it) for r in chains for a, b, it in every[r[4]][1]]
        rows += [(not later, -n, ref, first, it) for later, n, ref, first, it in whole]
        covered, kept = set(), []
        for _, size, _, first, it in sorted(rows, key=lambda r: r[:4] + (r[4][0],)):
            words = set(range(first, first - size))
            if len(words - covered) >= 5:
                covered |= words
                kept.append(it)
        assert got == kept
    one = [(True, ref, 0, 200, ref) for ref in range(9)]
    calls = 0

    def first_only(i):
        nonlocal calls
        calls += 1
        return [(0, 200, (0, i))]

    assert passages.kept_passages(one, [], 200, 5, lambda i: (0, 200), first_only) == [(0, 0)] and calls == 1


def test_passages_of_earlier_documents_are_the_same_alone(spark, tmp_path):
    """Without the links with later documents, in near copies, quotes, equal texts and a phrase of many documents."""
    dice = random.Random(42)
    text, line = random_words(dice, 150), random_words(dice, 60)
    texts = [text, text, *([w if dice.random() > 0.04 else f"x{i}" for i, w in enumerate(text)] for _ in range(12))]
    texts += [random_words(dice, 40) + line[dice.randrange(8) :] + random_words(dice, 20) + text[: dice.randrange(100)] for _ in range(30)]
    frame = stored_texts(spark, [" ".join(t) for t in texts], str(tmp_path / "d"))
    whole = sorted(map(tuple, passages.repeated_passages(frame).filter("later").collect()))
    alone = sorted(map(tuple, passages.repeated_passages(frame, earlier=True).collect()))
    assert alone == whole and len(whole) > 40


def test_seeds_in_buckets_give_the_same_links(spark, tmp_path):
    dice = random.Random(31)
    line = random_words(dice, 30)
    texts = [" ".join(random_words(dice, dice.randrange(40)) + line[: dice.randrange(10, 31)] * dice.choice((1, 2, 12))) for _ in range(60)]
    rows = passages.numbered(stored_texts(spark, texts, str(tmp_path / "d")), "uid").select("uid", "text")
    single = lambda links: sorted(map(tuple, links.select("uid", "ref", F.explode("ats")).collect()))
    usual = single(passages.linked(passages.seed_rows(rows, 5, 4, 12)))
    dealt = passages.seed_buckets(rows, 5, 4, 12, 0, passages.NOTHING, 16)
    assert usual == single(passages.linked_buckets(dealt)) and len(usual) > 1000
    assert dealt.count() <= 16 * rows.rdd.getNumPartitions() < passages.seed_rows(rows, 5, 4, 12).count()


def test_files_of_a_finished_shuffle_go_at_once(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {f for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = names()
    common.staged(spark.range(1000).repartition(4, "id"), "dealt")
    assert names() - before
    common.release(spark)
    time.sleep(1)
    assert not names() - before


def test_small_results_are_in_few_files(spark, tmp_path):
    spark.range(5000).repartition(8).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    summed = stored.repartition(7, "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = common.gathered(summed, "sums")
    assert len(found.inputFiles()) == 1 and sorted(map(tuple, found.collect())) == [(i, 1) for i in range(5000)]
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(i,) for i in range(9)], 3), "id long")
    assert common.gathered(unknown, "rows").count() == 9
    linked = components.components(stored.select("id", (F.col("id") + 1).alias("next")).filter("id < 50"), "id", "next")
    assert len(linked.inputFiles()) == 1 and linked.filter("component = 0").count() == 51


def test_the_mixture_counts_tokens_once(spark):
    """Scans of the texts for the selection count no tokens but those of the few documents around a prefix's end."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = mixing.mixed_documents(docs, 0.9, WEIGHTS, domain_of(), 1, 17)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\s+, -1") <= 1 and plan.count("Relation [doc_id") == 2
    for share, epochs in ((0.3, 1), (0.9, 3)):
        rows = []
        for with_text in (True, False):
            mixed = mixing.mix(docs, share, WEIGHTS, domain_of(), epochs, 17, with_text=with_text)
            rows.append(sorted(map(tuple, mixed.select("key", "tie", "epoch", "tokens", "take", "cut").collect())))
        assert rows[0] == rows[1] and any(r[5] for r in rows[0]) and all(r[5] == (r[4] < r[3]) for r in rows[0])


def test_a_crowd_of_holders_of_parts_hides_no_fuzzy_passage(spark, tmp_path):
    """Two changed copies of a passage; every seed they share is in far more than ``ALL`` documents, before, between and behind them."""
    dice = random.Random(51)
    copy = random_words(dice, 80)
    texts = []
    for n in range(42):
        if n in (15, 30):
            parts = [[f"x{n}{i}" if i % 16 == (4 if n == 15 else 12) else w for i, w in enumerate(copy)]]
        else:
            parts = [copy[i : i + 13] for i in range(n % 2 * 7, 68, 14)]
            dice.shuffle(parts)
        texts.append(" ".join(w for p in parts for w in random_words(dice, 60) + p) + " " + " ".join(random_words(dice, 20)))
    frame = stored_texts(spark, texts, str(tmp_path / "d"))
    found = lambda earlier: sorted(
        (r["doc_id"], r["other_doc_id"], r["n_words"], r["equal_words"]) for r in passages.repeated_passages(frame, earlier=earlier).collect()
    )
    assert found(False) == [(15, 30, 80, 70), (30, 15, 80, 70)] and found(True) == [(30, 15, 80, 70)]


def test_pairs_of_seeds_link_all_documents_that_have_both():
    """No number of documents is too large; equal words between are no chain if it would be too short."""
    half = np.array([11, 22], np.int64)
    for distance, linked in ((20, 0), (passages.STRAIGHT, 39)):
        rows = []
        for uid in range(40):
            at = np.array([3 + uid, 3 + uid + distance]) << 34 | half << 2 | 3
            if distance < passages.STRAIGHT:  # a seed every three words, so all words between are equal
                inner = np.arange(3, distance, 3)
                at = np.sort(np.r_[at, 3 + uid + inner << 34 | (1000 + inner) << 2])
            covered = np.full(len(at), uid != 39)
            rows.append(passages.pairs_of_seeds(np.full(len(at), uid), at, (covered, np.ones(len(at), bool))))
        key, uid, place, _ = (np.concatenate(c) for c in zip(*rows, strict=True))
        ends = np.isin(key, key[(place >> 2 & 63) == distance])
        links = list(passages.pair_links(key[ends], uid[ends], place[ends]))
        pairs = {(int(a), int(b)) for u, r, _ in links for a, b in zip(u, r, strict=True)}
        assert pairs == {(39, n) for n in range(linked)}
