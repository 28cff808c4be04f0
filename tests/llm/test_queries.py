"""Every operator query against a brute-force version, on small whole tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import defaultdict
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tokenizers
import xxhash

import corpus_pipeline
from tidemark.llm import passages
from tidemark.llm.queries import DOMAINS, MIX_EPOCHS, MIX_SEED, MIX_SHARE, QUERIES, WEIGHTS

FOLDER = "/root/testdata/sf0.001"


def stored(name, folder=FOLDER):
    con = duckdb.connect()
    found = con.execute(f"SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    names = [c[0] for c in found.description]
    return [dict(zip(names, row, strict=True)) for row in found.fetchall()]


def result(spark, name, folder=FOLDER):
    return [row.asDict() for row in QUERIES[name](spark, folder).collect()]


def ids_of(name, texts, end):
    tool = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    tool.encode_special_tokens = True
    return [np.array([*tool.encode(t or "", add_special_tokens=False).ids, end], "<u4") for t in texts]


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def test_token_files(spark):
    docs = sorted(stored("documents"), key=lambda d: d["doc_id"])
    start, want = 0, []
    for doc, ids in zip(docs, ids_of("word_bpe_49k.json", [d["text"] for d in docs], 2), strict=True):
        want.append({"doc_id": doc["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())})
        start += len(ids)
    got = result(spark, "op1_token_binary")
    assert sorted(got, key=lambda r: r["doc_id"]) == want


def test_simhash(spark):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    prints = {}
    for doc in stored("documents", "/root/testdata/sf0.01"):
        words = (doc["text"] or "").encode().translate(lower).split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    links = [(a, b) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    least = groups(sorted(prints), links)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op2_simhash", "/root/testdata/sf0.01")}
    assert got == {d: (f"{p:016x}", least[d]) for d, p in prints.items()}


def test_language(spark):
    lang = {d["doc_id"]: d["lang"] for d in stored("documents")}
    got = result(spark, "op3_language_id")
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_shares(total, weights, supplies):
    given = [0] * len(weights)
    left = [i for i, w in enumerate(weights) if w > 0 and supplies[i] > 0]
    whole = min(total, sum(supplies[i] for i in left))
    while left and whole > sum(given):
        rest, of = whole - sum(given), sum(weights[i] for i in left)
        full = {i for i in left if rest * weights[i] / of >= supplies[i]}
        for i in full:
            given[i] = supplies[i]
        if full:
            left = [i for i in left if i not in full]
            continue
        exact = {i: rest * weights[i] / of for i in left}
        for i in left:
            given[i] = int(exact[i])
        for i in sorted(left, key=lambda i: (given[i] - exact[i], i))[: whole - sum(given)]:
            given[i] += 1
        break
    return given


def brute_budgets(tokens, total, weights, epochs, default=1.0):
    """Tokens of each leaf, dealt out from the root down."""
    found = {}

    def deal(path, budget):
        if len(path) == len(weights):
            found[path] = budget
            return
        below = [leaf for leaf in tokens if leaf[: len(path)] == path]
        names = sorted({leaf[len(path)] for leaf in below}, key=lambda n: (n is None, n or ""))
        supplies = [epochs * sum(tokens[leaf] for leaf in below if leaf[len(path)] == n) for n in names]
        level = weights[len(path)]
        for name, own in zip(names, brute_shares(budget, [level.get(n, default) for n in names], supplies), strict=True):
            deal((*path, name), own)

    if tokens:
        deal((), total)
    return found


def test_mixing(spark):
    """Budgets, the documents of every prefix by their hashes, and what is cut, from the definition."""
    docs = stored("documents")
    number = lambda s: int(s[3:]) if s and s[3:].isdigit() else 0
    leaf = {d["doc_id"]: (DOMAINS[number(d["source"]) % 4], d["lang"], d["source"]) for d in docs}
    words = {d["doc_id"]: len((d["text"] or "").split()) for d in docs}
    supply = defaultdict(int)
    for d, key in leaf.items():
        supply[key] += words[d]
    supply = {k: v for k, v in supply.items() if v}
    want = brute_budgets(supply, int(MIX_SHARE * sum(words.values())), WEIGHTS, MIX_EPOCHS)
    hashed = lambda h, i, n: xxhash.xxh64_intdigest(i.to_bytes(n, "little"), h)
    expected = {}
    for key, budget in want.items():
        for epoch in range(MIX_EPOCHS):
            # Spark's hash of (seed, epoch, key), as signed numbers; buckets by its leading bits, unsigned.
            order = {d["doc_id"]: hashed(hashed(hashed(42, MIX_SEED, 4), epoch, 8), d["doc_id"], 8) for d in docs if leaf[d["doc_id"]] == key}
            signed = lambda h: h - (1 << 64) if h >> 63 else h
            for d in sorted(order, key=lambda d: (order[d] >> 48, signed(order[d]), d)):
                if words[d] and budget > 0:
                    expected[d, epoch] = min(budget, words[d])
                    budget -= expected[d, epoch]
    got = {(r["doc_id"], r["epoch"]): r for r in result(spark, "op4_mixing")}
    assert {k: r["take_tokens"] for k, r in got.items()} == expected
    text = {d["doc_id"]: d["text"] for d in docs}
    cut = 0
    for (d, _), r in got.items():
        assert leaf[d] == (r["domain"], r["lang"], r["source"]) and r["n_tokens"] == words[d]
        prefix = text[d]
        if r["take_tokens"] < words[d]:
            ends = [m.end() for m in re.finditer(r"\S+", prefix, re.ASCII)]
            prefix = prefix[: ends[r["take_tokens"] - 1]]
            cut += 1
        assert (r["prefix_chars"], r["prefix_crc32"]) == (len(prefix), zlib.crc32(prefix.encode()))
    assert cut > 3


def check_packed(pieces, docs, name="byte_bpe_50k.json"):
    ids = dict(zip([d["doc_id"] for d in docs], ids_of(name, [d["text"] for d in docs], 0), strict=True))
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        assert p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        by_doc[p["doc_id"]].append((p["start"], p["length"]))
        by_window[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[d])
    assert sorted(by_window) == list(range(len(by_window)))
    padding = total = 0
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
        total += at
    assert padding < 0.002 * total + 8


def test_packing(spark):
    check_packed(result(spark, "op5_packing"), stored("documents"))


def test_multiset(spark):
    docs = sorted(stored("documents"), key=lambda d: d["doc_id"])
    texts = [d["text"] or "" for d in docs]
    got = {r["doc_id"]: r for r in result(spark, "op6_multiset_hash")}
    prints = {}
    for i, doc in enumerate(docs):
        r, own, after = got[doc["doc_id"]], texts[i], texts[(i + 1) % len(texts)]
        edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert prints.setdefault(own, r["fingerprint"]) == r["fingerprint"]
    paragraphs = {tuple(sorted(t.split("\n"))) for t in texts}
    assert len(set(prints.values())) == len(paragraphs)
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {d["doc_id"]: d["toxic"] for d in stored("labels", folder)}
    got = result(spark, "op7_toxicity", folder)
    assert len(got) == len(stored("documents", folder))
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    right = [r["predicted"] == toxic[r["doc_id"]] for r in held]
    caught = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    assert np.mean(right) > 0.95 and np.mean(caught) > 0.8


def test_warc(spark):
    pages = stored("pages")
    last = {}
    for p in pages:
        body = (p["html"] or "").encode()
        last[body] = max(p["page_id"], last.get(body, p["page_id"]))
    want = []
    for p in pages:
        body = (p["html"] or "").encode()
        own = last[body] == p["page_id"]
        want.append({
            "page_id": p["page_id"], "payload_bytes": len(body),
            "payload_digest": base64.b32encode(hashlib.sha1(body).digest()).decode(),
            "record_type": "response" if own else "revisit", "refers_to": None if own else last[body],
        })
    got = result(spark, "op8_warc")
    assert sorted(got, key=lambda r: r["page_id"]) == sorted(want, key=lambda r: r["page_id"])


def test_embeddings(spark):
    folder = "/root/testdata/sf0.1"
    rows = stored("embeddings", folder)
    ids = [r["vec_id"] for r in rows]
    vectors = np.array([r["embedding"] for r in rows], float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    near = vectors @ vectors.T >= 0.9
    np.fill_diagonal(near, False)
    least = groups(sorted(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in result(spark, "op9_embedding_join", folder)}
    assert got == {v: (int(near[i].sum()), least[v], least[v] == v) for i, v in enumerate(ids)}


def runs_of_words(docs, words):
    """Documents by each run of so many words."""
    found = defaultdict(set)
    for d in docs:
        own = [w.lower() for w in passages.WORD.findall(d["text"] or "")]
        for i in range(len(own) - words + 1):
            found[tuple(own[i : i + words])].add(d["doc_id"])
    return found


def test_passages(spark):
    folder = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: d for d in stored("documents", folder)}
    got = result(spark, "op10_passages", folder)
    for r in got:
        assert r["doc_id"] != r["other_doc_id"] and r["n_words"] >= 50 and r["similarity"] >= 0.8
        own = [w.lower() for w in passages.WORD.findall(docs[r["doc_id"]]["text"][r["start"] : r["end"]])]
        assert len(own) == r["n_words"]
        other = [w.lower() for w in passages.WORD.findall(docs[r["other_doc_id"]]["text"])]
        other = other[r["other_start_word"] : r["other_start_word"] + r["other_n_words"]]
        assert passages.common_words(own, other) >= r["equal_words"] >= 0.8 * max(len(own), len(other))
    # Every document with an exact run of 50 words of another document is found, with all its runs.
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append((r["start"], r["end"]))
    shared = {run for run, own in runs_of_words(docs.values(), 50).items() if len(own) > 1}
    for d, doc in docs.items():
        words = list(passages.WORD.finditer(doc["text"] or ""))
        text = [m[0].lower() for m in words]
        for i in range(len(text) - 49):
            if tuple(text[i : i + 50]) in shared:
                middle = words[i + 25].start()
                assert any(a <= middle < b for a, b in spans[d]), (d, i)


def test_pipeline(spark):
    docs = {d["doc_id"]: d for d in stored("documents")}
    now = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = len(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        found = corpus_pipeline.staged(stage(spark, now, FOLDER), name)
        assert found.columns == now.columns
        rows = found.count()
        assert 0 < rows <= before
        now, before = found, rows
    kept = [r.asDict() for r in now.collect()]
    assert len({r["doc_id"] for r in kept}) == len(kept)
    assert not [run for run, own in runs_of_words(kept, 50).items() if len(own) > 1]
    packed = corpus_pipeline.STAGES[4][1](spark, now, FOLDER)
    check_packed([r.asDict() for r in packed.collect()], kept)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_again(spark, name):
    first, second = ([tuple(r) for r in QUERIES[name](spark, FOLDER).collect()] for _ in range(2))
    assert sorted(map(repr, first)) == sorted(map(repr, second))


def test_near_copies(spark):
    folder = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: d["text"] or "" for d in stored("documents", folder)}
    shingles = {}
    for d, text in docs.items():
        words = text.encode().lower().split()
        shingles[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    alike = lambda a, b: len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, frame, folder).collect()}
    for d in set(docs) - kept:
        assert any(alike(d, k) for k in kept)
    pairs = [p for p in combinations(sorted(docs), 2) if alike(*p)]
    left = [p for p in pairs if set(p) <= kept]
    assert pairs and left == []
