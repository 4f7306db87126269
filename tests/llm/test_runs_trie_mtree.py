"""Periodic runs, the prefix trie and the M-tree search against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from probewise.llm import mtree, periods, prefix_trie
from probewise.llm.catalog import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not FOLDER.exists(), reason="needs the given tables")


# periodic runs


def expected_runs(words, exponent=4, least=6):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            end = i + q
            if end - start >= max(least, exponent * q) and not any(p < q and s <= start and end <= e for s, e, p in found):
                found[start, end, q] = True
    return sorted((s, e - s, p) for s, e, p in found)


def expected_collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def periodic_texts(seed, texts):
    """Texts of few words with periodic parts of any period, some of them nested."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(texts):
        words = []
        while rng.random() < 0.8 and len(words) < 900:
            unit = [f"w{x}" for x in rng.integers(0, rng.integers(1, 5) + 1, rng.integers(1, 60))]
            if rng.random() < 0.4:
                unit = unit[:3] * int(rng.integers(1, 9)) + ["z"]
            part = unit * int(rng.integers(1, 9))
            words += part[: len(part) - int(rng.integers(0, len(unit)))]
        out.append(" ".join(words))
    return out


def test_runs_of_random_texts():
    texts = periodic_texts(5, 400)
    known = {}
    numbers = [periods.word_numbers(t.encode(), known) for t in texts]
    for text, found in zip(texts, periods.runs_of(numbers)):
        assert [tuple(r) for r in found.tolist()] == expected_runs(words_of(text))
    # alone or together, and whatever the length of the rest, the runs are the same
    for ids, found in list(zip(numbers, periods.runs_of(numbers)))[:40]:
        assert np.array_equal(periods.runs_of([ids])[0], found)


def test_every_period_up_to_a_quarter():
    rng = np.random.default_rng(8)
    for q in [*range(1, 70), 127, 128, 129, 500]:
        unit = rng.integers(0, 1 << 40, q)
        for repeats in (4, 5.5):
            run = np.resize(unit, int(q * repeats))
            text = np.concatenate([rng.integers(1 << 41, 1 << 42, 37), run, rng.integers(1 << 43, 1 << 44, 11)])
            wanted = [[37, len(run), q]] if len(run) >= 6 else []
            assert periods.runs_of([text])[0].tolist() == wanted


def test_choice_depends_on_the_context_alone():
    rng = np.random.default_rng(2)
    common = rng.integers(0, 3, 200)
    chosen = []
    for front in (0, 17):
        text = np.concatenate([rng.integers(0, 3, front), common, rng.integers(0, 3, 40)]).astype(np.uint64)
        hashes, size = periods.mixed(text, text), 1
        while size < 8:
            hashes, size = periods.mixed(hashes[:-size], hashes[size:]), 2 * size
        places = periods.chosen_places(hashes, size, np.zeros(len(hashes), bool))
        chosen.append({int(p) - front for p in places if front <= p <= front + 200 - 2 * size})
        # every window of that size has one
        assert all(any(i <= p < i + size for p in chosen[-1]) for i in range(200 - 3 * size))
    assert chosen[0] == chosen[1]


def test_runs_as_rows(spark):
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(150_000)) + " again and" * 700
    texts = [None, "", " \n ", "a", "a a a a a a", "a a a a a", "x a b a b a b a b y", "x a b a b a b a b y", "é\x85 é\x85 é\x85 é\x85 é\x85 é\x85 😀", long, *periodic_texts(6, 30)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "a a a a a a", "r", 1), (4, texts[4], "r", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, _key int")
    found = Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periods.periodic_runs(docs).collect())
    wanted = Counter()
    for key, text, *_ in rows:
        words = words_of(text)
        runs = [(0, 150_000, 997 * 31), (150_000, 1400, 2)] if text == long else expected_runs(words)
        wanted[key, len(words), tuple(runs), expected_collapsed(words, runs)] += 1
    assert found == wanted
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_long_texts_are_split_alike(monkeypatch):
    text = " ".join(periodic_texts(7, 6)).encode()
    known, again = {}, {}
    whole = periods.word_numbers(text, known)
    monkeypatch.setattr(periods, "SPLIT_BYTES", 5)
    assert np.array_equal(whole, periods.word_numbers(text, again)) and list(known) == list(again)


@needs_tables
def test_query_of_runs(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    for row in QUERIES["op11_periodic_runs"](spark, str(FOLDER)).collect():
        words, h = words_of(texts[row.doc_id]), zlib.crc32(str(row.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = expected_runs(words)
        best = min(((-length, start, p) for start, length, p in runs), default=(None,) * 3)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        assert row.n_runs == len(runs) and row.start == best[1] and row.period == best[2]
        assert row.length == (-best[0] if runs else None)
        assert row.exponent_milli == (1000 * -best[0] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(expected_collapsed(words, runs).encode()).hexdigest()


# prefix trie


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def expected_trie(convs):
    members = defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    out = set()
    for node, inside in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in below if m)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def conversation_rows(seed, convs, first=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(first, first + convs):
        if rng.random() < 0.1:
            continue
        for turn in range(int(rng.integers(1, 9))):
            text = None if rng.random() < 0.1 else "é" * int(rng.integers(0, 3))
            rows.append((c, None if turn == 0 and rng.random() < 0.3 else turn, None if rng.random() < 0.1 else "u", text))
    return rows


@pytest.mark.parametrize(("seed", "first", "bits"), [(1, 0, 12), (2, 0, 2), (3, -120, 0), (4, 57, 3)])
def test_trie_of_random_conversations(spark, seed, first, bits):
    rows = conversation_rows(seed, 240, first) + [(None, 0, "u", "x")]
    df = spark.createDataFrame([(*r, 1, "d") for r in rows], "conv_id long, turn long, role string, text string, pos int, depth string")
    turns, convs = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(df))
    found = prefix_trie.prefix_trie(turns, convs, bits).collect()
    wanted = expected_trie(rebuilt(rows))
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_trie_without_and_with_long_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(prefix_trie.ordered_turns(none))).collect() == []
    # a turnless conversation is a member of the root, and equal turns are ordered alike in every run
    lone = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 1)
    rows = [(lone, 0, "u", "x"), (200, 3, "a", "same"), (200, 3, "a", "same"), *[(300, i, "u", f"{i % 7}") for i in range(3000)], *[(301, i, "u", f"{i % 7}") for i in range(3000)]]
    turns, convs = prefix_trie.with_shared_heads(prefix_trie.ordered_turns(spark.createDataFrame(rows, schema)))
    found = {(r.conv_id, r.depth): r for r in prefix_trie.prefix_trie(turns, convs).collect()}
    root = found[lone, 0]
    assert (root.n_convs, root.n_children, root.parent_conv_id) == (4, 2, None)
    assert root.ends_sha256 == hashlib.sha256(str(lone).encode()).hexdigest()
    assert root.saved_tokens == 3000 and found[300, 3000].n_convs == 2 and found[200, 2].n_leaves == 1


def test_texts_of_nodes(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yes"), (2, 0, "u", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = prefix_trie.ordered_turns(df)
    nodes = prefix_trie.prefix_trie(turns, df.select("conv_id").distinct())
    texts = df.withColumn("pos", F.col("turn") + 1).select("conv_id", "pos", "role", "text")
    assert {(r.conv_id, r.depth, r.text) for r in prefix_trie.node_texts(nodes, texts).collect()} == {(1, 0, None), (1, 1, "hi"), (1, 2, "yes")}


# M-tree


def expected_top(rows, k, asked):
    whole = set()
    for key, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) for x in v):
            whole.add((mtree.NO_ID if key is None else key, tuple(int(np.floor(256 * x)) for x in v)))
    queries = {}
    for key, x in whole:
        if key != mtree.NO_ID and asked(key):
            queries[key] = min(x, queries.get(key, x))
    out = set()
    for key, q in queries.items():
        scores = [(-sum(a * b for a, b in zip(q, x)), c) for c, x in whole if c != key]
        for rank, (score, c) in enumerate(sorted(scores)[:k], 1):
            out.add((key, rank, None if c == mtree.NO_ID else c, -score))
    return out


def clustered(rng, n, width, centres):
    points = rng.normal(size=(centres, width))
    v = points[rng.integers(0, centres, n)] + 0.05 * rng.normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("tree_rows", "cells", "query_rows"), [(8192, 1024, 4096), (40, 4, 7), (25, 100, 3)])
def test_search_of_odd_rows(spark, tree_rows, cells, query_rows):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered(rng, 300, 6, 8))]
    rows += [(300 + i, rows[50][1]) for i in range(60)] + [(400 + i, [0.5, 0.25]) for i in range(3)]
    rows += [(None, rows[50][1]), (500, None), (501, [float("nan")] * 6), (502, [1.0, None, 1.0]), (503, []), (504, [3e4] * 6), (100, rows[100][1]), (600, [0.0] * 6), (100, [0.1] * 9), rows[7]]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, score double, id string")
    found = mtree.topk_inner(df, F.col("id") % 50 == 0, 5, tree_rows=tree_rows, cells=cells, query_rows=query_rows).collect()
    wanted = expected_top(rows, 5, lambda key: key % 50 == 0)
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


def test_search_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert mtree.topk_inner(none, F.col("id") % 50 == 0, 5).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None)], schema)
    assert [tuple(r) for r in mtree.topk_inner(few, F.col("id") % 50 == 0, 5).collect()] == [(0, 1, 1, 4 * 65536)]
    assert mtree.topk_inner(few, F.col("id") > 5, 5).collect() == []
    # components whose products are too large for floating point, or for 64 bits
    large = spark.createDataFrame([(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 3.0]), (50, [3e30, 0.0])], "vec_id long, embedding array<double>")
    top = [tuple(r) for r in mtree.topk_inner(large.where("vec_id < 50"), F.col("id") == 0, 2).collect()]
    assert top == [(0, 1, 2, 768_000_000**2 + 256 * 768), (0, 2, 1, 768_000_000**2 + 256 * 512)]
    assert [(r.vec_id, r.score) for r in mtree.topk_inner(large, F.col("id") == 50, 1).collect()] == [(0, 2**63 - 1)]


def test_stored_distances_save_work():
    rng = np.random.default_rng(4)
    vectors = np.floor(256 * clustered(rng, 6000, 16, 60))
    ids = np.arange(6000)
    pages = mtree.build_tree(ids, vectors, 32)
    assert max(len(p.refs) for p in pages) <= 32
    assert sorted(i for p in pages if p.leaf for i in p.refs.tolist()) == ids.tolist()
    computed = []
    for q in range(0, 6000, 300):
        seen = []
        got, scores = mtree.best_first(pages, vectors[q], q, 5, seen=seen)
        products = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -products)) if i != q][:5]
        assert got.tolist() == order and scores.tolist() == products[order].tolist()
        computed.append(sum(seen))
        # a floor at the k-th score loses nothing and saves more
        again = []
        assert mtree.best_first(pages, vectors[q], q, 5, float(scores[-1]), again)[0].tolist() == order
        assert sum(again) <= sum(seen)
    assert np.mean(computed) < 0.2 * 6000


def test_covering_radii():
    rng = np.random.default_rng(6)
    vectors = np.floor(50 * rng.normal(size=(700, 5)))
    vectors[100:400] = vectors[100]
    pages = mtree.build_tree(np.arange(700), vectors, 16)

    def below(number):
        page = pages[number]
        return page.refs.tolist() if page.leaf else [i for r in page.refs.tolist() for i in below(r)]

    assert sorted(below(0)) == list(range(700))
    for page in pages:
        for i, ref in enumerate([] if page.leaf else page.refs.tolist()):
            rows = vectors[below(ref)]
            away = np.linalg.norm(rows - page.objects[i], axis=1)
            assert away.max() <= page.radius[i] + 1e-6 and (rows**2).sum(axis=1).max() == page.peak[i]
            assert np.allclose(pages[ref].to_parent, np.linalg.norm(pages[ref].objects - page.objects[i], axis=1))
