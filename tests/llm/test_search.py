"""Periodic runs, nearest neighbours and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import lexical, neighbours, queries, runs

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def _runs(words, least=12):
    """(start, length, period) by comparing all pairs of words."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - p:
            end = at
            while end < len(words) - p and words[end] == words[end + p]:
                end += 1
            if end - at >= p and end - at + p >= least:
                found.setdefault((at, end + p), p)
            at = max(end, at + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def _periodic(draw, n):
    words = [draw.randrange(draw.choice([1, 2, 3, 40])) for _ in range(n)]
    if n > 20 and draw.random() < 0.6:
        start, period = draw.randrange(n // 2), draw.randint(1, n // 4)
        words = [w if i < start else words[start + (i - start) % period] for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_random_sequences(seed):
    draw = random.Random(seed)
    for _ in range(40):
        texts = [_periodic(draw, draw.choice([0, 1, 2, 11, 12, 13, 40, 150])) for _ in range(draw.randint(0, 6))]
        got = runs.runs_of([np.array(t, np.int64) for t in texts])
        assert [[tuple(r) for r in g.tolist()] for g in got] == [_runs(t) for t in texts]


def test_runs_of_regular_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    morse = [n.bit_count() & 1 for n in range(512)]
    for words in (b, morse, [0] * 300, [0, 1] * 100 + [0], [0, 0, 1] * 60 + [0, 0, 0]):
        assert [tuple(r) for r in runs.runs_of([np.array(words)])[0].tolist()] == _runs(words)


def test_common_extensions_of_a_grammar():
    draw = np.random.default_rng(3)
    sequence = np.append(np.append([9], np.tile(draw.integers(0, 2, 37), 9)[:300]), [10])
    grammar = runs.Grammar(sequence)
    assert len(grammar.symbols[-1]) == 1 and len(grammar.symbols[0]) == 302
    x, y = np.array([(x, y) for x in range(1, 300, 3) for y in range(x + 1, 301, 5)]).T
    plain = [next(n for n in range(400) if sequence[a + n] != sequence[b + n]) for a, b in zip(x, y)]
    assert grammar.common(x, y).tolist() == plain
    back = grammar.mirrored().common(302 - x, 302 - y)
    assert back.tolist() == [next(n for n in range(400) if sequence[a - 1 - n] != sequence[b - 1 - n]) for a, b in zip(x, y)]


def _run_row(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_runs_query_against_a_plain_version(spark):
    got = {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, FOLDER).collect()}
    want = {r["doc_id"]: _run_row(*r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 10


def test_runs_of_odd_rows(spark):
    long = "x y " * 400_000 + "end"
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 20), (4, "a " * 20), (4, "a " * 20), (5, long), (6, "é é " * 14), (7, "a b c")]
    df = spark.createDataFrame(rows, DOCS).withColumn("runs", F.lit("r")).withColumn("_key", F.lit(1))
    got = runs.find_runs(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got) == [
        (0, 20, [(0, 20, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 20, [(0, 20, 1)], "a"), (4, 20, [(0, 20, 1)], "a"),
        (5, 800_001, [(0, 800_000, 2)], "x y end"), (6, 14, [(0, 14, 1)], "é é"), (7, 3, [], "a b c"),
    ]
    assert runs.find_runs(df.limit(0)).count() == 0


def _nearest(rows, asked, k=5):
    """{query: [(key, score)]} of (key, vector) rows with distinct keys."""
    vectors = {key: np.array(v, float) for key, v in rows}
    out = {}
    for q in asked:
        a = vectors[q]
        scores = [(-(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), key) for key, b in vectors.items() if key != q]
        out[q] = [(key, -s) for s, key in sorted(scores)[:k]]
    return out


def test_neighbours_query_recall(spark):
    got = {}
    for r in queries.op12_nearest_vectors(spark, FOLDER).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = _nearest(rows, [key for key, _ in rows if key % 50 == 0])
    assert got.keys() == want.keys() and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({key for key, _ in got[q].values()} & {key for key, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert all(abs(got[q][rank][1] - dict(want[q]).get(got[q][rank][0], got[q][rank][1])) < 1e-12 for q in got for rank in got[q])


def test_neighbours_of_groups_of_equal_vectors(spark):
    draw = np.random.default_rng(4)
    rows = [(n, [1.0, 2.0, 3.0, 4.0]) for n in range(300)] + [(300 + n, draw.standard_normal(4).tolist()) for n in range(300)]
    asked = [0, 1, 150, 299, 300, 420, 599]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id").isin(asked), neighbours=8, reverse=8)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append((r["_key"], r["score"]))
    want = _nearest(rows, asked)
    for q in asked[:4]:  # equal vectors: the smallest other keys
        assert [key for key, _ in got[q]] == [n for n in range(6) if n != q][:5]
    assert sum(len({x for x, _ in got[q]} & {x for x, _ in want[q]}) for q in asked[4:]) >= 14


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1e300, 1e300]), (3, [0.0, -0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, [1.0]), (None, [1.0, 1.0]), (9, [-1e-300, 0.0]), (10, [2.0, 0.0]), (11, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)).withColumn("score", F.lit(2))
    got = sorted((r["query"], r["rank"], r["_key"], round(r["score"], 9)) for r in neighbours.nearest(df, F.col("vec_id") < 9).collect())
    half = round(math.sqrt(0.5), 9)
    assert got == [(1, 1, 10, 1.0), (1, 2, 2, half), (1, 3, 9, -1.0), (2, 1, 1, half), (2, 2, 10, half), (2, 3, 9, -half)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 2"), F.lit(True)).count() == 0


def test_blocks_of_queries_change_nothing(spark):
    df = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    graph = neighbours.build(df)
    asked = neighbours.usable(df, "embedding", "vec_id").filter("_key % 100 = 0")
    one, more = (sorted(map(tuple, neighbours.search(graph, asked, query_bytes=b).collect())) for b in (1 << 20, 900))
    assert one == more and len(one) == 25
    graph.release()


TERMS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _ranked(docs, items, k=50):
    """{item: [(key, score)]} by scoring every document for every item."""
    found = [(key, [t.lower() for t in TERMS.findall((text or "").encode())]) for key, text in docs]
    found = [(key, words) for key, words in found if words]
    n_docs, n_terms = len(found), sum(len(w) for _, w in found)
    df = {}
    for _, words in found:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(t.lower() for t in TERMS.findall((text or "").encode()))
    out = {}
    for item, words in asked.items():
        scores = []
        for key, there in found:
            m = 50 + 50 * len(there) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * there.count(w) // (1000 * there.count(w) + 20 * m)) for w in words if w in there)
            if score and key is not None:
                scores.append((-score, key))
        if scores:
            out[item] = [(key, -s) for s, key in sorted(scores)[:k]]
    return out


def _found(frame, item="item_id", key="doc_id"):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r[item], r["rank"])):
        assert r["rank"] == len(out.setdefault(r[item], [])) + 1
        out[r[item]].append((r[key], r["score"]))
    return out


@pytest.mark.parametrize("terms_at_once,k", [(200_000, 50), (40, 3), (200_000, 1)])
def test_search_against_a_plain_version(spark, terms_at_once, k):
    draw = random.Random(6)
    vocabulary = ["w%d" % int(draw.paretovariate(0.7)) for _ in range(4000)]
    docs = [(n * 3 % 1009, " ".join(draw.choices(vocabulary, k=draw.choice([0, 1, 5, 60, 300])))) for n in range(300)]
    docs += [(2000 + n, docs[7][1]) for n in range(30)] + [(docs[9][0], docs[9][1])]
    items = [(n, " ".join(draw.choices(vocabulary, k=draw.choice([1, 3, 20, 80])))) for n in range(25)] + [(100, "w1"), (101, "nowhere"), (102, "")]
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert _found(lexical.search(*frames, k=k, terms_at_once=terms_at_once)) == _ranked(docs, items, k)


def test_search_of_odd_rows(spark):
    docs = [(1, "Straße ÉTÉ a-b"), (2, None), (3, ""), (None, "a b"), (4, "a\u0000b éTÉ"), (5, "b " * 200_000 + "a"), (6, "x"), (6, "x")]
    items = [(1, "STRAßE"), (1, "ÉTé b"), (2, None), (None, "a"), (3, "A"), (4, "x y")]
    frames = spark.createDataFrame(docs, DOCS).withColumn("rank", F.lit(0)), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("a"))
    got = _found(lexical.search(*frames))
    assert got == _ranked(docs, items) and [key for key, _ in got[4]] == [6, 6]
    assert lexical.search(frames[0].limit(0), frames[1]).count() == 0 and lexical.search(frames[0], frames[1].limit(0)).count() == 0


def test_accumulators_stop_early(spark, monkeypatch):
    """With one rare and many common terms only the documents with the rare one are scored in full."""
    docs = [(n, "a b c d e f g h " + ("rare " * 20 if n % 50 == 0 else "")) for n in range(500)]
    seen = []
    lists = lexical._Lists.of

    def watched(chosen, *rest):
        seen.append(int(chosen.sum()))
        return lists(chosen, *rest)

    monkeypatch.setattr(lexical._Lists, "of", staticmethod(watched))
    monkeypatch.setattr(lexical, "FIRST_TERMS", 1)
    items = [(1, "a b c d e f g h rare")]
    got = _found(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), k=5))
    assert got == _ranked(docs, items, 5) and seen == [1, 1, 8]
