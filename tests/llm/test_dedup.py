"""Exact and near duplicates against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup, golay, simhash
from quillstone.llm.components import components

from . import brute

SCHEMA = "doc_id long, text string"
ODD = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "z"), (None, "z"), (5, "x" * 10000), (6, "x" * 10001), (7, "x" * 10000), (8, "é" * 9000)]


def _texts(n, seed=1):
    draw = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    base = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 400))) for _ in range(n // 4)]
    rows = []
    for doc in range(n):
        text = draw.choice(base)
        if draw.random() < 0.5 and text:
            place = draw.randrange(len(text))
            text = text[:place] + draw.choice("abc") + text[place + 1 :]
        rows.append((doc * 3, text if draw.random() > 0.05 else None))
    return rows


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_exact_groups(spark, block):
    rows = _texts(60)
    got = exact_dedup.find_duplicates(spark.createDataFrame(rows, SCHEMA), block_bytes=block).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == brute.equal_groups(rows)


def test_exact_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("_row", F.lit(9)).withColumn("_name", F.lit("n"))
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact_dedup.find_duplicates(df).collect())
    assert got == [
        (0, 0, 2, False), (0, 0, 2, True), (1, 1, 2, False), (1, 1, 2, True), (2, 3, 2, False), (3, 3, 2, True),
        (5, 7, 2, False), (6, 6, 1, True), (7, 7, 2, True), (8, 8, 1, True),
    ]
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6, 7, 8]
    assert exact_dedup.find_duplicates(df.limit(0)).count() == 0


def test_golay_keys():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << golay.WORD, 3000)
    keys = golay.keys(words)
    assert (keys >= 0).sum(axis=1).max() <= 6
    a, b = draw.integers(0, golay.WORD, (2, 3000))
    other = golay.keys(words ^ (1 << a) ^ np.where(a == b, 0, 1 << b))
    assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(keys, other))


@pytest.mark.parametrize("paired_up_to", [0, 3, 50])
def test_links_of_fingerprints(spark, paired_up_to):
    draw = random.Random(2)
    prints = {draw.getrandbits(64) for _ in range(40)}
    for center in list(prints)[:6]:
        for _ in range(40):
            center ^= 1 << draw.randrange(64)
            prints.add(center if draw.random() < 0.5 else center ^ 1 << draw.randrange(64))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "print long"), paired_up_to)
    pairs = {tuple(sorted((r["a"], r["b"]))) for r in found.collect()}
    near = {tuple(sorted((a[0], b[0]))) for a in signed for b in signed if a < b and ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= 2}
    assert pairs <= near

    def groups(edges):
        parent = {p[0]: p[0] for p in signed}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return sorted(sorted(y for y in parent if root(y) == r) for r in {root(x) for x in parent})

    assert groups(pairs) == groups(near)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}


def test_near_groups(spark):
    rows = _texts(80, seed=3)
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == brute.near_groups(rows)


def test_near_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("print", F.lit("p"))
    got = sorted((r["doc_id"] or 0, r["fingerprint"][:4], r["component_id"] or 0) for r in simhash.near_duplicates(df).collect())
    zero = [g for g in got if g[1] == "0000"]
    assert len(got) == len(ODD) and zero == [(2, "0000", 2), (3, "0000", 2)]
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 2, 5, 6, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0
