"""Mixing, chat, fingerprints, archives, toxicity and licences."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import chat, licences, mixing, queries, toxicity, warc, winnowing
from quillstone.session import new_path

from ..oracle import compare, database
from . import brute

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


@pytest.mark.parametrize("name", [n for n, q in queries.QUERIES.items() if q.sql])
def test_same_as_sql(spark, name):
    assert compare(queries.QUERIES[name].build(spark, FOLDER), database(FOLDER), queries.QUERIES[name].sql) == []


def test_mix_reaches_its_weights(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2000, "big").when(F.col("id") < 2900, "small").alias("source"), F.lit(1).alias("_copies"))
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("none", 1.0), (None, 0.0)], "source string, weight double")
    got = mixing.mix(df, weights, total=40000, key="id")
    sizes = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert got.columns == [*df.columns, "_copy"] and set(sizes) == {"big", "small"}
    assert abs(sizes["big"] / 10000 - 1) < 0.05 and abs(sizes["small"] / 30000 - 1) < 0.05
    again = mixing.mix(df.repartition(5), weights, total=40000, key="id")
    assert again.exceptAll(got).isEmpty() and got.exceptAll(again).isEmpty()


def test_large_rates_are_split(spark):
    df = spark.range(400).select("id", F.lit("s").alias("source"))
    counts = [r["count"] for r in mixing.mix(df, total=400 * 900, key="id").groupBy("id").count().collect()]
    mean = sum(counts) / len(counts)
    assert abs(mean - 900) < 6 and 600 < sum((c - mean) ** 2 for c in counts) / len(counts) < 1250


def test_mix_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (None, None), (1, None)], "doc_id long, source string")
    assert mixing.mix(df, total=400).select("source").distinct().count() == 2
    assert mixing.mix(df.limit(0)).count() == 0


def test_chat_reads_back(spark):
    odd = ["<s>", "<\\s>", "\\</s>", "</s", "</s>", "<", "[", "[INST][/INST]<<SYS>><</SYS>>", "<|im_start|>", "a\nb", "\\\\", "<<\\\\SYS>>", "[\\\\INST]", "é<s>😀", None, "", "s>"]
    rows = [(i // 3 if i % 5 else None, i, "assistant" if i % 2 else ["user", "<s>\n%41", None, "tool x"][i // 2 % 4], t) for i, t in enumerate(odd + odd[::-1])]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("example", F.lit(0))
    examples = chat.expand(df)
    read = examples.filter("whole").select("conv_id", chat.turns_of(F.col("formatted")).alias("turns")).collect()
    got = sorted((-1 if r["conv_id"] is None else r["conv_id"], t["role"], t["text"]) for r in read for t in r["turns"])
    assert got == sorted((-1 if c is None else c, r or "", t or "") for c, _, r, t in rows)
    formatted = [r["formatted"] for r in examples.collect()]
    turns = [chat_text.count("<s>") == chat_text.count("</s>") for chat_text in formatted]
    assert all(turns) and not any("[INST]" in f or "<|" in f for f in formatted)
    trained = examples.select(chat.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("t")).collect()
    assert sorted(r["t"] for r in trained if r["t"]) == sorted(t for _, _, r, t in rows if r == "assistant" and t)
    assert chat.expand(df.limit(0)).count() == 0


def test_winnowing_keeps_the_rightmost_smallest(spark):
    texts = ["the quick brown fox jumps over the lazy dog and again " * 4, "abc", "", None, "aaaa " * 40, "öäü çğ " * 30, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pieces = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(winnowing.PIECE), 0)
    hashed = winnowing.with_fingerprint(df, "text", "fp").withColumn("pieces", F.transform(pieces, lambda p: F.xxhash64(p)))
    grams = F.transform(F.sequence(F.lit(0), F.size("pieces") - 5), lambda i: F.xxhash64(*[F.get("pieces", i + j) for j in range(5)]))
    for row in hashed.withColumn("grams", F.when(F.size("pieces") >= 5, grams)).collect():
        if row["grams"] is None:
            assert [m["pos"] for m in row["fp"]] == ([0] if row["pieces"] else [])
            continue
        places = brute.winnowed(row["grams"], winnowing.W, lambda h: h >> 32 & 0x7FFFFFFF)
        assert [m["pos"] for m in row["fp"]] == places and [m["hash"] for m in row["fp"]] == [row["grams"][p] for p in places]


def _hashes(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = winnowing.with_fingerprint(df, "text", "fp").orderBy("doc_id").collect()
    return [{m["hash"] for m in r["fp"]} for r in rows]


def test_winnowing_finds_passages_at_any_offset(spark):
    """A passage of w + k - 1 pieces shares a hash, spaced or not, whatever stands around it."""
    draw = random.Random(8)
    need = winnowing.W + winnowing.K - 1
    han = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(200))
    long = "".join(draw.choice("abcdefghijklmnop0123456789+/") for _ in range(1440))
    spaced = " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 9))) for _ in range(60))
    for text, cut in ((han, 1), (long, 1), (spaced, None)):
        if cut:
            shifted = ["x" * n + text for n in (1, 2, 3, 5)] if text is long else [chr(0x5000) * n + text for n in (1, 2, 3)]
            passages = [text[at : at + (need if text is han else 40)] for at in (0, 1, 7, 30, 100)]
            around = [("y" * 30 + p + "z" * 30) if text is long else (chr(0x6000) * 3 + p + " b") for p in passages]
        else:
            words = text.split()
            shifted = ["one more " + text, "x" + text]
            around = ["before " + " ".join(words[at : at + need]) + " and after" for at in (0, 1, 7, 30)]
        own, *others = _hashes(spark, [text, *shifted, *around])
        assert all(own & other for other in others)
        assert all(len(own & other) > 0.8 * len(own) for other in others[: len(shifted)])


def test_likeness_of_edits_against_a_plain_version(spark):
    draw = random.Random(4)
    words = ["w%d" % n for n in range(50)]
    rows = [(n, " ".join(draw.choices(words, k=draw.choice([0, 3, 30, 80])))) for n in range(40)] + [(10**15, "alone " * 30), (-5, rows_text := "b c " * 9), (-7, rows_text)]
    got = {r["doc_id"]: r for r in winnowing.edited_pairs(spark.createDataFrame(rows, DOCS)).collect()}
    edits = brute.edits(rows)
    order = sorted(edits, reverse=True)
    prints = dict(zip([d for d, _ in rows], _hashes(spark, [t for _, t in rows])))
    edited = dict(zip(order, _hashes(spark, [edits[d][1] for d in order])))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for n, doc in enumerate(order):
        r = got[doc]
        assert {m["hash"] for m in r["fingerprint"]} == prints[doc] and {m["hash"] for m in r["edited_fingerprint"]} == edited[doc]
        assert {m["hash"] for m in r["next_fingerprint"]} == prints[order[(n + 1) % len(order)]]
        assert r["edited"] == edits[doc][1]
    frame = spark.createDataFrame(rows, DOCS)
    liked = {r["doc_id"]: (r["e"], r["n"]) for r in winnowing.edited_pairs(frame).select("doc_id", winnowing.likeness(F.col("fingerprint.hash"), F.col("edited_fingerprint.hash")).alias("e"), winnowing.likeness(F.col("fingerprint.hash"), F.col("next_fingerprint.hash")).alias("n")).collect()}
    assert all(liked[d] == (near(prints[d], edited[d]), near(prints[d], prints[order[(n + 1) % len(order)]])) for n, d in enumerate(order))


def test_an_outlying_key_makes_no_large_block(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).union(spark.createDataFrame([(10**17, "t"), (-(10**17), "t"), (None, "t")], DOCS))
    blocks, _ = winnowing.with_next(df, "doc_id", ["text"])
    sizes = [r["count"] for r in blocks.groupBy("_block").count().collect()]
    assert max(sizes) < 400 and len(sizes) > 100


def test_edits_of_the_next_document(spark, monkeypatch):
    monkeypatch.setattr(winnowing, "ROWS_PER_BLOCK", 3)
    rows = [(n * n, "text number %d é" % n * (n % 4)) for n in range(40)] + [(-5, None)]
    got = winnowing.edited_pairs(spark.createDataFrame(rows, DOCS).withColumn("_block", F.lit(1))).collect()
    assert {r["doc_id"]: (r["n_chars"], r["edited"]) for r in got} == brute.edits(rows) and len(got) == len(rows)
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z z z"), (None, "z")], DOCS)
    assert winnowing.edited_pairs(odd).count() == 5 and winnowing.edited_pairs(odd.limit(0)).count() == 0
    assert winnowing.edited_pairs(odd.filter("doc_id = 2")).first()["edited"] == ""


def test_archives_read_back(spark):
    rows = [(n, None if n % 7 == 0 else "<p>%d é</p>" % (n % 5)) for n in range(30)] + [(99, "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.when(F.col("page_id") > 3, "http://x/\r\na")).withColumn("offset", F.lit(1))
    index = warc.write_archives(df.repartition(3), new_path(spark, "warc"))
    got = warc.read_archives(index).collect()
    assert {int(r["page"]): (r["payload_bytes"], r["digest"], r["kind"], int(r["refers_to"]) if r["refers_to"] else None) for r in got} == brute.records(rows)
    assert {r["payload"].decode() for r in got if r["kind"] == "response"} == {t or "" for _, t in rows}
    some = warc.read_archives(index.filter("page_id in (3, 20)")).collect()
    assert sorted(r["page"] for r in some) == ["20", "3"]
    large = warc.write_archives(df, new_path(spark, "warc"), least_bytes=1000)
    assert large.filter("kind = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(df.limit(0), new_path(spark, "warc"))).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, None, ""), (None, "q", "x"), (2, "u", "x"), (None, None, "y")], "page_id long, url string, html string")
    kinds = sorted((r["page"] or "", r["kind"]) for r in warc.read_archives(warc.write_archives(odd, new_path(spark, "warc"))).collect())
    assert kinds == [("", "response"), ("", "revisit"), ("1", "response"), ("1", "response"), ("2", "response")]


def _toxic_corpus(spark):
    clean = ["The weather was fine and we walked along the river number %d.", "A recipe for soup needs %d carrots and some salt.", "Meeting %d was moved to Monday."]
    toxic = ["You are a pathetic idiot and a loser, number %d!", "What disgusting scum you are, %d times stupid.", "Shut up you worthless moron %d!!"]
    rows = [(n, (toxic if n % 3 == 0 else clean)[n % 7 % 3] % n * 3, int(n % 3 == 0)) for n in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_of_held_out_documents(spark):
    docs, labels = _toxic_corpus(spark)
    got = toxicity.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 300 and all(r["predicted"] == r["toxic"] and 0 <= r["score"] <= 1 for r in held)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.score(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-12 for r in got)
    odd = spark.createDataFrame([(None, None), (5, ""), (5, "")], DOCS).withColumn("score", F.lit(1)).withColumn("label", F.lit(1))
    assert toxicity.score(odd, labels).count() == 3
    kept = toxicity.drop_toxic(docs.unionByName(odd.select("doc_id", "text")), labels)
    assert kept.columns == ["doc_id", "text"] and kept.filter("doc_id > 5 AND doc_id % 3 = 0").isEmpty()
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_learns_from_a_part_of_the_labels(spark):
    docs, labels = _toxic_corpus(spark)
    model = toxicity.fit(docs, labels, labelled_rows=300)
    assert model.trees is not None
    got = toxicity.score(docs, labels, labelled_rows=300).join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) > 0.98 * len(got)


def test_toxicity_without_two_classes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.score(df, none).collect()] == [0.0, 0.0] and toxicity.drop_toxic(df, none).count() == 2


def test_features_see_hidden_words():
    terms = frozenset(toxicity.INSULTS) | {"lowei*"}
    named = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, terms, toxicity.heads_of(terms))))
    assert named("you 1d1ot")["hidden_density"] == 0.5 and named("m*r*on")["hidden_density"] == 0
    assert named("loweichen word")["lexicon_density"] == 0.5 and named("you moron")["near_second_person"] == 1
    assert named("STOP IT!!")["shouted"] == 0.5 and named(None)["lexicon_hits"] == 0 and named("")["capitals"] == 0


def test_licence_notices_are_found(spark):
    plain = ["Some words about a river and a mountain %d\nand a second line" % n for n in range(60)]
    rows = [(n, t) for n, t in enumerate(plain)] + [
        (100, "x\nReleased under the MIT License."), (101, "word " * 200 + "Licensed under CC BY-SA 4.0. " + "more " * 100),
        (102, None), (103, ""), (None, "Licensed under the Apache License, Version 2.0."), (100, "x\nReleased under the MIT License."),
        (104, "You need a driving license to rent a car."),
    ]
    df = spark.createDataFrame(rows, DOCS).withColumn("family", F.lit("f")).withColumn("_words", F.lit(1))
    got = licences.scan(df).collect()
    assert {(r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in got} == {
        (100, 1, "MIT", True), (101, 0, "CC-BY-SA", True), (None, 0, "Apache", True),
    }
    assert sum(r["doc_id"] == 100 for r in got) == 2 and all(r["similarity"] >= 0.5 for r in got)
    assert licences.scan(df.limit(0)).count() == 0


def test_short_reservations_are_found(spark):
    """Every licence line of the given documents, and short notices of other owners."""
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines = given.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    planted = {(r["doc_id"], r["paragraph"]) for r in lines.filter(F.trim("line") == "All rights reserved.").collect()}
    more = [(10**9, "Some words.\nCopyright 2020 Foo. All rights reserved."), (10**9 + 1, "All tables were reserved.")]
    found = licences.scan(given.union(spark.createDataFrame(more, given.schema))).filter("family = 'All rights reserved'").collect()
    got = {(r["doc_id"], r["paragraph"]) for r in found}
    assert planted and planted | {(10**9, 1)} <= got and (10**9 + 1, 0) not in got


@pytest.mark.parametrize("columns", [40, 72])
def test_wrapped_notices_are_found(spark, columns):
    plain = [(n, "\n".join("Some words about a river and a mountain %d" % (n + i) for i in range(30))) for n in range(60)]
    long = [(f, t) for f, texts in licences.NOTICES.items() for t in texts if len(t) > 160]
    rows = [(100 + n, "A line before.\n\n# " + textwrap.fill(t, columns).replace("\n", "\n# ") + "\n\nAnd more words behind it.") for n, (_, t) in enumerate(long)]
    got = licences.scan(spark.createDataFrame(plain + rows, DOCS)).filter("confirmed").collect()
    assert {(100 + n, f) for n, (f, _) in enumerate(long)} <= {(r["doc_id"], r["family"]) for r in got} and min(r["doc_id"] for r in got) >= 100


def test_few_segments_are_judged_and_none_is_lost(spark):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    long = [t for texts in licences.NOTICES.values() for t in texts]
    odd = [None, "", "\n \n", "one", "\nÉtat 1-2.3\n\n" + "word " * 61, "word\n" * 100, " ".join(["a b c"] * 20 + long), "\n".join(long)]
    rows = given + [(10**9 + n, t) for n, t in enumerate(odd + [textwrap.fill("some words. " * 12 + t, 50) for t in long])]
    every = []
    for key, text in rows:
        lines = [re.findall(r"[^\W_]+(?:[-.][^\W_]+)*", line.lower()) for line in (text or "").split("\n")]
        whole = [(line, place, w) for line, found in enumerate(lines) for place, w in enumerate(found)]
        for flat, over in [([x for x in whole if x[0] == line], False) for line in range(len(lines))] + [(whole, True)]:
            for at in range(0, max(len(flat) - 31, 0) + 1, 30):
                part = flat[at : at + 60]
                if part and (part[0][0] < part[-1][0]) == over:
                    every.append((key, *part[0][:2], part[-1][0], [w for _, _, w in part]))
    docs = spark.createDataFrame(rows, DOCS)
    scanner = licences.fit(docs)
    likely = scanner.promising(docs)

    def keys(df):
        return sorted((r["_key"], r["paragraph"], r["first_word"], r["last_paragraph"], tuple(r["_words"])) for r in df.collect())

    plain = scanner.predict(spark.createDataFrame(every, likely.schema)).filter("family <> 'unknown'")
    found = keys(likely)
    assert keys(plain) == keys(scanner.predict(likely).filter("family <> 'unknown'")) != []
    assert set(found) <= {(*e[:4], tuple(e[4])) for e in every} and len(set(found)) == len(found) < len(every) / 3


def test_pipeline_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, labels).collect()}
    texts = {r["doc_id"]: r for r in docs.collect()}
    rows = [(d, r["text"]) for d, r in texts.items() if not scored[d]]
    rows = [r for r in rows if brute.equal_groups(rows)[r[0]][2]]
    near = brute.near_groups(rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    kept = docs.filter(F.col("doc_id").isin([d for d, _ in rows]))
    sizes = {}
    for d, _ in rows:
        sizes[texts[d]["source"]] = sizes.get(texts[d]["source"], 0) + 1
    total, weights = sum(sizes.values()), sum(n**0.5 for n in sizes.values())
    wanted = []
    for d, _ in rows:
        n = sizes[texts[d]["source"]]
        rate = n**0.5 * total / (weights * n)
        u = int(hashlib.md5(b"42:draw:%d:1" % d).hexdigest()[:13], 16) / 2**52
        p = cdf = 2.718281828459045**-rate
        k = 0
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        wanted += [d] * k
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(wanted) and all(r["lossless"] for r in got)
    assert kept.count() == len(rows) and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "source_mix", "bpe"]
    step = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, FOLDER)
        assert step.columns == docs.columns
