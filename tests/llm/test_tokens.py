"""Encoders against the tokenizers library, and the files against what was written."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from quillstone.llm import bpe, token_files
from quillstone.session import new_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aé ß\n\t  '`s'll123٣Ⅷ　 ​漢字😀́x\x85\x1c\x00\rİΣσ가ᄀ\x0b.,!?"


def _texts(n):
    draw = random.Random(1)
    parts = ["<|endoftext|>", " the", "don't", "Word.", "<|startoftext|>"]
    return ["".join(draw.choice(parts) if draw.random() < 0.2 else draw.choice(LETTERS) for _ in range(draw.randint(0, 25))) for _ in range(n)]


def test_bpe_as_the_library():
    theirs, mine = Tokenizer.from_file(BYTES), bpe.Bpe(BYTES)
    for text in [*_texts(4000), "a" * 3000, "ab" * 2000 + " "]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(text), np.int32).tolist() == ids, text
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    draw = random.Random(2)
    for _ in range(1000):
        ids = [draw.randrange(50257) for _ in range(5)]
        assert mine.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_in_spark(spark):
    rows = [(n, t) for n, t in enumerate(_texts(50))] + [(None, None), (7, "x"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, body string").selectExpr("*", "1 AS decoded")
    theirs = Tokenizer.from_file(BYTES)
    got = bpe.round_trip(df.drop("decoded"), BYTES, text="body").collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    want = [(d, theirs.encode(t or "", add_special_tokens=False).ids, t or "") for d, t in sorted(rows, key=key)]
    assert [(r["doc_id"], r["ids"], r["decoded"]) for r in sorted(got, key=key)] == want
    coded = bpe.encode(df, BYTES, text="body")
    assert coded.columns == ["doc_id", "decoded", "ids"]
    assert sorted(r["text"] for r in bpe.decode(coded, BYTES).collect()) == sorted(t or "" for _, t in rows)
    assert bpe.round_trip(df.limit(0).drop("decoded"), BYTES, text="body").count() == 0


def test_words_as_the_library():
    theirs, mine = Tokenizer.from_file(WORDS), token_files.WordEncoder(WORDS)
    texts = _texts(4000)
    want = [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch(texts, add_special_tokens=False)]
    assert mine(texts) == want and mine(texts) == want and mine([None]) == [b""]
    letters = [chr(c) for c in range(1, 0x300)]
    odd = [f"a{c}b {c} x{c}, {c}. {c}{c}, É{c}é 1{c}2, '{c}s" for c in letters] + ["<|EndOfText|> a", "a<|startoftext|>, é", "x" * 200_000]
    draw = random.Random(5)
    odd += ["".join(draw.choice(letters + [" ", ",", ". ", ", ", "é", "É", "'s", "$$$"] * 20) for _ in range(30)) for _ in range(2000)]
    assert mine(odd) == [np.array(e.ids, "<u4").tobytes() for e in theirs.encode_batch(odd, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31, 32])
def test_shards_give_any_range(tmp_path, bits):
    draw = np.random.default_rng(bits)
    ids = draw.integers(0, 1 << bits, 5003, dtype=np.uint64).astype(np.uint32)
    system, path = fs.LocalFileSystem(), str(tmp_path / "shard")
    writer = token_files.ShardWriter(system.open_output_stream(path), bits, 1000)
    for part in (ids[:1234], ids[1234:1234], ids[1234:]):
        writer.add(part)
    writer.close()
    reader = token_files.ShardReader(system.open_input_file(path))
    for _ in range(100):
        a, b = sorted(draw.integers(0, 5004, 2).tolist())
        assert (reader.read(a, b - a) == ids[a:b]).all()
    with pytest.raises(IndexError):
        reader.read(5000, 4)


def test_files_hold_all_documents_in_order(spark):
    rows = [(n * 5 % 37, t) for n, t in enumerate(_texts(37))] + [(100, None), (None, "z"), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS part")
    index = token_files.write_tokens(df.repartition(4), WORDS, new_path(spark, "tokens"), end_id=1, block_ids=64)
    got = sorted((r["start"], r["_key"], r["n"], r["ids"]) for r in token_files.read_tokens(index).collect())
    theirs = Tokenizer.from_file(WORDS)
    keys = [-1 if k is None else k for _, k, _, _ in got]
    assert keys == sorted(keys) and len(got) == len(rows)
    assert [s for s, _, _, _ in got] == [sum(n for _, _, n, _ in got[:i]) for i in range(len(got))]
    found = sorted((-1 if k is None else k, zlib.crc32(i)) for _, k, _, i in got)
    assert found == sorted((-1 if k is None else k, zlib.crc32(np.array(theirs.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for k, t in rows)
    empty = token_files.write_tokens(df.limit(0), WORDS, new_path(spark, "tokens"), end_id=1)
    assert token_files.read_tokens(empty).count() == 0
