"""Token ids in bit-packed binary files.

A shard file holds ids of ``bits`` bits each, the fewest that the vocabulary needs, in blocks:

    magic 8 bytes | block | block | ... | footer: first byte of every block, as u64 |
    trailer: n_ids u64, ids per block u32, bits u32, first byte of the footer u64, magic 8 bytes

All numbers are little-endian; in a block, id i takes the bits from i * bits on, lowest bit first,
and a block ends on a whole byte. So any range of ids is read with one range of bytes, found from
the block offsets, and unpacked with a few numpy operations.

Tasks write shards beside one another, each under a name of its own try, and return the place of
every document; Spark commits these rows as a table. Files of lost tries are named in no row.
Shards are read and written through ``pyarrow.fs``, so the folder may be on any store it knows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from ..session import stage_table
from .bpe import byte_letters

MAGIC = b"QSTOKEN1"
TRAILER = struct.Struct("<QIIQ8s")
BLOCK_IDS = 1 << 16
READ_IDS = 1 << 21  # of one byte range, unless a document has more
BYTES_AT_ONCE = 1 << 20  # of texts whose words are in memory together, unless a text has more
WORDS_AT_ONCE = 2_000  # of one call of the library
CACHED_BYTES = 24 << 20  # of words and their ids per Python worker, some 80 MB as objects


#: Below it no two characters make one, and small letters are the same to all.
_LATIN_END = "\u0250"
_CLOSING = re.compile(rb"([a-z])([.,;:!?]+)(?=\s|\Z)")
#: A mark after a byte beyond ASCII that ends no letter from U+00C0 to U+00FF.
_AFTER_OTHERS = re.compile(rb"(?:(?<!\xc3)[\x80-\xff]|(?<=\xc3)[\x97\xb7])[.,] ")
#: By byte: a letter or digit, white space, a full stop or comma, a part of a character beyond ASCII, anything else.
_KINDS = bytes(ord("u") if b > 127 else ord("a") if chr(b).isalnum() else 32 if b in b" \t\n\r\v\f" else ord(".") if b in b".," else ord("#") for b in range(256))


def bits_for(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first."""
    low = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(low.ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, first: int, n: int, bits: int) -> np.ndarray:
    """``n`` ids from the ``first``-th on, of bytes that start with a whole id."""
    place = np.arange(first, first + n, dtype=np.int64) * bits
    padded = np.frombuffer(raw + bytes(8), dtype=np.uint8)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[place >> 3]
    ids = (words.view("<u8").ravel() >> (place & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)
    return ids.astype(np.uint32)


class ShardWriter:
    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.n, self._at, self._offsets, self._rest = 0, len(MAGIC), [], np.empty(0, np.uint32)
        stream.write(MAGIC)

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.bits)
        self._offsets.append(self._at)
        self.stream.write(raw)
        self._at += len(raw)

    def add(self, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"an id does not fit into {self.bits} bits")
        self.n += len(ids)
        rest = np.concatenate([self._rest, ids])
        whole = len(rest) // self.block_ids * self.block_ids
        for at in range(0, whole, self.block_ids):
            self._block(rest[at : at + self.block_ids])
        self._rest = rest[whole:]

    def close(self) -> None:
        if len(self._rest):
            self._block(self._rest)
        self.stream.write(np.array(self._offsets, dtype="<u8").tobytes())
        self.stream.write(TRAILER.pack(self.n, self.block_ids, self.bits, self._at, MAGIC))
        self.stream.close()


class ShardReader:
    """Random access to the ids of a shard."""

    def __init__(self, file):
        self.file, size = file, file.size()
        raw = file.read_at(TRAILER.size, size - TRAILER.size)
        self.n, self.block_ids, self.bits, self.footer, magic = TRAILER.unpack(raw)
        if magic != MAGIC:
            raise ValueError("no token shard")
        blocks = -(-self.n // self.block_ids)
        self.offsets = np.frombuffer(file.read_at(8 * blocks, self.footer), dtype="<u8") if blocks else np.empty(0, np.uint64)

    def read(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the ``first``-th on."""
        if first < 0 or n < 0 or first + n > self.n:
            raise IndexError("outside the shard")
        parts = [np.empty(0, np.uint32)]
        while n:
            block, inside = divmod(first, self.block_ids)
            take = min(n, self.block_ids - inside)
            group = inside // 8  # every eighth id starts on a whole byte
            begin, end = group * self.bits, -(-(inside + take) * self.bits // 8)
            raw = self.file.read_at(end - begin, int(self.offsets[block]) + begin)
            parts.append(unpack(raw, inside - 8 * group, take, self.bits))
            first, n = first + take, n - take
        return np.concatenate(parts)


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path in it; also for Hadoop's way of writing file:/path."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", folder))


class WordEncoder:
    """Ids by the ``tokenizers`` library, for a tokenizer that lower-cases, drops white space and never looks across it.

    Then a text's ids are those of its words one after the other, so a word met before need not be
    encoded again. Only ASCII white space separates words here; the library sees any other. A run
    of punctuation after an ASCII letter is a word of its own, as it is to the tokenizer. New words
    of Latin letters and ASCII signs are cut into the tokenizer's pieces here, which the library's model gets
    without its other steps, as those change nothing more; the rest go through all of them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self._pieces = regex.compile(made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Added tokens are found before all else, in the text as it is.
        self._added = [t["content"].lower().encode() for t in made["added_tokens"]]
        self._letters = {chr(b): letter for b, letter in byte_letters().items()}
        self.vocabulary_size = max(self._tokenizer.get_vocab().values()) + 1
        self._known: dict[bytes, bytes] = {}
        self._held = 0

    def _learn(self, new: list[bytes]) -> None:
        tokenize, known, letters = self._model.tokenize, self._known, self._letters
        others = []
        for word in new:
            if word.isalpha():
                known[word] = array("I", [t.id for t in tokenize(word.decode())]).tobytes()
                continue
            text = word.decode().lower()
            if max(text) >= _LATIN_END or len(text.split()) != 1:
                others.append(word)
                continue
            # The model has a letter for each byte of UTF-8.
            pieces = ["".join(map(letters.__getitem__, p.encode().decode("latin-1"))) for p in self._pieces.findall(text)]
            known[word] = array("I", [t.id for p in pieces for t in tokenize(p)]).tobytes()
        for at in range(0, len(others), WORDS_AT_ONCE):
            part = others[at : at + WORDS_AT_ONCE]
            known.update((w, array("I", e.ids).tobytes()) for w, e in zip(part, self._encode([w.decode() for w in part])))
        self._held += sum(len(w) + len(known[w]) for w in new)

    def _encode(self, texts: list[str]):
        return self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if self._held > CACHED_BYTES:
            self._known.clear()
            self._held = 0
        low = [(t or "").encode().lower() for t in texts]
        whole = [n for n, t in enumerate(low) if any(a in t for a in self._added)]
        ids = {n: array("I", e.ids).tobytes() for n, e in zip(whole, self._encode([texts[n] for n in whole]))}
        split = [_words(t) if n not in ids else [] for n, t in enumerate(low)]
        self._learn(list(set().union(*split).difference(self._known)))
        known = self._known.__getitem__
        return [ids.get(n) or b"".join(map(known, words)) for n, words in enumerate(split)]


def _words(low: bytes) -> list[bytes]:
    kinds = low.translate(_KINDS)
    if b"#. " in kinds or b".. " in kinds or b"u. " in kinds and _AFTER_OTHERS.search(low):  # more than one mark may end a word
        return _CLOSING.sub(rb"\1 \2", low).split()
    return low.replace(b", ", b" , ").replace(b". ", b" . ").split()


@cache
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def _sliced(batch: pa.RecordBatch):
    """Some rows at a time, ``BYTES_AT_ONCE`` of text together unless a text has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        yield batch.slice(at, end - at)
        at = end


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int, text: str = "text", key: str = "doc_id", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode the texts, each followed by ``end_id``, into shards in ``folder``, in ascending order of the key.

    Returns the index, a staged table with a row per document: _key, part (the shard's number in
    order), shard (its path), first (place of the first id in the shard), n. A NULL text counts as
    empty and is the end id alone. NULL keys come first; equal keys are ordered by a hash of the
    text. Other columns are not looked at; an empty table gives no shards.
    """

    def written(batches):
        encode = load(tokenizer)
        bits = bits_for(max(encode.vocabulary_size, end_id + 1))
        writer, end = None, np.uint32(end_id).tobytes()
        for batch in batches:
            if writer is None:
                system, path = open_folder(folder)
                system.create_dir(path, recursive=True)
                part = TaskContext.get().partitionId()
                path = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.ids"
                writer = ShardWriter(system.open_output_stream(path), bits, block_ids)
                shard = f"{folder}/{path.rpartition('/')[2]}"
            for rows in _sliced(batch):
                ids = [i + end for i in encode(rows.column("_text").to_pylist())]
                sizes = np.array([len(i) // 4 for i in ids], dtype=np.int64)
                firsts = writer.n + np.concatenate([[0], sizes.cumsum()[:-1]])
                writer.add(np.frombuffer(b"".join(ids), dtype="<u4"))
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [rows.column("_key"), pa.array([part] * n, pa.int32()), pa.array([shard] * n), pa.array(firsts), pa.array(sizes)],
                    ["_key", "part", "shard", "first", "n"],
                )
        if writer is not None:
            writer.close()

    chosen = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    order = ["_key", F.xxhash64("_text")]
    kind = chosen.schema["_key"].dataType.simpleString()
    dealt = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage_table(dealt.mapInArrow(written, f"_key {kind}, part int, shard string, first long, n long"))


def read_tokens(index: DataFrame) -> DataFrame:
    """Per document of an index: _key, start (ids of all documents before it), n, ids (little-endian 32-bit), from the shards.

    Documents that lie one after the other are read with one range of bytes.
    """
    # A row per shard.
    shards = index.groupBy("part").agg(F.sum("n").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = stage_table(shards.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("_before")))
    tasks = max(1, shards.count())

    def read(batches):
        name, reader = None, None
        for batch in batches:
            shard, first, n = batch.column("shard").to_pylist(), batch.column("first").to_numpy(), batch.column("n").to_numpy()
            at = 0
            while at < len(shard):
                if shard[at] != name:
                    name = shard[at]
                    system, path = open_folder(name)
                    reader = ShardReader(system.open_input_file(path))
                end, total = at + 1, int(n[at])
                while end < len(shard) and shard[end] == name and first[end] == first[end - 1] + n[end - 1] and total + n[end] <= READ_IDS:
                    total += int(n[end])
                    end += 1
                ids, begin = reader.read(int(first[at]), total), int(first[at])
                rows = [ids[int(first[i]) - begin : int(first[i] + n[i]) - begin].tobytes() for i in range(at, end)]
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), part.column("part"), part.column("first"), part.column("n"), pa.array(rows, pa.binary())],
                    ["_key", "part", "first", "n", "ids"],
                )
                at = end

    kind = index.schema["_key"].dataType.simpleString()
    dealt = index.repartitionByRange(tasks, "part", "first").sortWithinPartitions("part", "first")
    found = dealt.mapInArrow(read, f"_key {kind}, part int, first long, n long, ids binary")
    return found.join(F.broadcast(shards), "part").select("_key", (F.col("first") + F.col("_before")).alias("start"), "n", "ids")
