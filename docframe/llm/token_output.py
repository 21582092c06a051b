"""Token ids in ascending doc_id order, in blocks of a canonical length-limited Huffman code.

Texts are tokenized once. The ids go to range buckets of doc_id and are sorted there; the counts of all ids
over all documents make one code; a second pass encodes blocks of whole documents. The file format is a Parquet
table with a row for each block (bucket, uid, documents, their counts, checkpoints, bits) and, in `code`, the
code length of each id. Tables are written by Spark's own writers, so they may lie in any store.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._runtime import doc_id, keyed, discard, materialise, scratch, ship
from ._text import SPACED, Chunk, chunks, raw
from .huffman import Code, code_lengths
from .word_table import WordTable

#: Ids in a block at least, bits of a code at most, words that a worker keeps, ids that it encodes or decodes at once.
BLOCK, LIMIT, CACHE, BATCH = 1 << 15, 18, 1 << 21, 1 << 20


#: Mapping of bytes to characters in byte-level vocabularies: visible ones stand for themselves, the others for
#: those from 256 on, in order.
_VISIBLE = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
_BYTES = {b: b for b in _VISIBLE} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_VISIBLE))}
#: Visible ASCII that is neither letter nor digit.
_MARKS = frozenset(chr(b) for b in range(33, 127) if not chr(b).isalnum())


class WordTokenizer:
    """Ids of whole texts, from those of their words, where no token reaches over ASCII white space.

    Works on tokenizers that normalize by NFC and lower case, split by a pattern and map bytes. The library's model
    encodes each distinct piece of the pattern once; words beyond the Latin blocks, with marks to be composed,
    control characters or special tokens are left to the library's whole pipeline. Other tokenizers encode whole texts.
    """

    def __init__(self, description: str, width: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.width, self.code = Tokenizer.from_str(description), width, {"<u2": "H", "<u4": "I"}[width]
        self.known, self.pieces = WordTable(width, CACHE), {}
        self.pattern = self._pattern(json.loads(description))
        if self.pattern:
            self.pattern = regex.compile(self.pattern)

    @staticmethod
    def _pattern(d: dict) -> str | None:
        normalizers = [(n["type"], n.get("content")) for n in (d["normalizer"] or {}).get("normalizers", [])]
        split = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        fits = (
            normalizers == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and [p["type"] for p in split] == ["Split", "ByteLevel"]
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and not split[1]["add_prefix_space"]
            and not split[1]["use_regex"]
            and all(t["content"].startswith("<|") for t in d["added_tokens"])
        )
        return split[0]["pattern"]["Regex"] if fits else None

    def _piece(self, piece: str) -> bytes:
        ids = array(self.code, [t.id for t in self.tokenizer.model.tokenize(piece)]).tobytes()
        self.pieces[piece] = ids
        return ids

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; words that are decoded, lowered and cut in the same way are so together."""
        all_ = b" ".join(words).decode("utf-8", "replace")  # a word has no space
        hard = []
        if not _LATIN(all_) or "<|" in all_ or not unicodedata.is_normalized("NFC", all_):
            own = all_.split(" ")
            hard = [i for i, w in enumerate(own) if not _LATIN(w) or "<|" in w or not unicodedata.is_normalized("NFC", w)]
            for i in hard:
                own[i] = ""
            all_ = " ".join(own)
        known, new, cut, out = self.pieces.get, self._piece, self.pattern.findall, []
        for w in all_.lower().split(" "):
            if w.isalpha():
                if not w.isascii():
                    w = w.encode().decode("latin-1").translate(_BYTES)
                out.append(known(w) or new(w))
            elif w[-1:] in _MARKS and w[:-1].isalpha() and w.isascii():
                out.append((known(w[:-1]) or new(w[:-1])) + (known(w[-1]) or new(w[-1])))
            else:
                found = cut(w) if w.isascii() else [p.encode().decode("latin-1").translate(_BYTES) for p in cut(w)]
                out.append(b"".join([known(p) or new(p) for p in found]))
        if hard:
            for i, ids in zip(hard, self._whole([words[i] for i in hard])):
                out[i] = ids
        return out

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.width).tobytes() for e in got]

    def batch(self, c: Chunk) -> list[bytes]:
        """The ids of each text of the chunk as an array of width."""
        if not self.pattern:
            return self._whole(c.texts)
        c.words(SPACED)
        if len(self.pieces) > CACHE // 8:
            self.pieces = {}
        ids, end = self.known.look_up(c, lambda words: self._words(words) if words else [])
        return [ids[a:z].tobytes() for a, z in zip(end[c.lo].tolist(), end[c.hi].tolist())]


#: Of words, or of words with spaces between them.
_LATIN = re.compile("[ -~\u00a0-\u024f]*").fullmatch

_tokenizers: dict[int, WordTokenizer] = {}


def _tokenize(description, width: str, end: int):
    tail = np.array([end], width).tobytes()

    def run(batches):
        key = hash(description.value)
        if key not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[key] = WordTokenizer(description.value, width)
        t = _tokenizers[key]
        for b in batches:
            for i, j, c in chunks(raw(b.column("text"))):
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("th").slice(i, j - i), pa.array([x + tail for x in t.batch(c)], pa.binary())], ["id", "th", "ids"])

    return run


def constant(bounds: list[int]) -> Column:
    """The bounds as a constant array."""
    return F.from_json(F.lit(json.dumps(bounds)), "array<bigint>")


def bucket_of(column: Column, bounds: list[int]) -> Column:
    """The number of bounds below the value, by halving."""
    if not bounds:
        return F.lit(0)
    steps = F.lit([1 << k for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda below, step: F.when(F.get(constant(bounds), below + step - 1) < column, below + step).otherwise(below))


def id_bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the documents into about equal ranges of ids; each is an id that occurs."""
    if buckets < 2:
        return []
    cut = docs.agg(F.percentile_approx("id", F.lit([i / buckets for i in range(1, buckets)]), F.lit(min(10 * buckets, 200_000)))).first()[0]
    return sorted(set(cut or ()))


@dataclass
class TokenFiles:
    """Where the blocks and the code's lengths are."""

    path: str
    limit: int = LIMIT

    def code(self, spark: SparkSession) -> Code:
        rows = spark.read.parquet(f"{self.path}/code").collect()  # a row for each id of the vocabulary that occurs
        lengths = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.uint8)
        for r in rows:
            lengths[r["token"]] = r["bits"]
        return Code(lengths, self.limit)


def write_tokens(docs: DataFrame, tokenizer: str, end: int, path: str) -> TokenFiles:
    """Encode doc_id and text of docs with the tokenizer file, `end` behind each document; write blocks to path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer, encoding="utf-8") as f:
        description = f.read()
    vocabulary = Tokenizer.from_str(description).get_vocab_size()
    width = "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"
    buckets = min(10_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = keyed(docs)
    bounds = id_bounds(docs.select("id"), buckets)
    ids = docs.mapInArrow(_tokenize(spark.sparkContext.broadcast(description), width, end), "id long, th long, ids binary")
    ids = ids.withColumn("bucket", bucket_of(F.col("id"), bounds)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "id", "th")
    ids = materialise(ids)

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), width))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["token", "n"])

    rows = ids.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["token"]] = r["n"]
    lengths = code_lengths(counts, LIMIT)
    spark.createDataFrame([(int(t), int(lengths[t])) for t in np.flatnonzero(lengths)], "token long, bits int").coalesce(1).write.parquet(f"{path}/code")
    held = spark.sparkContext.broadcast(lengths)

    def encode(batches):
        code = Code(held.value, LIMIT)
        pending: list[tuple[int, int, int, bytes]] = []

        def block() -> pa.RecordBatch:
            stream = np.frombuffer(b"".join(p[3] for p in pending), width)
            bits, offsets = code.encode(stream)
            uid = int.from_bytes(os.urandom(8), "little", signed=True)
            row = {"bucket": pending[0][0], "uid": uid, "ids": [p[1] for p in pending], "ths": [p[2] for p in pending], "counts": [len(p[3]) // int(width[2]) for p in pending], "n": len(stream), "offsets": offsets.tolist(), "bits": bits}
            return pa.RecordBatch.from_pylist([row], pa.schema([("bucket", pa.int32()), ("uid", pa.int64()), ("ids", pa.list_(pa.int64())), ("ths", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n", pa.int64()), ("offsets", pa.list_(pa.int64())), ("bits", pa.binary())]))

        n = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("bucket", "id", "th", "ids"))):
                if pending and (n >= BLOCK * int(width[2]) or row[0] != pending[0][0]):
                    yield block()
                    pending, n = [], 0
                pending.append(row)
                n += len(row[3])
        if pending:
            yield block()

    schema = "bucket int, uid long, ids array<long>, ths array<long>, counts array<long>, n long, offsets array<long>, bits binary"
    ids.select("bucket", "id", "th", "ids").mapInArrow(encode, schema).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(ids)
    return TokenFiles(path)


def read_tokens(spark: SparkSession, files: TokenFiles, each: Callable[[np.ndarray], list], schema: str, kinds: list) -> DataFrame:
    """Decode the blocks: id, th, uid, place (ids of the block before the document), n, and each(ids) as the columns of schema."""
    ship(spark)
    code_ = spark.sparkContext.broadcast((files.code(spark).lengths, files.limit))
    names = ["id", "th", "uid", "place", "n", *(c.split()[0] for c in schema.split(", "))]

    def decode(batches):
        code = Code(*code_.value)
        for b in batches:
            sizes = b.column("n").to_pylist()
            first = 0
            while first < len(sizes):
                last, total = first, 0
                while last < len(sizes) and (last == first or total + sizes[last] <= BATCH):
                    total += sizes[last]
                    last += 1
                part = b.slice(first, last - first)
                stream = code.decode(part.column("bits").to_pylist(), [np.array(o, np.int64) for o in part.column("offsets").to_pylist()], sizes[first:last])
                rows, at = [], 0
                for uid, ids, ths, counts in zip(*(part.column(c).to_pylist() for c in ("uid", "ids", "ths", "counts"))):
                    place = 0
                    for i, th, n in zip(ids, ths, counts):
                        rows.append((i, th, uid, place, n, *each(stream[at : at + n])))
                        at, place = at + n, place + n
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + kinds)], names)
                first = last

    blocks = spark.read.parquet(f"{files.path}/blocks")
    return blocks.select("uid", "ids", "ths", "counts", "n", "offsets", "bits").mapInArrow(decode, "id long, th long, uid long, place long, n long, " + schema)


def starts(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """(uid, start): the ids of all blocks before each block."""
    from pyspark.sql import Window

    slim = spark.read.parquet(f"{files.path}/blocks").select("bucket", "uid", "n", F.col("ids")[0].alias("id"), F.col("ths")[0].alias("th"))
    slim = slim.withColumn("inside", F.sum("n").over(Window.partitionBy("bucket").orderBy("id", "th", "uid")) - F.col("n"))
    totals = slim.groupBy("bucket").agg(F.sum("n").alias("total"))  # a row for each bucket, 10,000 at most
    totals = totals.withColumn("before", F.sum("total").over(Window.orderBy("bucket")) - F.col("total"))
    return slim.join(totals.select("bucket", "before"), "bucket").select("uid", (F.col("before") + F.col("inside")).alias("start"))


def token_output(docs: DataFrame, tokenizer: str, end: int = 2, path: str | None = None) -> DataFrame:
    """Write the ids of all documents, read them back, and tell where each document lies.

    Takes doc_id and text (null: empty), returns doc_id, start (ids of all documents before it, by doc_id and
    then by a hash of the text), n_tokens (with `end`), ids_crc32 (of the ids as little-endian unsigned 32-bit
    integers). A null doc_id comes first and stays null; rows with equal ids and texts follow each other;
    an empty table gives an empty result. path: a new folder for the files; by default one in the shared folder.
    """
    spark = docs.sparkSession
    files = write_tokens(docs, tokenizer, end, path or scratch(spark))
    crc = lambda ids: [zlib.crc32(ids.astype("<u4").tobytes())]
    rows = read_tokens(spark, files, crc, "crc long", [pa.int64()])
    return rows.join(starts(spark, files), "uid").select(doc_id(), (F.col("start") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
