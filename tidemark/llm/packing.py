"""Packing by powers of two: each document is split into pieces of binary lengths, and pieces of one length are a bucket.

A document is its token ids and an end id.  Its length is a sum of powers of two, the longest piece as often as it fits
and then the binary digits of the rest, longest first, so that every piece is a sequence by itself: no sequence holds
tokens of two documents, and none is padded.  A bucket holds the sequences of one length, and a batch is taken from one
bucket.  Sequences are numbered bucket after bucket, the longest first, without gaps; a task numbers its own pieces, and
what the tasks before it hold of a length is added from a table of counts, so no piece is sorted or moved for its number.

Encoding: white space followed by other characters begins a stretch that no token of a byte-level vocabulary crosses on
its left, so stretches are encoded once and remembered.  Texts with the tokenizer's own special strings, or with control
characters that libraries class differently, and all texts of tokenizers of other kinds are encoded whole.

Defined cases: a null text counts as empty; an empty text is the end id alone, one piece of length 1; rows of equal ids
are packed each for itself; a null id stays null; a text of any length is encoded whole, and its pieces leave the task as
batches of a few MB; an empty table gives an empty result; columns other than id and text are not read, whatever their
names.  Sequence numbers follow the partitions the table is read in; the same partitions give the same numbers.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import narrowed, slices, spread, table

#: Tokens of the longest sequence, a power of two, and the id behind each document.
LONGEST, END = 1024, 0
#: Stretches of a text: white space and what follows it, up to the next white space, or to a mark right behind a letter or
#: digit, where a token ends in any case; so a word is one stretch whatever mark follows it.
STRETCH = re.compile(r"\s*+[^\s.,;:!?]++(?:(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])(?=[.,;:!?])|\S*+)|\s*+\S++|\s++")
#: Characters that this pattern takes for white space and the libraries don't.
ODD = re.compile("[\x1c-\x1f]")
#: Remembered stretches of a worker, twice at most, and the longest of them.
REMEMBERED, SHORT = 400_000, 48
#: Token bytes and rows of an outgoing batch.
BATCH_BYTES, BATCH_PIECES = 4 << 20, 20_000
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, part long, place long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, equal to those of the library for whole texts."""

    def __init__(self, definition: str, remembered: int = REMEMBERED) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library, self.remembered = Tokenizer.from_str(definition), remembered
        made = json.loads(definition)
        own, pre = [x["content"] for x in made.get("added_tokens") or []], made.get("pre_tokenizer") or {}
        self.by_stretch = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not made.get("normalizer")
        self.own = re.compile("|".join(map(re.escape, own))) if own else None
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [packed(f"<{len(e)}I", *e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_stretch or ODD.search(text) or (self.own and self.own.search(text)):
            return self._encode([text])[0]
        stretches, known, older = STRETCH.findall(text), self._known, self._older
        new = set(stretches).difference(known)
        unseen = [s for s in new if s not in older]
        known.update((s, older[s]) for s in new if s in older)
        known.update(zip(unseen, self._encode(unseen)))
        ids = b"".join(map(known.__getitem__, stretches))
        for s in unseen:
            if len(s) > SHORT:
                del known[s]
        if len(known) >= self.remembered:
            self._known, self._older = {}, known
        return ids


@lru_cache(maxsize=1)
def encoder(definition: str) -> Encoder:
    """The encoder of a worker, which keeps what it has learnt from task to task."""
    return Encoder(definition)


def lengths(tokens: int, longest: int = LONGEST) -> list[int]:
    """The pieces of a document of so many tokens: whole ones, then the binary digits of the rest, longest first."""
    whole, rest = divmod(tokens, longest)
    return [longest] * whole + [1 << b for b in reversed(range(longest.bit_length() - 1)) if rest >> b & 1]


def pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens; and its task and the place among the task's pieces of its length."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    schema = pa.schema([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, part, places, last = encoder(definition), TaskContext.get().partitionId(), Counter(), np.array([end], "<u4").tobytes()
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

        for arrived in slices(batches):
            for doc_id, text in zip(arrived.column(0).to_pylist(), arrived.column(1)):
                ids, start = codec.encode(text.as_py() or "") + last, 0
                for length in lengths(len(ids) // 4, longest):
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], len(ids) // 4, part, places[length]))
                    places[length] += 1
                    start, held = start + length, held + 4 * length
                    if held >= BATCH_BYTES or len(rows) >= BATCH_PIECES:
                        yield batch()
                        rows, held = [], 0
        yield batch()

    return spread(narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))).mapInArrow(run, SCHEMA)


def numbered(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``found`` (``pieces``, written once here) with sequence_id and offset instead of part and place: each piece is a sequence."""
    found = table(spark, found, "pieces")
    # As many rows as there are tasks and lengths.
    counts = found.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = found.groupBy("length").agg(F.count("*").alias("n"))
    longer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each power of two
    first = counts.select("length", "part", before.alias("before")).join(buckets.select("length", longer.alias("longer")), "length")
    first = table(spark, first.select("length", "part", (F.col("before") + F.col("longer")).alias("first")), "firsts")
    kept = [c for c in found.columns if c not in ("part", "place")]
    return found.join(first, ["length", "part"]).select(*kept, (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def pack(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, end: int = END) -> DataFrame:
    """The sequences with their ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    return numbered(spark, pieces(df, tokenizer_path, id_col, text_col, longest, end))


def digests(spark: SparkSession, df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` with ids_crc32 instead of ids, which are then never written."""
    found = pieces(df, tokenizer_path, id_col, text_col)
    return numbered(spark, found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
