"""Importance resampling towards a target distribution by a dictionary of distinct n-gram strings.

The features of a text are its runs of one to ``ORDER`` words.  Documents become blocks of word numbers, written once.  A
block sends each of its distinct features, as a string with its count, to the part of the dictionary that the string
belongs to; there equal strings of all blocks meet, are counted, and each distinct one is hashed once to its bucket.  Counts
of buckets are summed over all parts, for the raw and for the target texts, and give each bucket's gain.  The dictionary
answers each block's list with a list of buckets in the same order; joined with its block it turns the counts of features
of each document into its weight.  Gumbel noise from a hash of the id makes drawing the highest scores a sample without
replacement in proportion to the weights.

Features travel as lists, one for each block and part, compressed in sorted order: a few bytes a feature instead of a row.
A part has some two million features whatever the size of the table, a block a million words at most; longer texts are
continued in the next block.  A frequent feature comes once from each block.  Only the gains, a number for each bucket, are
sent to all tasks.  Beyond some 30 GB of documents the lists get shorter than a few hundred features, and at their
shortest they cost what rows of single features cost.

Defined cases: a null or empty text has no features and weight 0, and so has one without words; rows of one id are scored
each for itself and tie, the earlier row first; a null id has the noise of an empty name and loses ties; texts of any
length are read whole; an empty table gives an empty result, an empty target table gives gains from counts of zero; columns
other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import prefixed
from .scratch import narrowed, slices, spread, table

#: Words of the longest feature, and buckets.
ORDER, BUCKETS = 3, 10_000
#: Words that a document needs to be drawn, and the share that is drawn, in percent.
MIN_WORDS, PERCENT = 20, 5
SALT = "42:"
#: Turns in which features are sent to the dictionary, and the compression of words.
TURNS, LEVEL = 2, 6
#: Words of a block at most; their numbers from 1 on need so many bits.
BLOCK_WORDS, BITS = 1 << 20, 21
#: Features that a part of the dictionary receives, about.
PART_FEATURES = 1 << 21
#: Features that are hashed at once, so that what is made of them stays in a core's cache.
HASHED = 1 << 15
#: Bytes that aren't part of a word, as spaces, and A-Z as a-z; all bytes of other characters are 0x80 or more.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
BLOCK_SCHEMA = "block long, n_words long, rows array<long>, ids array<long>, starts array<int>, stored array<int>, vocabulary binary, words binary"


def packed(values: np.ndarray | bytes, level: int = 1) -> bytes:
    """Compressed; numbers byte by byte, as their high bytes are alike."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", level).compress(raw, asbytes=True)


def unpacked(found: bytes, kind: type | None = None) -> np.ndarray | bytes:
    raw = pa.decompress(found[8:], int.from_bytes(found[:8], "little"), codec="zstd", asbytes=True)
    if kind is None:
        return raw
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents, or stretches of long ones, as numbers of the words of a block.  A stretch also stores the words in which its last features end."""
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
    lists = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0
        numbers: dict[bytes, int] = defaultdict(lambda: len(numbers) + 1)

        def close() -> pa.RecordBatch:
            rows, ids, starts, stored, found = zip(*held)
            columns = [pa.array([list(c)], t) for c, t in zip((rows, ids, starts, stored), lists)]
            blobs = [pa.array([packed(b"\n".join(numbers), LEVEL)], pa.binary()), pa.array([packed(np.concatenate(found), LEVEL)], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sum(starts)]), *columns, *blobs], names)

        for arrived in slices(batches):
            for row, doc_id, text in zip(arrived.column(0).to_pylist(), arrived.column(1).to_pylist(), arrived.column(2)):
                own = words(text.as_py())
                for at in range(0, max(1, len(own)), BLOCK_WORDS // 2):
                    part = own[at : at + BLOCK_WORDS // 2 + ORDER - 1]
                    if held and (size + len(part) > BLOCK_WORDS or len(held) >= BLOCK_WORDS // 8):
                        yield close()
                        block, size = block + 1, 0
                        held.clear(), numbers.clear()
                    held.append((row, doc_id, min(len(own) - at, BLOCK_WORDS // 2), len(part), np.fromiter((numbers[w] for w in part), np.uint32, len(part))))
                    size += len(part)
        if held:
            yield close()

    docs = spread(narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return docs.mapInArrow(run, BLOCK_SCHEMA)


def codes(numbers: np.ndarray, starts: np.ndarray, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a block as ORDER numbers in one, 0 for no word, and the stretch of each."""
    w, stretch, at = numbers.astype(np.int64), np.repeat(np.arange(len(stored)), stored), np.arange(len(numbers))
    ends = np.cumsum(stored)
    begins, upto = at < np.repeat(ends - stored + starts, stored), np.repeat(ends, stored)
    code, found, of = w << (BITS * (ORDER - 1)), [], []
    for more in range(ORDER):
        if more:
            shifted = np.zeros_like(w)
            shifted[:-more] = w[more:]
            code = code | shifted << (BITS * (ORDER - 1 - more))
        whole = begins & (at + more < upto)
        found.append(code[whole])
        of.append(stretch[whole])
    return np.concatenate(found), np.concatenate(of)


def _places(distinct: np.ndarray) -> list[np.ndarray]:
    """The word numbers of features, place by place."""
    return [(distinct >> (BITS * (ORDER - 1 - i))) & ((1 << BITS) - 1) for i in range(ORDER)]


def parted(distinct: np.ndarray, vocabulary: list[bytes], parts: int) -> np.ndarray:
    """The part of each feature. All words but the third decide on it, so that neighbours in a list share their beginning."""
    own = np.array([0, *map(zlib.crc32, vocabulary)], np.uint64)
    mixed = np.zeros(len(distinct), np.uint64)
    for numbers in _places(distinct)[:2]:
        mixed = (mixed ^ own[numbers]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def routed(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of features by part and, within a part, as they were; and where each part ends."""
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=parts))


def _vocabulary(found: bytes) -> list[bytes]:
    raw = unpacked(found)
    return raw.split(b"\n") if raw else []


def shortened(distinct: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words each feature has, and how many of them it shares with the one before it in its list."""
    places = _places(distinct)
    size = sum((p > 0).astype(np.int8) for p in places)
    same, shared = np.ones(len(distinct), bool), np.zeros(len(distinct), np.int8)
    same[begins] = False
    for p in places[:-1]:
        same[1:] &= (p[1:] == p[:-1]) & (p[1:] > 0)
        shared += same
    return size, shared


def asked(found: DataFrame, parts: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """(part, block, shape, words, counts): what each block asks each part of the dictionary, in one of several turns.

    ``shape`` has a byte for each feature, its number of words and how many of them stand in the feature before it; ``words`` has the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            vocabulary = _vocabulary(row["vocabulary"])
            distinct, counts = np.unique(codes(unpacked(row["words"], np.uint32), np.array(row["starts"]), np.array(row["stored"]))[0], return_counts=True)
            part = parted(distinct, vocabulary, parts)
            if turns > 1:
                now = part % turns == turn
                distinct, counts, part = distinct[now], counts[now], part[now]
            order, ends = routed(part, parts)
            distinct, counts, firsts = distinct[order], counts[order].astype(np.uint32), np.r_[0, ends[:-1]]
            size, shared = shortened(distinct, firsts[firsts < len(distinct)])
            own, places = pa.array([None, *[w + b"\n" for w in vocabulary]], pa.binary()), np.stack(_places(distinct), 1)
            sent = (np.arange(ORDER) >= shared[:, None]) & (np.arange(ORDER) < size[:, None])
            upto, listed = np.r_[0, np.cumsum(sent.sum(1))], own.take(pa.array(places[sent]))
            offsets, data = np.frombuffer(listed.buffers()[1], np.int32), listed.buffers()[2]
            for part, (i, j) in enumerate(zip(firsts, ends)):
                if i < j:
                    text = data[offsets[upto[i]] : offsets[upto[j]] - 1].to_pybytes()
                    blobs = [packed((size * 4 + shared)[i:j].astype(np.uint8)), packed(text, LEVEL), packed(counts[i:j])]
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([row["block"]]), *[pa.array([b], pa.binary()) for b in blobs]], ["part", "block", "shape", "words", "counts"])

    return found.select("block", "starts", "stored", "vocabulary", "words").mapInArrow(run, "part int, block long, shape binary, words binary, counts binary")


def features(shape: np.ndarray, numbers: np.ndarray, none: int) -> list[np.ndarray]:
    """The words of a list of features, place by place, from what each adds to the one before it; ``none`` stands for no word."""
    size, shared = (shape // 4).astype(np.int64), (shape % 4).astype(np.int64)
    first, found = np.cumsum(size - shared) - (size - shared), []
    for i in range(ORDER):
        # Where a feature has no word of its own here, the last one that had stands for it.
        at = np.maximum.accumulate(np.where((i >= shared) & (i < size), first + i - shared, 0))
        found.append(np.where(i < size, numbers[at], none))
    return found


def joined(places: list[np.ndarray], words_: pa.Array) -> pa.Array:
    """Features as strings, one space between words; the number behind the last word stands for no word."""
    spaced = pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), words_, pa.scalar(b"", pa.binary()))
    none = pa.array([b""], pa.binary())
    tables = [pa.concat_arrays([words_, none]), *[pa.concat_arrays([spaced, none])] * (ORDER - 1)]
    return pc.binary_join_element_wise(*[t.take(pa.array(p)) for t, p in zip(tables, places)], pa.scalar(b"", pa.binary()))


def _followed(crc: np.ndarray, tables: np.ndarray, which: np.ndarray | int = 0) -> np.ndarray:
    """CRC-32 values after as many zero bytes as the tables that stand for them say."""
    flat, at = tables.ravel(), which << 10
    out = flat.take(at + (crc & 255))
    for i in range(1, 4):
        out ^= flat.take(at + (256 * i) + (crc >> np.uint32(8 * i) & 255))
    return out


def following(lengths: np.ndarray) -> np.ndarray:
    """For each length four tables of 256: what each byte of a CRC-32 becomes when so many zero bytes follow."""
    byte = np.empty(256, np.uint32)
    for b in range(256):
        byte[b ^ 255] = zlib.crc32(bytes([b])) ^ 0xFF000000
    alone = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    power = byte[alone & 255] ^ alone >> np.uint32(8)
    # Bit by bit first; a byte's value is the sum of those of its bits.
    bits = np.repeat(np.uint32(1) << np.arange(32, dtype=np.uint32)[None], len(lengths), 0)
    for bit in range(int(max(lengths, default=0)).bit_length()):
        now = (lengths >> bit & 1) > 0
        bits[now], power = _followed(bits[now], power), _followed(power, power)
    bits, found = bits.reshape(-1, 4, 8), np.zeros((len(lengths), 4, 256), np.uint32)
    for i in range(8):
        found[:, :, 1 << i : 2 << i] = found[:, :, : 1 << i] ^ bits[:, :, i : i + 1]
    return found


def hashes(places: list[np.ndarray], known: pa.Array) -> np.ndarray:
    """The CRC-32 of each feature as a string, from those of its words and of a space and a word; the number behind the last word stands for no word."""
    listed, none, space = known.to_pylist(), len(known), zlib.crc32(b" ")
    own = np.fromiter(map(zlib.crc32, listed), np.uint32, none)
    spaced = np.fromiter((zlib.crc32(w, space) for w in listed), np.uint32, none)
    lengths, kind = np.unique(np.fromiter(map(len, listed), np.int64, none) + 1, return_inverse=True)
    tables, found = following(lengths), np.empty(len(places[0]), np.uint32)
    for at in range(0, len(found), HASHED):
        here = own[places[0][at : at + HASHED]]
        for p in places[1:]:
            more = np.flatnonzero((words_ := p[at : at + HASHED]) < none)
            w = words_[more]
            here[more] = _followed(here[more], tables, kind[w]) ^ spaced[w]
        found[at : at + HASHED] = here
    return found


def dictionary(questions: DataFrame) -> DataFrame:
    """(block, part, buckets, sums): for each list its features' buckets, and once for each part, with a null block, counts by bucket."""

    def run(group: pa.Table) -> pa.Table:
        shapes = [unpacked(s, np.uint8) for s in group["shape"].to_pylist()]
        words_ = pc.list_flatten(pc.split_pattern(pa.array([b"\n".join(unpacked(w) for w in group["words"].to_pylist())], pa.binary()), b"\n")).dictionary_encode()
        numbers, known = words_.indices.to_numpy().astype(np.int64), words_.dictionary
        none, bits = len(known), (len(known) + 1).bit_length()
        at, lists = 0, []
        for shape in shapes:
            own = int((shape // 4).sum() - (shape % 4).sum(dtype=np.int64))
            lists.append(features(shape, numbers[at : at + own], none))
            at += own
        places = [np.concatenate(p) for p in zip(*lists)]
        if bits * ORDER <= 63:
            of, distinct = pd.factorize(sum(p << (bits * i) for i, p in enumerate(places)))
            places = [(distinct >> (bits * i)) & ((1 << bits) - 1) for i in range(ORDER)]
            crc = hashes(places, known)
        else:
            whole = joined(places, known).dictionary_encode()
            of, strings = whole.indices.to_numpy(), whole.dictionary
            crc = np.fromiter(map(zlib.crc32, strings.to_pylist()), np.uint32, len(strings))
        bucket = (crc % BUCKETS).astype(np.uint16)
        counts = np.concatenate([unpacked(c, np.uint32) for c in group["counts"].to_pylist()])
        # Counts as floating-point numbers are whole and exact below 2 ** 53.
        sums = np.bincount(bucket[of], weights=counts, minlength=BUCKETS).astype(np.int64)
        ends = np.cumsum([len(x) for x in shapes])
        answers = [packed(bucket[of[i:j]]) for i, j in zip([0, *ends[:-1]], ends)]
        n = len(answers) + 1
        return pa.table({
            "block": pa.array([*group["block"].to_pylist(), None], pa.int64()), "part": pa.array([group["part"][0].as_py()] * n, pa.int32()),
            "buckets": pa.array([*answers, None], pa.binary()), "sums": pa.array([None] * (n - 1) + [sums.tolist()], pa.list_(pa.int64())),
        })

    return questions.groupBy("part").applyInArrow(run, "block long, part int, buckets binary, sums array<long>")


def counted(spark: SparkSession, df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """The blocks of ``df``, the dictionary's answers to them, and the number of its parts."""
    found = table(spark, blocks(df, id_col, text_col), "blocks")
    total = ORDER * (found.agg(F.sum("n_words")).first()[0] or 0)
    parts = max(1, -(-total // PART_FEATURES), min(spark.sparkContext.defaultParallelism, total >> 16))
    # In turns, so that lists of one turn only are on the way at a time.
    turns = [table(spark, dictionary(asked(found, parts, turn, TURNS)), "buckets") for turn in range(TURNS)]
    answers = turns[0]
    for more in turns[1:]:
        answers = answers.union(more)
    return found, answers, parts


def bucket_counts(answers: DataFrame) -> DataFrame:
    """(bucket, n) for each bucket that has features."""
    rows = answers.where("block IS NULL").select(F.posexplode("sums").alias("bucket", "n"))
    return rows.where("n > 0").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of every bucket, 1000 times the logarithm of the smoothed ratio of its shares, rounded down; at most BUCKETS rows come to the driver."""
    found = {False: np.zeros(BUCKETS), True: np.zeros(BUCKETS)}
    both = raw.select("bucket", "n", F.lit(False).alias("t")).union(target.select("bucket", "n", F.lit(True).alias("t")))
    for bucket, n, is_target in both.collect():
        found[is_target][bucket] = n
    s, t = found[False], found[True]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weights(found: DataFrame, answers: DataFrame, parts: int, gain: np.ndarray) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) for every document of the blocks, by the answers that are joined to them."""

    def run(block: pa.Table, lists: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        vocabulary, starts, stored = _vocabulary(row["vocabulary"]), np.array(row["starts"]), np.array(row["stored"])
        code, stretch = codes(unpacked(row["words"], np.uint32), starts, stored)
        # As ``asked`` has them: by part, and then by their numbers.
        by_number = np.argsort(code)
        sorted_ = code[by_number]
        first = np.ones(len(code), bool)
        first[1:] = sorted_[1:] != sorted_[:-1]
        distinct, of = sorted_[first], np.empty(len(code), np.int64)
        of[by_number] = np.cumsum(first) - 1
        order, ends = routed(parted(distinct, vocabulary, parts), parts)
        own = np.zeros(len(distinct), np.int64)
        for part, answer in zip(lists["part"].to_pylist(), lists["buckets"].to_pylist()):
            own[order[ends[part - 1] if part else 0 : ends[part]]] = gain[unpacked(answer, np.uint16)]
        weight = np.bincount(stretch, weights=own[of], minlength=len(starts)).astype(np.int64)
        return pa.table({"row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(starts, pa.int64()), "n_features": pa.array(np.bincount(stretch, minlength=len(starts)), pa.int64()), "weight": weight})

    blocks_ = found.select("block", "rows", "ids", "starts", "stored", "vocabulary", "words")
    schema = "row long, doc_id long, n_words long, n_features long, weight long"
    parted_ = blocks_.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("block", "part", "buckets").groupBy("block")).applyInArrow(run, schema)
    # Long texts lie in several blocks.
    return parted_.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def noise(key: Column, salt: str = SALT) -> Column:
    """Gumbel noise of a row from the first 32 bits of a hash of its id, 1000 times and rounded down."""
    name = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(spark: SparkSession, df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each row of ``df``: doc_id, n_words, n_features, weight, score, and rank for the rows that are drawn."""
    found, answers, parts = counted(spark, df, id_col, text_col)
    gain = gains(bucket_counts(answers), bucket_counts(counted(spark, target, target_id, target_text)[1]))
    scored = weights(found, answers, parts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    scored = table(spark, scored, "scored")
    drawn = percent * scored.where(F.col("n_words") >= min_words).count() // 100
    # Ranks of all that may be drawn by counts of ranges of scores, so that no task sorts more than a range.
    able = scored.where(F.col("n_words") >= min_words).select("row", (-F.col("score")).alias("down"), F.col("doc_id").isNull().alias("last"), "doc_id")
    ranked = prefixed(spark, able, ["down", "last", "doc_id", "row"], {"before": F.lit(1)}).where(F.col("before") < drawn)
    ranks = table(spark, ranked.select("row", (F.col("before") + 1).cast("long").alias("rank")), "ranks")
    return scored.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
