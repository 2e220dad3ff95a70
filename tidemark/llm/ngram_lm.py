"""Language-model scoring by a weighted backoff automaton over smoothed n-grams.

The model of order n (``ORDER``) is smoothed by pseudo-counts down to add-half unigrams,

    P(w)        = (c(w) + 1/2) / (N + (V + 1) / 2)
    P(w | h)    = (c(h w) + STRENGTH * P(w | h')) / (c(h) + STRENGTH),    h' = h without its first token,

which sums to one over the V known tokens and one unknown; a history that was never seen adds nothing.  As an automaton,
every n-gram of up to n - 1 tokens that was seen in training, the start of a text included, is a state, and the root is
the empty one.  State h has an arc for every w of which h w was seen, of weight log P(w | h), to the longest state that
h w ends with.  Where there is no arc, the failure arc of h leads to the longest shorter state, h', and weighs
log STRENGTH / (c(h) + STRENGTH).  One traversal of a text from left to right carries the state and adds up the weights.

No table of the whole model ever exists in one place.  Texts are tokenised once, into blocks of bounded size that hold
token numbers and the hashes of distinct tokens.  A block sends the keys of its distinct tokens and bigrams, with its own
counts in training texts, to hash buckets; a bucket adds up the counts of all blocks and answers a block with the sums of
those keys that other blocks have too.  Higher orders follow one by one: an n-gram can occur in another block only if both
(n-1)-grams in it do, so only such n-grams are sent, and for all others the block's own counts are the sums.  A row goes only where
there are keys.  Beyond ``HOP`` bits of buckets, rows go through nodes that merge the keys of many blocks, so that a
node writes at most 2 ** HOP rows, whatever the input.  In the end a block builds the part of the automaton that its own
texts can reach and walks it.

Keys are 64-bit hashes, chained from token to token.  They aren't verified: of n distinct n-grams about n / 2**65 share
their key with another, one in four million at 10**13.

Defined cases: a null text counts as empty, has the end token only, and is trained on like any other; a null id counts as
an empty text for the hash that holds documents out; rows with the same id are scored and trained on each by itself;
columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import narrowed, spread, table

ORDER = 3
#: Pseudo-count of the distribution behind each state.
STRENGTH = 64.0
FOLDS, HELD = 5, 1
#: Bytes of text in a block, about, and blocks for each bucket.
BLOCK_BYTES, BUCKET_BLOCKS, LEAST_BITS = 4_000_000, 16, 6
#: Bits of the bucket's number that one hop settles, and askers that one node of a hop merges, about.
HOP, DISTRICT = 10, 1024
#: Tokens that a step of the walk goes through in a row; longer texts are cut there, after a run-up.
SEGMENT = 256
# Hashes of the two tokens that aren't words.
END, START = np.uint64(0x9E6C63D0876A9A47), np.uint64(0x3C79AC492BA7B653)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key, distinct keys), numbered as they first appear; by a hash table, as sorting takes far longer."""
    place, distinct = pd.factorize(keys)
    return place, np.asarray(distinct)


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts keys. Their high bits are sorted together with their places, as values are sorted much faster than places."""
    bits = max(1, len(keys).bit_length())
    mask = np.uint64((1 << bits) - 1)
    order = (np.sort((keys & ~mask) | np.arange(len(keys), dtype=np.uint64)) & mask).astype(np.int64)
    for _ in range(8):  # keys that are equal in their high bits are rare, and then neighbours change places
        bad = np.flatnonzero(keys[order[1:]] < keys[order[:-1]])
        bad = bad[np.diff(bad, prepend=-2) > 1]
        if not len(bad):
            return order
        order[bad], order[bad + 1] = order[bad + 1], order[bad]
    return np.argsort(keys, kind="stable")


# Packed numbers: planes of bytes, as the high ones compress.


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers, compressed; a first byte says how many bytes of each are kept."""
    import zstandard

    raw = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    width = int(np.flatnonzero(raw.any(1))[-1]) + 1 if len(values) and values.any() else 1
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(raw[:width].tobytes())


def _unpack(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw), dtype=np.uint64)


# Blocks.


@dataclass
class Block:
    """Texts as token numbers: ``tokens`` without start and end, ``lengths`` by text, and the tokens' ``hashes``."""

    tokens: np.ndarray
    lengths: np.ndarray
    hashes: np.ndarray
    held_out: np.ndarray

    @classmethod
    def read(cls, texts: pa.Array, held_out: pa.Array) -> Block:
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        found, text = split.flatten(), np.repeat(np.arange(len(texts)), split.value_lengths().to_numpy(zero_copy_only=False))
        some = pc.not_equal(pc.binary_length(found), 0)  # white space at an end gives an empty word
        named = found.filter(some).dictionary_encode()
        tokens = named.indices.to_numpy().astype(np.int64)
        lengths = np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))
        often = np.argsort(-np.bincount(tokens, minlength=len(named.dictionary)), kind="stable")  # frequent tokens get small numbers
        number = np.empty(len(often), np.int64)
        number[often] = np.arange(len(often))
        hashes = pd.util.hash_array(named.dictionary.to_numpy(zero_copy_only=False), categorize=False)
        return cls(number[tokens], lengths, hashes[often], held_out.to_numpy(zero_copy_only=False).astype(bool))

    def row(self) -> dict[str, object]:
        return {"tokens": _pack(self.tokens), "lengths": _pack(self.lengths), "hashes": self.hashes.tobytes(), "held_out": self.held_out.tolist()}

    @classmethod
    def of(cls, group: pa.Table) -> Block:
        """A block's one row."""
        tokens, lengths, hashes, held_out = (group.column(c)[0].as_py() for c in ("tokens", "lengths", "hashes", "held_out"))
        return cls(_unpack(tokens).astype(np.int64), _unpack(lengths).astype(np.int64), np.frombuffer(hashes, np.uint64), np.array(held_out, bool))


@dataclass
class Level:
    """The distinct n-grams of one order in a block.

    ``at``: each place's n-gram, or -1. ``prefix``, ``suffix``, ``last``: an n-gram without its last and first token (of one
    order less), and its last token. ``own``: counts in the block's training texts; ``total``: in all training texts.
    ``asked``: the n-grams that may occur in other blocks, by key; ``shared``: those that do."""

    at: np.ndarray
    keys: np.ndarray
    own: np.ndarray
    prefix: np.ndarray
    suffix: np.ndarray
    last: np.ndarray
    total: np.ndarray = field(init=False)
    shared: np.ndarray = field(init=False)
    asked: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.total, self.shared = self.own.copy(), np.zeros(len(self.keys), bool)
        self.asked = _order(self.keys)


class Grams:
    """The n-grams of a block, order by order. Every text is a stretch of the stream: start, its tokens, end."""

    def __init__(self, block: Block) -> None:
        n, v = len(block.lengths), len(block.hashes)
        self.ends = np.cumsum(block.lengths + 2) - 1
        self.starts = self.ends - block.lengths - 1
        stream = np.full(len(block.tokens) + 2 * n, v, np.int64)
        stream[self.ends] = v + 1
        inside = np.ones(len(stream), bool)
        inside[self.starts] = inside[self.ends] = False
        stream[inside] = block.tokens
        self.stream, self.start_token = stream, v
        self.depth = np.arange(len(stream)) - np.repeat(self.starts, block.lengths + 2)
        self.train = np.repeat(~block.held_out, block.lengths + 2)
        hashes = np.r_[block.hashes, START, END]
        own = np.bincount(stream[self.train], minlength=v + 2)
        none = np.empty(0, np.int64)
        self.levels = [Level(stream.astype(np.int32), hashes, own, none, none, none)]

    def add(self) -> Level:
        """The next order."""
        low, word = self.levels[-1], self.levels[0]
        order, v = len(self.levels) + 1, len(word.keys)
        where = np.flatnonzero(self.depth >= order - 1)
        pair = low.at[where - 1].astype(np.int64) * v + self.stream[where]
        place, distinct = _numbered(pair)
        at = np.full(len(self.stream), -1, np.int32)
        at[where] = place
        prefix, last = distinct // v, distinct % v
        suffix = np.empty(len(distinct), np.int64)
        suffix[place] = low.at[where]
        keys = _mix(low.keys[prefix] * np.uint64(0x9E3779B97F4A7C15) + word.keys[last])
        self.levels.append(Level(at, keys, np.bincount(place[self.train[where]], minlength=len(distinct)), prefix, suffix, last))
        level = self.levels[-1]
        if order > 2:
            level.asked = level.asked[low.shared[level.prefix[level.asked]] & low.shared[level.suffix[level.asked]]]
        return level

    def fill(self, order: int, answers: list[dict]) -> None:
        """Takes the sums of n-grams that other blocks have too."""
        level = self.levels[order - 1]
        keys = level.keys[level.asked]
        for row in answers:
            if row["level"] == order:
                first, _ = _range(keys, row["prefix"], row["bits"])
                at = first + np.cumsum(_unpack(row["places"]).astype(np.int64))
                level.total[level.asked[at]] = _unpack(row["sums"]).astype(np.int64)
                level.shared[level.asked[at]] = True


def _range(keys: np.ndarray, prefix: int, bits: int) -> tuple[int, int]:
    """Where sorted keys begin and end that have ``prefix`` as their first ``bits`` bits."""
    low = np.uint64(prefix << (64 - bits))
    high = (prefix + 1) << (64 - bits)
    return int(np.searchsorted(keys, low)), len(keys) if high >= 1 << 64 else int(np.searchsorted(keys, np.uint64(high)))


# The automaton.


class Automaton:
    """The part of the model that a block's texts can reach; states and arcs are numbered as the block's n-grams are."""

    def __init__(self, levels: list[Level], n: int, v: int, strength: float) -> None:
        p = (levels[0].total + 0.5) / (n + 0.5 * (v + 1))
        self.levels, self.root = levels, np.log10(p)
        self.arcs, self.fails = [self.root], []
        for low, level in zip(levels, levels[1:]):
            context = low.total[level.prefix]
            p = (level.total + strength * p[level.suffix]) / (context + strength)
            self.arcs.append(np.log10(p))
            self.fails.append(np.log10(strength / (low.total + strength)))

    def step(self, where: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads the tokens at places ``where``, each in the state of the ``depth`` tokens before it: (weights, new depths)."""
        order = len(self.levels)
        weight, new = np.zeros(len(where)), np.zeros(len(where), np.int64)
        depth = depth.copy()
        for d in range(order - 1, 0, -1):
            here = np.flatnonzero(depth == d)
            if len(here):
                gram = self.levels[d].at[where[here]]
                has = self.levels[d].total[gram] > 0
                weight[here[has]] += self.arcs[d][gram[has]]
                new[here[has]] = min(d + 1, order - 1)
                depth[here[has]] = -1
                fails = here[~has]
                weight[fails] += self.fails[d - 1][self.levels[d - 1].at[where[fails] - 1]]
                depth[fails] = d - 1
        here = np.flatnonzero(depth == 0)
        token = self.levels[0].at[where[here]]
        weight[here] += self.root[token]
        new[here] = np.minimum(self.levels[0].total[token] > 0, order - 1)
        return weight, new

    def walk(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-probability of each text. ``starts``: where the start tokens are; ``ends``: the end tokens.

        All texts are walked at once, from left to right.  A long text is cut into segments; since a state has order - 1
        tokens at most, a segment that reads as many tokens before its first one, from the root, is in the right state."""
        order = len(self.levels)
        pieces = -(-(ends - starts) // SEGMENT)
        text = np.repeat(np.arange(len(starts)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = starts[text] + 1 + nth * SEGMENT
        stop = np.minimum(first + SEGMENT, ends[text] + 1)
        longest = np.argsort(first - stop, kind="stable")
        text, first, stop = text[longest], first[longest], stop[longest]
        depth = np.zeros(len(text), np.int64)
        for back in range(order - 1, 0, -1):
            ahead = np.flatnonzero(first - back >= starts[text])
            depth[ahead] = self.step(first[ahead] - back, depth[ahead])[1]
        total, live = np.zeros(len(text)), len(text)
        for i in range(int((stop - first).max(initial=0))):
            while live and stop[live - 1] - first[live - 1] <= i:
                live -= 1
            weight, depth[:live] = self.step(first[:live] + i, depth[:live])
            total[:live] += weight
        return np.bincount(text, weights=total, minlength=len(starts))


# Counting over all blocks.

_ASKED = "level int, prefix long, asker long, keys binary, counts binary"
_ASKED_ARROW = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("asker", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_ANSWER = "level int, prefix long, bits int, asker long, places binary, sums binary, n long, v long"
_ANSWER_ARROW = pa.schema([("level", pa.int32()), ("prefix", pa.int64()), ("bits", pa.int32()), ("asker", pa.int64()), ("places", pa.binary()), ("sums", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])


def _by_prefix(level: int, keys: np.ndarray, counts: np.ndarray, asker: int, bits: int) -> Iterator[dict]:
    """A row for each prefix of ``bits`` bits that sorted keys have."""
    prefix = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.r_[np.flatnonzero(np.diff(prefix, prepend=-1)), len(keys)]
    for i, j in zip(edges, edges[1:]):
        yield {"level": level, "prefix": int(prefix[i]), "asker": asker, "keys": _pack_sorted(keys[i:j]), "counts": _pack(counts[i:j])}


@dataclass
class Merged:
    """What several askers ask: all keys, their sums, which of them are shared, and each asker's places among them."""

    askers: list[int]
    keys: np.ndarray
    sums: np.ndarray
    shared: np.ndarray
    places: list[np.ndarray]

    @classmethod
    def of(cls, group: pa.Table, ordered: bool = False) -> Merged:
        parts = [_unpack_sorted(x) for x in group.column("keys").to_pylist()]
        own = np.concatenate([_unpack(x) for x in group.column("counts").to_pylist()]).astype(np.float64)
        place, keys = _numbered(np.concatenate(parts))
        if ordered:
            order = _order(keys)
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            keys, place = keys[order], number[place]
        sums = np.bincount(place, weights=own, minlength=len(keys)).astype(np.int64)
        shared = np.bincount(place, minlength=len(keys)) > 1
        return cls(group.column("asker").to_pylist(), keys, sums, shared, np.split(place, np.cumsum([len(p) for p in parts])[:-1]))

    def replies(self, group: pa.Table, bits: int) -> Iterator[dict]:
        level, prefix = group.column("level")[0].as_py(), group.column("prefix")[0].as_py()
        for asker, place in zip(self.askers, self.places):
            at = np.flatnonzero(self.shared[place])
            if len(at):
                yield {"level": level, "prefix": prefix, "bits": bits, "asker": asker, "places": _pack(np.diff(at, prepend=0)), "sums": _pack(self.sums[place[at]]), "n": None, "v": None}


def _answer(bits: int):
    """The sums of a bucket, and for order 1 what it adds to N and V."""

    def run(group: pa.Table) -> pa.Table:
        merged = Merged.of(group)
        rows = list(merged.replies(group, bits))
        if group.column("level")[0].as_py() == 1:
            token = merged.sums[merged.keys != START]  # the start is a state, not a token
            rows.append({"level": 0, "n": int(token.sum()), "v": int((token > 0).sum())})
        return pa.Table.from_pylist(rows, _ANSWER_ARROW)

    return run


def _up(bits: int):
    """What a node of a hop asks for its askers."""

    def run(group: pa.Table) -> pa.Table:
        merged = Merged.of(group, True)
        return pa.Table.from_pylist(list(_by_prefix(group.column("level")[0].as_py(), merged.keys, merged.sums, group.column("node")[0].as_py(), bits)), _ASKED_ARROW)

    return run


def _down(bits: int):
    """What a node of a hop answers its askers, when it has been answered itself."""

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return _ANSWER_ARROW.empty_table()
        merged = Merged.of(group, True)
        for row in answers.to_pylist():
            first, _ = _range(merged.keys, row["prefix"], row["bits"])
            at = first + np.cumsum(_unpack(row["places"]).astype(np.int64))
            merged.sums[at], merged.shared[at] = _unpack(row["sums"]).astype(np.int64), True
        return pa.Table.from_pylist(list(merged.replies(group, bits)), _ANSWER_ARROW)

    return run


def counted(spark: SparkSession, asked: DataFrame, askers: int, settled: int, bits: int) -> DataFrame:
    """Answers to ``asked``, whose prefixes have ``settled`` bits of the ``bits`` that number the buckets."""
    if settled >= bits:
        return asked.groupBy("level", "prefix").applyInArrow(_answer(settled), _ANSWER)
    districts, further = -(-askers // DISTRICT), min(bits, settled + HOP)
    node = (F.col("prefix") * districts + F.pmod(F.xxhash64("asker"), F.lit(districts))).alias("node")
    asked = table(spark, asked.select("*", node), "asked")
    up = asked.groupBy("level", "node").applyInArrow(_up(further), _ASKED)
    answers = table(spark, counted(spark, up, districts << settled, further, bits), "relayed")
    down = asked.groupBy("level", "node").cogroup(answers.where("level > 0").withColumn("node", F.col("asker")).groupBy("level", "node")).applyInArrow(_down(settled), _ANSWER)
    return down.unionByName(answers.where("level = 0"))


# Documents to blocks to scores.

_BLOCKS = "block long, doc_ids array<long>, held_out array<boolean>, tokens binary, lengths binary, hashes binary"
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("lengths", pa.binary()), ("hashes", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (doc_id, text, held_out), in the order of the rows."""
    held: list[pa.RecordBatch] = []
    size, number = 0, count(TaskContext.get().partitionId() << 32)

    def block() -> pa.RecordBatch:
        ids, texts, held_out = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        held.clear()
        return pa.RecordBatch.from_pylist([{"block": next(number), "doc_ids": ids.to_pylist(), **Block.read(texts, held_out).row()}], _BLOCKS_ARROW)

    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        begin = 0
        while begin < batch.num_rows:
            before = upto[begin - 1] if begin else 0
            end = min(batch.num_rows, int(np.searchsorted(upto, before + BLOCK_BYTES - size)) + 1)
            held.append(batch.slice(begin, end - begin))
            size += int(upto[end - 1] - before)
            begin = end
            if size >= BLOCK_BYTES:
                yield block()
                size = 0
    if held:
        yield block()


def _asked(block: pa.Table, answers: pa.Table | None, orders: tuple[int, ...], bits: int) -> pa.Table:
    """The keys of these orders; counts of lower ones come from ``answers``."""
    grams, rows = _restored(block, answers, orders[0] - 1), []
    for order in orders:
        level = grams.levels[order - 1] if order <= len(grams.levels) else grams.add()
        rows += _by_prefix(order, level.keys[level.asked], level.own[level.asked], block.column("block")[0].as_py(), bits)
    return pa.Table.from_pylist(rows, _ASKED_ARROW)


def _ask(orders: tuple[int, ...], bits: int):
    return lambda block: _asked(block, None, orders, bits)


def _ask_on(orders: tuple[int, ...], bits: int):
    return lambda block, answers: _asked(block, answers, orders, bits)


def _restored(block: pa.Table, answers: pa.Table | None, order: int) -> Grams:
    """A block's n-grams up to an order, with the sums over all blocks."""
    grams = Grams(Block.of(block))
    rows = answers.to_pylist() if answers is not None else []
    for k in range(1, order + 1):
        if k > 1:
            grams.add()
        grams.fill(k, rows)
    return grams


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(order: int, n: int, v: int, strength: float):
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        grams = _restored(block, answers, order)
        model, token = Automaton(grams.levels, n, v, strength), grams.stream != grams.start_token
        text = np.repeat(np.arange(len(grams.starts)), grams.ends - grams.starts + 1)[token]
        token = grams.stream[token]
        add = lambda x: np.bincount(text, weights=x, minlength=len(grams.starts))
        return pa.table({
            "doc_id": block.column("doc_ids").combine_chunks().flatten(), "held_out": block.column("held_out").combine_chunks().flatten(),
            "n_tokens": pa.array(grams.ends - grams.starts, pa.int64()), "n_known": pa.array(add(grams.levels[0].total[token] > 0).astype(np.int64), pa.int64()),
            "train_tokens": pa.array(np.full(len(grams.starts), n), pa.int64()), "base_score": pa.array(add(model.root[token]), pa.float64()),
            "score": pa.array(model.walk(grams.starts, grams.ends), pa.float64()),
        })

    return run


def score(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strength: float = STRENGTH, order: int = ORDER) -> DataFrame:
    """One row per row of ``df``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, both log10."""
    docs = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    docs = spread(docs.withColumn("held_out", F.crc32(key) % FOLDS == HELD))
    blocks = table(spark, docs.mapInArrow(_blocks, _BLOCKS), "blocks")
    n_blocks = blocks.count()
    bits = max(LEAST_BITS, (n_blocks // BUCKET_BLOCKS).bit_length())
    first, answers, n, v = min(bits, HOP), None, 0, 0
    for orders in [tuple(range(1, min(order, 2) + 1)), *((k,) for k in range(3, order + 1))]:
        if answers is None:
            asked = blocks.groupBy("block").applyInArrow(_ask(orders, first), _ASKED)
        else:
            asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_on(orders, first), _ASKED)
        found = table(spark, counted(spark, asked, n_blocks, first, bits), "answers")
        if answers is None:
            n, v = (x or 0 for x in found.where("level = 0").agg(F.sum("n"), F.sum("v")).first())
        own = found.where("level > 0").withColumn("block", F.col("asker"))
        answers = own if answers is None else answers.unionByName(own)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(order, n, v, strength), _SCORES)
