"""MinHash near-deduplication by a signature-coordinate inverted join.

Documents with equal shingle sets form one class.  A class has a signature of ``WIDE`` coordinates, of which the first
``COORDS`` are posted under their coordinate-value pair.  A pair of classes can collide in ``MATCH`` coordinates only if
it shares one of the ``m - MATCH + 1`` rarest of a class's ``m`` pairs that occur twice at all (prefix merging); the
frequent pairs behind the prefix are never merged, they are counted on the signatures themselves (skip merging).

Within a posting list all classes are compared to the list's least class first; pairs that collide often enough on their
whole signatures are confirmed on the full shingle sets, and confirmed links are joined to components.  Classes connected
by shared lists form a candidate group; a link can't leave it.  Groups that hold several components are searched for
collisions across components, signature by signature, in strips: what comes back are the classes that collide at all and
a spanning forest of their collisions, which is confirmed next.  Classes that collided post the rarest of their shingles,
as many as a set at the bound can lack of another; those that share none have nothing to be compared with and drop out.
The others meet in strips bounded in bytes, and of those that collide across components and share a posted shingle the
sets are compared; each pair of strips returns a spanning forest of its links.  So copies cost as many rows as there are
copies, shingles of a template are never posted, and no link between components is lost.  Every link is confirmed on the
full shingle sets.

A group has up to ``STRIPS`` strips until they reach their bound, so that its rows are moved STRIPS times at most,
whatever its size; beyond that the number of strips follows its size.  Within a group signatures of different components
are compared pair by pair, about 256 bytes each.

A pair at the similarity bound 0.85 collides in fewer than 16 of 32 coordinates with probability 1e-6, and in fewer than
88 of 128 with 1e-6; closer pairs far less often.

Defined cases: a text without words, or null, has an empty set, links with nothing and is its own component; with fewer
than five words the whole sequence is one shingle; rows with the same id share one result; rows with a null id link with
nothing and have a null component; columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import narrowed, released, slices, spread, table

SHINGLE, COORDS, MATCH, WIDE, WIDE_MATCH = 5, 32, 16, 128, 88
#: Classes that one strip of a group holds at least, if there are so many; strips of a group at first; bounds of a strip.
BLOCK, STRIPS, STRIP_ROWS, STRIP_BYTES = 512, 8, 8192, 8 << 20
#: Shingles from which on a signature is made coordinate by coordinate.
LARGE = 8192
#: Bytes of sets that are compared to one copy of another set, about.
CHUNK_BYTES = 4 << 20
#: Bits of the filter with which texts are picked before they are moved; it is broadcast, 2 MB at most.
FILTER_BITS = 24
#: Links are pairs with PERCENT or more of 100 * intersection / union.
PERCENT = 85


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; words are of bytes, so only ASCII is lower-cased or splits."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    rolled = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for i in range(min(width, len(h))):
        rolled = _mix(rolled + h[i : i + n])
    return np.unique(rolled)


_SEEDS = _mix(np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def signature(s: np.ndarray) -> np.ndarray:
    """WIDE coordinates of 32 bits: the least values of a set under as many multiplicative hashes."""
    base = _mix(s)
    if len(s) >= LARGE:
        least = np.array([(base * seed).min() for seed in _SEEDS])
    else:  # all coordinates of some shingles at once, as a call for each coordinate takes longer than its work
        least = np.min([(base[at : at + 256, None] * _SEEDS).min(0) for at in range(0, len(base), 256)], axis=0)
    return (least >> np.uint64(32)).astype(np.uint32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        ids, n, keys, coords, wide = batch.column(0), [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            n.append(len(s))
            if len(s):
                sig = signature(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                coords.append(sig[:COORDS].astype(np.int64))
                wide.append(sig.astype(np.uint16).tobytes())
            else:
                keys.append(None)
                coords.append(None)
                wide.append(None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(coords, pa.list_(pa.int64())), pa.array(wide, pa.binary())], ["doc_id", "n_shingles", "set_key", "coords", "wide"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["rep", "shingles"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, shingles) sorted by a, where b is null in the row of a's own set: the pairs whose sets are similar enough."""
    own = np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for b, raw in zip(batch.column(1), batch.column(2)):
            other = np.frombuffer(raw.as_buffer(), np.uint64)
            if not b.is_valid:
                own = other.copy()
            keep.append(b.is_valid and _similar(own, other))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (a, b, wide_a, wide_b) whose signatures collide in WIDE_MATCH coordinates or more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, WIDE) for c in (batch.column(2), batch.column(3)))
        yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= WIDE_MATCH))


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Components (numbered), signatures, the rows of either strip, and whether they are one strip."""
    labels, blocks = np.unique(group.column("label").to_numpy(), return_inverse=True)[1], group.column("block").to_numpy()
    wide = np.frombuffer(b"".join(group.column("wide").to_pylist()), np.uint16).reshape(-1, WIDE)
    one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
    return labels, wide, np.flatnonzero(blocks == one), np.flatnonzero(blocks == two), one == two


def _collisions(labels: np.ndarray, wide: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, step: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the left strip, the rows of the right one in other components with WIDE_MATCH equal coordinates or more."""
    columns = np.ascontiguousarray(wide[right].T)
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        wanted = labels[rows][:, None] != labels[right][None, :]
        if same:
            wanted &= np.arange(len(right))[None, :] > np.arange(at, at + len(rows))[:, None]
        if not wanted.any():
            continue
        count = np.zeros(wanted.shape, np.uint8)
        for c in range(WIDE):
            count += wide[rows, c][:, None] == columns[c][None, :]
        wanted &= count >= WIDE_MATCH
        for k in np.flatnonzero(wanted.any(1)):
            yield int(rows[k]), right[wanted[k]]


def _colliding(group: pa.Table) -> pa.Table:
    """Of one pair of strips: classes that collide across components (b is null), and a spanning forest of the collisions."""
    reps, (labels, *rest) = group.column("rep").to_numpy(), _sides(group)
    marked, joined, edges = np.zeros(len(reps), bool), labels.copy(), []
    for i, hits in _collisions(labels, *rest):
        marked[i] = marked[hits] = True
        while len(other := hits[joined[hits] != joined[i]]):
            edges.append((reps[i], reps[other[0]]))
            joined[joined == joined[other[0]]] = joined[i]
    a = [*reps[marked], *(x for x, _ in edges)]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([None] * int(marked.sum()) + [y for _, y in edges], pa.int64())})


def _across(group: pa.Table) -> pa.Table:
    """A spanning forest of the links between the components of one pair of strips.

    Of the classes that collide only those are compared that share one of the rarest shingles of either."""
    reps, (labels, wide, left, right, same) = group.column("rep").to_numpy(), _sides(group)
    sets, rare = ([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(c)] for c in ("shingles", "rare"))
    posted_, rows = np.concatenate([np.empty(0, np.uint64), *(rare[j] for j in right)]), np.repeat(right, [len(rare[j]) for j in right])
    order = np.argsort(posted_, kind="stable")
    posted_, rows = posted_[order], rows[order]
    joined, a, b = labels.copy(), [], []
    for i, hits in _collisions(labels, wide, left, right, same):
        spans = zip(np.searchsorted(posted_, rare[i], "left"), np.searchsorted(posted_, rare[i], "right"))
        sharing = [rows[x:y] for x, y in spans if x < y]
        for j in np.intersect1d(hits, np.concatenate(sharing)) if sharing else ():
            if joined[i] != joined[j] and _similar(sets[i], sets[j]):
                a.append(reps[i])
                b.append(reps[j])
                joined[joined == joined[j]] = joined[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as lists."""
    for batch in slices(batches, 64):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], ["rep", "s"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(x.as_py() or [], np.int64).tobytes() for x in batch.column(1)], pa.binary())], ["rep", "rare"])


def _rarest(spark: SparkSession, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(rep, rare): of the classes ``members`` the rarest shingles that others have, too.

    Of n shingles, a set at the bound shares all but n - ceil(PERCENT * n / 100), so the rarest of the shared ones is among
    one more than so many rarest of either set.  Shingles of a template are frequent and never get so far."""
    rows = table(spark, members.select("rep").join(sets, "rep").select("rep", "shingles").mapInArrow(released(_listed), "rep long, s array<long>"), "listed")
    tokens = rows.select("rep", F.size("s").alias("n"), F.explode("s").alias("w"))
    shared = table(spark, tokens.groupBy("w").agg(F.count("*").alias("f")).where("f > 1"), "shared")
    ranked = tokens.join(shared, "w").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "w"))).alias("r"))  # a set's shingles at most
    # Shingles of one set alone are the rarest and come first.
    count = F.col("n") - F.floor((F.col("n") * PERCENT + 99) / 100) + 1 - (F.col("n") - F.size("r"))
    own = ranked.select("rep", F.transform(F.slice("r", F.lit(1), F.greatest(count, F.lit(0)).cast("int")), lambda x: x["w"]).alias("rare"))
    return table(spark, own.where(F.size("rare") > 0).mapInArrow(released(_packed), "rep long, rare binary"), "rare")


def _paired(rows: DataFrame, strips: DataFrame) -> DataFrame:
    """``rows`` with ``strips`` (group, blocks): once for each pair of strips of its group that a row is in."""
    rows = rows.join(strips, "group").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("other", "blocks")


def _strips(members: DataFrame, heavy: Column) -> DataFrame:
    """(group, blocks) of the groups of ``members`` (group, label, n_shingles) that hold several components."""
    few = F.least(F.lit(STRIPS), F.ceil(F.count("*") / BLOCK))
    mixed = members.groupBy("group").agg(F.greatest(few, F.ceil(heavy)).cast("int").alias("blocks"), F.min("label").alias("low"), F.max("label").alias("high"))
    return mixed.where("low <> high").select("group", "blocks")


def _picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``wanted`` (rep).

    Rows are picked by a filter of FILTER_BITS bits before they are moved, so that texts that aren't wanted mostly stay
    where they are; the semi-join then is exact, whatever the filter lets through."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    marks = wanted.select(F.bitmap_bucket_number(place("rep")).alias("mark"), F.bitmap_bit_position(place("rep")).alias("bit"))
    marks = marks.groupBy("mark").agg(F.bitmap_construct_agg("bit").alias("bits"))  # (1 << FILTER_BITS) / 32768 rows of 4 kB at most
    own = docs.where("doc_id is not null").withColumn("mark", F.bitmap_bucket_number(place("doc_id"))).withColumn("bit", F.bitmap_bit_position(place("doc_id")).cast("int"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = own.join(F.broadcast(marks), "mark").where(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1)
    return own.join(wanted, F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "text")


def _confirm(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the candidate ``pairs`` that hold on the full ``sets`` (rep, shingles).

    A set is sent once for about CHUNK_BYTES of sets that are compared to it."""
    size = sets.select(F.col("rep").alias("b"), F.octet_length("shingles").alias("bytes"))
    hubs = pairs.join(size, "b").groupBy("a").agg(F.ceil(F.sum("bytes") / CHUNK_BYTES).cast("int").alias("chunks"))
    hubs = table(spark, hubs.withColumn("chunks", F.greatest("chunks", F.lit(1))), "hubs")
    members = pairs.join(hubs, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b")
    members = members.join(sets, F.col("b") == F.col("rep")).select("a", "chunk", "b", "shingles")
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).join(sets, F.col("a") == F.col("rep"))
    both = members.union(heads.select("a", "chunk", F.lit(None).cast("long").alias("b"), "shingles"))
    both = both.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    return table(spark, both.select("a", "b", "shingles").mapInArrow(released(_confirmed), "a long, b long"), "links")


def posted(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(key, rep): the prefix postings, each class under the rarest of its coordinate-value pairs that occur twice."""
    key = lambda pair: F.shiftleft(pair, 6) + F.col("at")
    tokens = classes.select("rep", F.posexplode("coords").alias("at", "value")).select("rep", key(F.col("value")).alias("key"))
    frequent = table(spark, tokens.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    shared = tokens.join(frequent, "key").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("pairs"))  # COORDS pairs at most
    prefix = F.slice("pairs", F.lit(1), F.size("pairs") - F.lit(MATCH - 1))
    return table(spark, shared.where(F.size("pairs") >= MATCH).select("rep", F.explode(prefix).alias("pair")).select("pair.key", "rep"), "postings")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with their component, which is their own where they have no link."""
    return members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _sets_of(spark: SparkSession, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, shingles) of the classes in the first column of ``reps``."""
    wanted = table(spark, reps.toDF("rep").distinct(), "wanted")
    return table(spark, _picked(docs, wanted).mapInArrow(released(_sets), "rep long, shingles binary"), "sets")


def near_dedup(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id, kept (doc_id = component_id)."""
    docs = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    signed = table(spark, spread(docs).mapInArrow(released(_signed), "doc_id long, n_shingles long, set_key binary, coords array<long>, wide binary"), "signed")
    firsts = [F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n_shingles"), F.min("coords").alias("coords"), F.min("wide").alias("wide")]
    classes = table(spark, signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(*firsts), "classes")
    wide = classes.select("rep", "wide", "n_shingles")
    postings = posted(spark, classes)
    # Stars: every member of a list with the list's least member.
    least = table(spark, postings.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "least")
    stars = table(spark, postings.join(least, "key").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "stars")
    alike = stars.join(wide.select(F.col("rep").alias("b"), F.col("wide").alias("wide_b")), "b").join(wide.select(F.col("rep").alias("a"), F.col("wide").alias("wide_a")), "a")
    alike = table(spark, alike.select("a", "b", "wide_a", "wide_b").mapInArrow(released(_alike), "a long, b long"), "alike")
    sets = _sets_of(spark, docs, alike.select("a").union(alike.select("b")))
    links = _confirm(spark, alike, sets)
    labels = table(spark, components(spark, links), "labels")
    # Candidate groups that hold several components: strips of signatures against strips, across components.
    groups = components(spark, stars).select(F.col("node").alias("rep"), F.col("label").alias("group"))
    members = table(spark, _labelled(groups.join(wide, "rep"), labels), "members")
    strips = table(spark, _strips(members, F.count("*") / STRIP_ROWS), "strips")
    found = _paired(members, strips).groupBy("group", "one", "two").applyInArrow(_colliding, "a long, b long")
    found = table(spark, found, "collisions")
    forest, marked = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("rep")).distinct()
    if not forest.isEmpty():
        more = table(spark, marked.join(sets, "rep", "left_anti"), "more")
        sets = sets.union(_sets_of(spark, docs, more))
        links = links.union(_confirm(spark, forest, sets))
        new = table(spark, components(spark, links), "labels")
        # What collides is connected by the forest and by the components that the search began with.
        stems = components(spark, forest.union(labels.select("node", "label"))).select(F.col("node").alias("rep"), F.col("label").alias("group"))
        members = marked.join(_rarest(spark, marked, sets), "rep")
        members = table(spark, _labelled(members.join(stems, "rep").join(wide, "rep"), new), "members")
        strips = table(spark, _strips(members, F.sum("n_shingles") * 8 / STRIP_BYTES), "strips")
        rest = _paired(members, strips).join(sets, "rep").groupBy("group", "one", "two").applyInArrow(_across, "a long, b long")
        labels = table(spark, components(spark, links.union(table(spark, rest, "more"))), "labels")
    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("label"))
    named = table(spark, named, "named")
    out = signed.join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("label", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
