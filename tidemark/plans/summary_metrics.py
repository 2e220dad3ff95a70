"""Metrics of generated summaries against references: ROUGE, BLEU, METEOR, and the evolution of summaries over windows.

Set metrics are expressions; n-grams, longest common subsequences, BLEU and METEOR's
alignment run in an Arrow-batched function.  METEOR has the exact and the stem stage only, hence its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import stem
from ..functions.text import jaccard, metric_text, token_set
from ..sources.written import Scratch

_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str | None, stemmed: bool = False) -> list[str]:
    found = _TOKEN.findall((text or "").lower())
    return [stem(t) if len(t) > 3 else t for t in found] if stemmed else found


def f_score(hits: float, n_hyp: int, n_ref: int) -> float:
    return 0.0 if not hits else 2 * hits / (n_hyp + n_ref)


def ngrams(seq: Sequence[str], n: int) -> Counter:
    return Counter(zip(*(seq[i:] for i in range(n))))


def rouge_n(hyp: list[str], ref: list[str], n: int) -> float:
    h, r = ngrams(hyp, n), ngrams(ref, n)
    return f_score(sum((h & r).values()), sum(h.values()), sum(r.values()))


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, with the bit-parallel row update of Hyyrö (2004)."""
    masks: dict[str, int] = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for t in b:
        hit = row & masks.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def rouge_l(hyp: list[str], ref: list[str]) -> float:
    return f_score(lcs(hyp, ref), len(hyp), len(ref))


def bleu(hyp: list[str], ref: list[str], order: int = 4, epsilon: float = 0.1) -> float:
    """Sentence BLEU; a count of zero becomes epsilon, but without a common word the score is 0."""
    if not hyp or not set(hyp) & set(ref):
        return 0.0
    log = 0.0
    for n in range(1, order + 1):
        h = ngrams(hyp, n)
        log += math.log((sum((h & ngrams(ref, n)).values()) or epsilon) / max(1, sum(h.values())))
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(log / order)


def meteor_exact_stem(hyp: list[str], ref: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Words are aligned exactly first, the rest by stems, each to the earliest free place."""
    pairs: dict[int, int] = {}
    for key in (lambda w: w, stem):
        free: dict[str, list[int]] = {}
        used = set(pairs.values())
        for j in range(len(ref) - 1, -1, -1):
            if j not in used:
                free.setdefault(key(ref[j]), []).append(j)
        for i, w in enumerate(hyp):
            if i not in pairs and free.get(key(w)):
                pairs[i] = free[key(w)].pop()
    if not pairs:
        return 0.0
    m, ordered = len(pairs), sorted(pairs.items())
    chunks = 1 + sum(b != (a[0] + 1, a[1] + 1) for a, b in zip(ordered, ordered[1:]))
    p, r = m / len(hyp), m / len(ref)
    return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (chunks / m) ** beta)


#: Whether a metric reads stems, and what it makes of two lists of tokens.
ON_TOKENS: dict[str, tuple[bool, Callable[[list[str], list[str]], float]]] = {
    "rouge1": (True, lambda h, r: rouge_n(h, r, 1)),
    "rouge2": (True, lambda h, r: rouge_n(h, r, 2)),
    "rouge_l": (True, rouge_l),
    "bleu": (False, bleu),
    "meteor_exact_stem": (False, meteor_exact_stem),
}
#: Stems that a task remembers.
REMEMBERED = 200_000


def _on_texts(stemmed: bool, fn: Callable[[list[str], list[str]], float]) -> Callable[[str | None, str | None], float]:
    return lambda h, r: fn(tokens(h, stemmed), tokens(r, stemmed))


SCORES: dict[str, Callable[[str | None, str | None], float]] = {name: _on_texts(*how) for name, how in ON_TOKENS.items()}


def score(hyp: Column | str, ref: Column | str, name: str) -> Column:
    """A sequence metric as a column."""
    fn = SCORES[name]

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, r in batches:
            yield pd.Series([fn(x, y) for x, y in zip(h, r)], dtype="float64")

    return run(hyp, ref)


def rouge_n_plain(rows: DataFrame, key: str, hyp: str, ref: str, n: int) -> DataFrame:
    """(key, f) without stemming; keys are distinct. A row's n-grams are counted where the row is, so no n-gram is shuffled."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for h, r in batches:
            yield pd.Series([rouge_n((x or "").split(), (y or "").split(), n) for x, y in zip(h, r)], dtype="float64")

    return rows.select(key, run(metric_text(F.col(hyp)), metric_text(F.col(ref))).alias("f"))


def token_similarity(a: Column, b: Column) -> Column:
    """The default similarity of the evolution metrics; any other column expression may take its place."""
    return jaccard(token_set(a), token_set(b))


def previous(rows: DataFrame, topic: str, order: str, hyp: str, mode: str = "first") -> DataFrame:
    """Adds ``previous``: the topic's earliest summary, null on itself, or with mode 'lag' the one just before."""
    if mode == "lag":
        return rows.withColumn("previous", F.lag(hyp).over(Window.partitionBy(topic).orderBy(order)))
    if mode != "first":
        raise ValueError(f"unknown mode {mode!r}")
    # A row per topic from a partial aggregate, so that a topic's texts needn't meet in one task.
    first = rows.groupBy(F.col(topic).alias("_topic")).agg(F.min_by(hyp, order).alias("_first"), F.min(order).alias("_from"))
    joined = rows.join(first, F.col(topic).eqNullSafe(F.col("_topic")), "left")
    return joined.withColumn("previous", F.when(F.col(order) > F.col("_from"), F.col("_first"))).drop("_topic", "_first", "_from")


def novelty(hyp: Column, prev: Column, ref: Column, sim: Callable[[Column, Column], Column] = token_similarity) -> Column:
    """Similarity of what is new in a summary, in the order of its first appearance, to the reference; nothing new is 0."""
    new = F.array_except(token_set(hyp), token_set(F.coalesce(prev, F.lit(""))))
    return F.when(F.size(new) > 0, sim(F.array_join(new, " "), ref)).otherwise(0.0)


#: Summaries, and references, that are compared at once.
SUMMARIES, REFERENCES = 128, 512


def _batches(scratch: Scratch, rows: DataFrame, most: int, label: str) -> DataFrame:
    """Rows as lists of up to ``most``, one list for each column, written."""
    kind = ", ".join(f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, most):
                part = [c.slice(at, most) for c in b.columns]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in part], b.schema.names)

    return scratch.write(rows.mapInArrow(lists, kind), label)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, member) of a column of lists."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths), lists.flatten().to_numpy(zero_copy_only=False)


def set_distances(scratch: Scratch, rows: DataFrame, refs: DataFrame, key: str, topic: str, hyp: str) -> DataFrame:
    """(key, _far, _n): sums over a list of summaries and one of references, which meet as two rows; sets are of 64-bit hashes.

    A summary's words are counted for all references at once by the references that hold them, so a pair costs its common words."""
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    left = _batches(scratch, rows.select(F.col(key).alias("key"), F.xxhash64(topic).alias("topic"), hashed(hyp).alias("words")), SUMMARIES, "summary-lists")
    right = _batches(scratch, refs.select(hashed("_ref").alias("ref"), F.transform("_topics", lambda t: F.xxhash64(t)).alias("topics")), REFERENCES, "reference-lists")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, topics, words, ref, refs_topics = (b[c][i].values for c in ("key", "topic", "words", "ref", "topics"))
                (at, word), (held, own) = _flat(words), _flat(ref)
                n, m, sizes = len(keys), len(ref), np.bincount(held, minlength=len(ref))
                order = np.argsort(own, kind="stable")
                own, held = own[order], held[order]
                lo, hi = np.searchsorted(own, word), np.searchsorted(own, word, "right")
                far = hi > lo
                # Each summary's words that are in references, and all references that have them.
                count, start, row = (hi - lo)[far], lo[far], at[far]
                each = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                both = np.bincount(np.repeat(row, count) * m + held[each], minlength=n * m).reshape(n, m)
                total = np.bincount(at, minlength=n)[:, None] + sizes[None, :] - both
                distance = 1 - np.divide(both, total, out=np.zeros((n, m)), where=total > 0)
                of, known = _flat(refs_topics)
                numbers, place = np.unique(known, return_inverse=True)
                has = np.zeros((len(numbers) + 1, m))
                has[place, of] = 1
                mine = topics.to_numpy(zero_copy_only=False)
                found = np.minimum(np.searchsorted(numbers, mine), max(len(numbers) - 1, 0))
                found = np.where(numbers[found] == mine, found, len(numbers)) if len(numbers) else np.zeros(n, int)
                others = np.bincount(of, minlength=m)[None, :] - has[found]
                yield pa.RecordBatch.from_arrays([keys, pa.array((others * distance).sum(1)), pa.array(others.sum(1).astype(np.int64))], ["key", "_far", "_n"])

    kind = rows.schema[key].dataType.simpleString()
    met = left.crossJoin(right).mapInArrow(compared, f"key {kind}, _far double, _n long")
    return met.groupBy(F.col("key").alias(key)).agg(F.sum("_far").alias("_far"), F.sum("_n").alias("_n"))


def distinctiveness(rows: DataFrame, key: str, topic: str, hyp: str, ref: str, sim: Callable[[Column, Column], Column] = token_similarity) -> DataFrame:
    """(key, distinctiveness): mean distance to the references of other topics over the distance to one's own; 1 without others.

    The metric is defined over all pairs of a summary and a reference of another topic, so its work is the number of
    summaries times that of distinct references, which are few.  Each distinct reference is compared once to a summary and
    counts for all its other topics.  Both sides are written, so that their product is read where it is made: no summary
    is shuffled, whether Spark finds the references small enough to send or not.  For the Jaccard index of token sets, lists
    of summaries meet lists of references."""
    scratch = Scratch(rows.sparkSession)
    rows = scratch.write(rows.select(key, topic, hyp, ref), "summaries")
    refs = scratch.write(rows.groupBy(F.col(ref).alias("_ref")).agg(F.collect_set(topic).alias("_topics")), "references")
    plain = rows.where(F.col(key).isNull() | F.col(topic).isNull() | F.col(hyp).isNull() | F.col(ref).isNull())
    if sim is jaccard and plain.isEmpty():
        far = set_distances(scratch, rows, refs, key, topic, hyp)
    else:
        met = rows.crossJoin(refs)
        others = F.size("_topics") - F.array_contains("_topics", F.col(topic)).cast("int")
        # A summary's rows follow each other, so what is shuffled are its sums, one for each part of the references.
        far = met.groupBy(key).agg(F.sum(others * (1 - sim(F.col(hyp), F.col("_ref")))).alias("_far"), F.sum(others).alias("_n"))
    value = F.col("_far") / (F.col("_n") * F.col("_own"))
    own = rows.select(key, (1 - sim(F.col(hyp), F.col(ref)) + 1e-8).alias("_own"))
    return own.join(far, key, "left").select(key, F.when(F.coalesce("_n", F.lit(0)) == 0, 1.0).otherwise(value).alias("distinctiveness"))


def evaluate_all(rows: DataFrame, hyp: str, ref: str, metrics: Sequence[str] = tuple(SCORES)) -> DataFrame:
    """``rows`` with all ``metrics``, in one pass that cuts and stems each text once."""
    @F.pandas_udf(", ".join(f"{m} double" for m in metrics))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}

        def stemmed(found: list[str]) -> list[str]:
            if len(known) > REMEMBERED:
                known.clear()
            return [known.get(t) or known.setdefault(t, stem(t) if len(t) > 3 else t) for t in found]

        for batch in batches:
            made = []
            for h, r in zip(*batch):
                plain = tokens(h), tokens(r)
                forms = {True: tuple(map(stemmed, plain)), False: plain}
                made.append([ON_TOKENS[m][1](*forms[ON_TOKENS[m][0]]) for m in metrics])
            yield pd.DataFrame(made, columns=list(metrics), dtype="float64")

    return rows.withColumn("_scores", run(hyp, ref)).select(*[c for c in rows.columns if c not in metrics], *[F.col(f"_scores.{m}").alias(m) for m in metrics])


def averages(scored: DataFrame, metrics: Sequence[str] = tuple(SCORES)) -> DataFrame:
    return scored.agg(*[F.avg(m).alias(m) for m in metrics], F.count("*").alias("sample_count"))
