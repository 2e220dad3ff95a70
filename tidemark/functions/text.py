"""Scalar functions on text: budgets, truncation, cleaning, tokens and set similarity. All are column expressions.

White space is that of Unicode, as ``\\s`` is ASCII in Java's patterns unless ``(?U)`` is on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"(?U)\s+"
# The prefixes of results that name their kind.
RESULT_KINDS = ("Impact", "Status", "Agenda", "Policy", "Action")
# Frequent English words that are no keywords.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should")


def truthy(c: Column, kind: str = "string") -> Column:
    """Not null and not empty; white space alone counts as content."""
    return c.isNotNull() & ((F.length(c) if kind == "string" else F.size(c)) > 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def token_estimate(c: Column, chars_per_token: int = 4) -> Column:
    return F.floor(F.length(c) / chars_per_token).cast("long")


def words(c: Column) -> Column:
    """Tokens between white space, without empty ones."""
    return F.filter(F.split(c, WHITE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, WHITE, " "))


def normal_title(c: Column) -> Column:
    return F.lower(collapse(c))


def clean_summary(c: Column) -> Column:
    """One line: literal and real line breaks and tabs become spaces, runs of white space one space."""
    return collapse(F.regexp_replace(c, r"\\n|\\t", " "))


def metric_text(c: Column) -> Column:
    """Lower case, only ASCII letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def without_references(c: Column) -> Column:
    """Without markers such as [12]."""
    return F.regexp_replace(c, r"\[\d+\]", "")


def without_result_kind(c: Column) -> Column:
    return strip(F.regexp_replace(c, rf"^(?:{'|'.join(RESULT_KINDS)}):\s*", ""))


def cap_words(c: Column, n: int, suffix: str = "...") -> Column:
    """The first n words with the suffix, which is always there."""
    return F.concat(F.array_join(F.slice(words(c), 1, n), " "), F.lit(suffix))


def preview(c: Column, n: int = 200, suffix: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def _last(c: Column, pattern: str) -> Column:
    """1-based place of the last character that matches, 0 if none does."""
    return F.length(F.regexp_extract(c, rf"(?s)^(.*{pattern})", 1))


def smart_truncate(c: Column, n: Column | int) -> Column:
    """At most n characters: up to a sentence end behind 0.7 n, else up to the last space, else cut; the latter two get '...'."""
    n = F.lit(n) if isinstance(n, int) else n
    head = F.substring(c, F.lit(1), n)
    sentence, space = _last(head, "[.!?]"), _last(head, " ")
    cut = F.when(sentence - 1 > n * 0.7, F.substring(head, F.lit(1), sentence)).when(space > 1, F.concat(F.substring(head, F.lit(1), space - 1), F.lit("..."))).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(c) <= n, c).otherwise(cut)


def greedy_budget(texts: Column, max_tokens: int, chars_per_token: int = 4) -> Column:
    """Texts in order while the budget lasts; the one that exceeds it is cut to what is left, and is the last."""
    size = lambda t: F.floor(F.length(t) / chars_per_token).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, t: Column) -> Column:
        left = F.lit(max_tokens) - acc["used"]
        cut = F.substring(t, F.lit(1), (left * chars_per_token).cast("int"))
        fits = size(t) <= left
        with_cut = F.when(left > 0, F.concat(acc["kept"], F.array(cut))).otherwise(acc["kept"])
        new = F.struct(F.when(fits, acc["used"] + size(t)).otherwise(F.lit(max_tokens).cast("long")).alias("used"), (~fits).alias("over"), F.when(fits, F.concat(acc["kept"], F.array(t))).otherwise(with_cut).alias("kept"))
        return F.when(acc["over"], acc).otherwise(new)

    return F.aggregate(texts, start, add, lambda acc: acc["kept"])


def equal_share_budget(texts: Column, max_tokens: int, chars_per_token: int = 4) -> Column:
    """Nothing happens within the budget; else each text is cut to its share, the first ones get the remainder."""
    n = F.size(texts)
    total = F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + F.floor(F.length(t) / chars_per_token))
    share = F.floor(F.lit(max_tokens) / n)
    each = lambda i: (share + F.when(i < F.lit(max_tokens) % n, 1).otherwise(0)).cast("int")
    cut = F.transform(texts, lambda t, i: F.when(F.floor(F.length(t) / chars_per_token) <= each(i), t).otherwise(smart_truncate(t, each(i) * chars_per_token)))
    return F.when((n == 0) | (total <= max_tokens), texts).otherwise(cut)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def token_set(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(c), WHITE)), "")


def keyword_pattern(least: int) -> str:
    return rf"(?U)\b([a-z]{{{least},}})\b"


def keywords(c: Column, least: int = 3) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(keyword_pattern(least)), F.lit(1)), lambda w: ~w.isin(*STOP_WORDS))


def sentences(c: Column) -> Column:
    """What stands between full stops, exclamation and question marks and line ends."""
    return F.regexp_extract_all(c, F.lit(r"[^.!?\n]+"), F.lit(0))


def letter_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))


def proper_nouns(c: Column) -> Column:
    """Capitalised words that do not begin a sentence, where there is no corpus to tell names from other words; see ``operators.names``."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(?<![.!?]\s|^)\b(\p{Lu}\p{L}+)\b"), F.lit(1))


def folder_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9-]", "_")


def scaled_budget(texts_per_event: Column, limit: Column | int, share: float = 0.8, base: int = 8000) -> Column:
    """The smaller of base times the scale of texts per event, 1:1, 5:2, 10:4, 20:8 else 1, and a share of the model's limit."""
    scale = F.when(texts_per_event == 5, 2).when(texts_per_event == 10, 4).when(texts_per_event == 20, 8).otherwise(1)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.least(scale * base, F.floor(limit * share)).cast("long")


def model_limit(name: Column, table: Sequence[tuple[str, int]], default: int = 8000) -> Column:
    """The limit of a model: an exact match, else the first table entry that the name contains, else the default."""
    out = F.lit(None).cast("long")
    for key, value in table:
        out = F.coalesce(out, F.when(name == key, F.lit(value)))
    for key, value in table:
        out = F.coalesce(out, F.when(F.contains(name, F.lit(key)), F.lit(value)))
    return F.coalesce(out, F.lit(default))


def truncated_cues(strings: Column, share: Column | int) -> Column:
    """Cue lists within a share of characters: a list whose text is longer keeps its first three, each cut at a quarter of the share."""
    share = F.lit(share) if isinstance(share, int) else share
    cut = lambda x: F.when(F.length(x) > share / 4, F.concat(F.substring(x, F.lit(1), (share / 4).cast("int")), F.lit("..."))).otherwise(x)
    long = F.length(F.array_join(strings, ", ")) > share
    return F.transform(F.when(long, F.slice(strings, 1, 3)).otherwise(strings), cut)


def shrunk_length(n: int, limit: int = 7000, chars_per_token: int = 2, rate: float = 0.85, least: int = 500) -> int:
    """How long a text may stay so that its estimate is within the limit: it loses a rate at each step, down to the least."""
    while n // chars_per_token > limit:
        new = max(least, int(n * rate))
        if new >= n:
            break
        n = new
    return n


def shrunk_prompt(c: Column, limit: int = 7000) -> Column:
    """The text cut as ``shrunk_length`` says."""
    import pandas as pd

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else t[: shrunk_length(len(t), limit)])

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)
