"""Quality classifier: ordinal cumulative-link regression on graded ratings with shared hashed-text weights.

The rating is 0 for low quality, 1 for good quality with toxic content and 2 for good quality without.  Features are
hashed from the whole text: distinct words, shapes of tokens with the share of tokens that have them, how many of the
tokens are distinct, and the share of the most frequent one.  The expected grade ranks documents, the tail probability
P(grade >= 1) selects them.

Defined cases: a null or empty text has the features of a text without tokens; labels of unknown ids and null labels do
no harm, of contradicting labels the higher holds; without labels every document is kept; one result for each row;
columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graded import featured, passing, sample, scored
from .ordinal import CumulativeLink
from .scratch import narrowed
from .toxicity import _WORDS

DIMS, MAX_SAMPLE, GRADES = 1 << 18, 8000, 3
#: Runs of lower-case letters, of other letters, and of digits become one sign each in a token's shape.
_LOWER, _UPPER, _DIGIT = re.compile(r"[a-zß-öø-ÿ]+"), re.compile(r"[^\W\d_a-zß-öø-ÿ]+"), re.compile(r"\d+")


def quality_features(text: str) -> np.ndarray:
    names = {f"w:{w}" for w in set(_WORDS.findall(text.lower()))}
    shapes = Counter(_DIGIT.sub("0", _UPPER.sub("A", _LOWER.sub("a", text))).split())
    n = sum(shapes.values())
    for shape, count in shapes.items():
        names.add(f"s:{shape}")
        names.add(f"s:{shape}:{int(-math.log2(count / n))}")
    tokens = Counter(text.split())
    if n:
        names.add(f"distinct:{int(10 * len(tokens) / n)}:{int(math.log2(n))}")
        names.add(f"distinct:{int(20 * len(tokens) / n)}")
        names.add(f"top:{int(-2 * math.log2(max(tokens.values()) / n))}")
    names.add(f"tokens:{int(math.log2(n + 1))}")
    return np.unique(np.fromiter((zlib.crc32(x.encode()) & (DIMS - 1) for x in names), np.int32, len(names)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_SAMPLE) -> CumulativeLink:
    grade = F.when(F.col("quality") == 0, 0).when(F.col("quality") > 0, F.when(F.col("toxic") > 0, 1).otherwise(2))
    rows, grades, _ = featured(sample(docs, narrowed(labels, doc_id=("doc_id", None), quality=("quality", "int"), toxic=("toxic", "int")), grade, max_rows), quality_features)
    if not len(rows):
        return CumulativeLink(np.zeros(DIMS, np.float32), np.array([-21.0, -20.0]))
    return CumulativeLink.fit(rows, grades, GRADES, DIMS, l2=1e-4)


def quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, expected_grade, p_good = P(grade >= 1), p_best = P(grade >= 2) and kept (p_good >= cut) of every row."""
    docs = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    out = scored(docs, fit(docs, labels, max_rows), quality_features)
    p1, p2 = F.col("tails")[0], F.col("tails")[1]
    return out.select("doc_id", (p1 + p2).alias("expected_grade"), p1.alias("p_good"), p2.alias("p_best"), (p1 >= cut).alias("kept"))


def quality_filter(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """The rows of ``df``, with all their columns, whose p_good reaches ``cut``."""
    docs = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    return passing(df, text_col, fit(docs, labels, max_rows), quality_features, cut)
