"""Toxicity: cumulative-link ordinal regression from hashed words to severity grades.

The labels say toxic or not.  Severity is graded from them: 0 not toxic, 1 toxic, 2 toxic with many toxic words.  A word
counts as toxic if a first fit on the plain labels gives it a weight of at least ``STRONG``; the bound between 1 and 2
is the median number of such words among toxic rows.  One weight vector then serves both thresholds.

Defined cases: a null text counts as empty; labels of unknown or repeated ids and null labels do no harm, of
contradicting labels the higher holds; without labels nothing is toxic; one result for each row, whatever its copies;
columns other than id and text are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graded import featured, sample, scored
from .ordinal import CumulativeLink
from .scratch import narrowed

DIMS, MAX_SAMPLE, STRONG, GRADES, STEMS = 1 << 20, 8000, 1.0, 3, (4,)
PENALTIES = {"l2": 1e-4, "l1": 1e-4}
_WORDS = re.compile(r"[^\W\d_]+")


def word_features(text: str) -> np.ndarray:
    """Indices of a text's distinct lower-case words and of the stems with which longer words begin."""
    words = set(_WORDS.findall(text.lower()))
    words |= {w[:n] + "-" for w in words for n in STEMS if len(w) > n}
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & (DIMS - 1) for w in words), np.int32, len(words)))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_SAMPLE) -> CumulativeLink:
    rows, toxic, _ = featured(sample(docs, narrowed(labels, doc_id=("doc_id", None), toxic=("toxic", "int")), F.col("toxic"), max_rows), word_features)
    toxic = (toxic > 0).astype(int)
    plain = CumulativeLink.fit(rows, toxic, 2, DIMS, **PENALTIES)
    if not toxic.any():
        return CumulativeLink(np.zeros(DIMS, np.float32), np.array([20.0, 21.0]))
    strong = np.array([(plain.weights[r] >= STRONG).sum() for r in rows])
    many = strong > np.median(strong[toxic == 1])
    return CumulativeLink.fit(rows, toxic * (1 + many), GRADES, DIMS, **PENALTIES)


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.4, max_rows: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, expected_severity, p_toxic, p_severe, severity (the likeliest grade) and toxic (p_toxic >= cut) of every row."""
    docs = narrowed(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    out = scored(docs, fit(docs, labels, max_rows), word_features)
    p1, p2 = F.col("tails")[0], F.col("tails")[1]
    likeliest = F.when((1 - p1 >= p1 - p2) & (1 - p1 >= p2), 0).when(p1 - p2 >= p2, 1).otherwise(2)
    return out.select("doc_id", (p1 + p2).alias("expected_severity"), p1.alias("p_toxic"), p2.alias("p_severe"), likeliest.alias("severity"), (p1 >= cut).alias("toxic"))
