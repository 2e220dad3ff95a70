"""The pipeline's stages one by one against brute force, on odd rows, and end to end."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_documents import WHITE, brute_components, brute_targets, edited, shingles, words
from tidemark.llm.queries import default_model
from tidemark.llm.quality import quality
from tidemark.llm.scratch import released

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    base = words(120, 7)
    rows = [(0, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n", None, "a", 3), (None, "no id", "en", "b", 5), (3, "a b c d e f", "en", None, 11), (4, "A B  c d e f", "en", "b", 12), (5, "a b c d e f", "en", "b", 11), (6, "twice over again here now", "en", "c", 1), (6, "twice over again here now", "en", "c", 1)]
    rows += [(10 + i, " ".join(base), "en", "hot", 1) for i in range(9)]
    rows += [(30 + i, edited(base, i % 3, i), "en", "hot", 1) for i in range(12)]
    rows += [(60 + i, " ".join(words(40, 500 + i)), "de", f"s{i % 4}", 1) for i in range(40)]
    rows += [(200 + i, "X!! " * (20 + i), "en", "junk", 1) for i in range(15)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60, 100)] + [(200 + i, 0, 0) for i in range(12)] + [(None, 1, None), (61, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def rows_of(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def test_quality_stage(spark, docs, sf):
    out = cp.good_documents(spark, docs, sf)
    good = {(r.doc_id) for r in quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert out.columns == docs.columns
    assert rows_of(out) == Counter({k: n for k, n in rows_of(docs).items() if k[0] in good})
    assert not any(i is not None and i >= 200 for i, *_ in rows_of(out)) and set(range(60, 100)) <= {k[0] for k in rows_of(out)}


def test_exact_stage(spark, docs, sf):
    out = cp.without_copies(spark, docs, sf)
    norm = lambda t: WHITE.sub("", t or "")
    assert out.columns == docs.columns
    kept = rows_of(out)
    assert Counter(norm(k[1]) for k in kept.elements()) == Counter({norm(k[1]): 1 for k in rows_of(docs)})
    assert (2, "  \n", None, "a", 3) in kept and (3, "a b c d e f", "en", None, 11) in kept and (4, "A B  c d e f", "en", "b", 12) in kept


def test_near_stage(spark, docs, sf):
    out = cp.without_near_copies(spark, docs, sf)
    sets = {k[0]: shingles(k[1]) for k in rows_of(docs) if k[0] is not None}
    label = brute_components(sets)
    kept = rows_of(out)
    assert out.columns == docs.columns
    assert {k[0] for k in kept if k[0] is not None} == {i for i in label if label[i] == i} and kept[6, "twice over again here now", "en", "c", 1] == 1


def test_dedup_stages_decide_by_rows(spark, sf):
    a, b, c, d = (" ".join(words(60, 900 + i)) for i in range(4))
    near_a = a + " end"
    rows = [(1, a, "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, near_a, "en", "s", 1), (2, near_a, "en", "s", 1), (2, d, "en", "s", 1), (3, a, "en", "s", 1), (3, c + " of its own", "en", "s", 1), (2, a, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    exact = rows_of(cp.without_copies(spark, docs, sf))
    assert exact == Counter(r for r in rows if r not in {rows[3], rows[6], rows[8]})
    assert rows_of(cp.without_near_copies(spark, docs, sf)) == Counter([rows[0], rows[1], rows[5], rows[7]])


def test_mixing_stage(spark, docs, sf):
    out = cp.mixed(spark, docs, sf)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken, most = Counter(), Counter(), Counter()
    for k in rows_of(docs).elements():
        total[k[3]] += size(k[1])
        most[k[3]] = max(most[k[3]], size(k[1]))
    for k in rows_of(out).elements():
        taken[k[3]] += size(k[1])
    goal = brute_targets({s: total[s] for s in total})
    assert out.columns == docs.columns and max(rows_of(out).values()) <= 4
    for s in total:
        assert abs(taken[s] - goal[s]) <= 2 * most[s], s


def test_encoding_stage(spark, docs, sf):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    out = cp.encoded(spark, docs, sf).collect()
    sha = lambda t: hashlib.sha256(model.decode(model.encode(t or "", add_bos=True, add_eos=True)).encode()).hexdigest()
    assert Counter((r.doc_id, r.decoded_sha256) for r in out) == Counter((k[0], sha(k[1])) for k in rows_of(docs).elements())


def test_stages_take_empty_tables(spark, docs, sf):
    none = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_stages_take_any_columns(spark, docs, sf):
    """Extra columns named as the stages name theirs, or as another column but for case, go along and change nothing."""
    extra = ["gone", "repeated", "_norm", "_mix_h", "key", "h", "copies", "DOC_ID", "Text", "a.b", "_0"]
    odd = docs.toDF(*docs.columns).select("*", *[F.concat(F.lit(f"{i}:"), F.coalesce("text", F.lit("-"))) for i in range(len(extra))]).toDF(*docs.columns, *extra)
    for name, stage in cp.STAGES:
        out = stage(spark, odd, sf)
        if name == cp.STAGES[-1][0]:
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, stage(spark, docs, sf).collect()))
        else:
            assert out.columns == odd.columns
            rows = out.collect()
            assert Counter(tuple(r)[:5] for r in rows) == Counter(map(tuple, stage(spark, docs, sf).collect())), name
            assert all(v == f"{i}:{r[1] if r[1] is not None else '-'}" for r in rows for i, v in enumerate(tuple(r)[5:]))


def test_run(spark, sf):
    out = cp.run(spark, sf)
    assert out.where(F.col("n_tokens") < 2).count() == 0 and out.where("doc_id >= 200").count() == 0
    again = cp.run(spark, sf)
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, again.collect()))
    assert [n for n, _ in cp.STAGES][0] == "quality classifier" and len(cp.STAGES) == 5


def test_released_passes_batches_and_frees_its_memory():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10

    def run(batches):
        held = [bytes(900) for _ in range(200_000)]
        kept = held[::2000]
        for batch in batches:
            yield batch
        del held
        run.kept = kept

    batches = [pa.record_batch({"x": pa.array([i])}) for i in range(3)]
    first = resident()
    assert list(released(run)(iter(batches))) == batches
    assert resident() - first < 100
