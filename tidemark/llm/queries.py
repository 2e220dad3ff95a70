"""The operators applied to their whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import embedding_dedup, html_text, merkle, ngram_lm, packing, resampling, warc_zip
from .exact_dedup import exact_dedup
from .minhash import near_dedup
from .mixing import mix
from .quality import quality
from .sentencepiece_codec import digests
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, read(spark, sf_dir, "documents")).drop("n_chunks")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, read(spark, sf_dir, "documents")).drop("copies")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark, read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"), default_model())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(spark, read(spark, sf_dir, "pages"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, read(spark, sf_dir, "pages"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(spark, read(spark, sf_dir, "embeddings"))


def op10_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(spark, read(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_words")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(spark, read(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(spark, read(spark, sf_dir, "documents"), default_vocabulary())


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_quality, op3_exact_dedup, op4_mixing, op5_minhash, op6_sentencepiece, op7_warc, op8_html_text, op9_embedding_dedup, op10_ngram_lm, op11_resampling, op12_merkle, op13_packing)}

ORACLE: dict[str, str] = {}

ORACLE["op3_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM w
"""

ORACLE["op4_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
r AS (SELECT *, 3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS num,
    2 * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS den, row_number() OVER o AS k
    FROM p WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST)),
open AS (SELECT num, den, k FROM r WHERE 2 * source_size * den > num * w ORDER BY k LIMIT 1),
t AS (SELECT r.source, r.source_size, CASE WHEN o.k IS NULL OR r.k < o.k THEN CAST(2 * r.source_size AS DOUBLE) ELSE CAST(o.num * r.w AS DOUBLE) / CAST(o.den AS DOUBLE) END AS target
    FROM r LEFT JOIN open o ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
m AS (SELECT d.*, g.source_size, g.target, g.rounds, g.target - g.rounds * g.source_size AS need FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS own FROM m)
SELECT doc_id, size, source_size, target, CAST(size * (rounds + CASE WHEN upto - own + own / 2 < need THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

ORACLE["op5_minhash"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.y, w.doc_id) AS component_id, coalesce(c.y, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.x = w.doc_id
"""

ORACLE["op7_warc"] = r"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM f
"""

ORACLE["op9_embedding_dedup"] = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.y AS component_id, c.y = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id JOIN c ON c.x = vec_id
"""


def _crc32(hexa: str) -> str:
    """The unsigned crc32 of bytes in hexadecimal digits, byte by byte over a table."""
    table = "[" + ", ".join(str(c) for c in CRC_TABLE) + "]"
    steps = f"list_transform(range(1, length({hexa}) // 2 + 1), lambda i: CAST('0x' || substr({hexa}, 2 * i - 1, 2) AS BIGINT))"
    return f"xor(list_reduce({steps}, lambda c, b: xor(c >> 8, {table}[xor(c & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


def _crc_row(c: int) -> int:
    for _ in range(8):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


CRC_TABLE = [_crc_row(b) for b in range(256)]

ORACLE["op11_resampling"] = rf"""
WITH w AS (SELECT true AS raw, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT false, row_number() OVER (), item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
f AS (SELECT raw, r, array_to_string(w[i : i + k - 1], ' ') AS f FROM (SELECT raw, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT raw, r, w, unnest([1, 2, 3]) AS k FROM w) WHERE len(w) >= k)),
d AS (SELECT f, count(*) FILTER (WHERE raw) AS s, count(*) FILTER (WHERE NOT raw) AS t FROM f GROUP BY f),
k AS (SELECT f, s, t, {_crc32("x")} % 10000 AS bucket FROM (SELECT *, hex(encode(f)) AS x FROM d)),
b AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM k GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000)))) AS BIGINT) AS gain FROM b),
p AS (SELECT r, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN k USING (f) JOIN g USING (bucket) WHERE raw GROUP BY r),
x AS (SELECT w.r, doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN p ON p.r = w.r WHERE raw),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank, 5 * count(*) OVER () // 100 AS drawn FROM x WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM x LEFT JOIN o ON o.r = x.r
"""


def _merkle_sql(levels: int = 20) -> str:
    """Levels of all trees as lists; a tree that is one node stays as it is."""

    def field(c: str) -> str:
        return f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def climb(name: str, first: str) -> str:
        parts = [first]
        for i in range(levels):
            up = f"CASE WHEN len(l{i}) > 1 THEN list_transform(range(0, CAST(ceil(len(l{i}) / 3) AS BIGINT)), lambda i: sha256(array_to_string(l{i}[3 * i + 1 : 3 * i + 3], ''))) ELSE l{i} END"
            parts.append(f"{name}{i + 1} AS (SELECT *, {up} AS l{i + 1} FROM {name}{i})")
        return ", ".join(parts)

    def path(place: str, t: str) -> str:
        steps = []
        for i in range(levels):
            at = f"(({place}) // {3**i})"
            left, right = f"array_to_string({t}.l{i}[{at} // 3 * 3 + 1 : {at}], '')", f"array_to_string({t}.l{i}[{at} + 2 : {at} // 3 * 3 + 3], '')"
            steps.append(f"CASE WHEN len({t}.l{i}) > 1 THEN [{{'a': {left}, 'b': {right}}}] ELSE [] END")
        return f"flatten([{', '.join(steps)}])"

    own = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    seen = own.replace(field("text"), field(f"(CASE WHEN doc_id IS NOT NULL AND {_crc32('hex(encode(CAST(doc_id AS VARCHAR)))')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)"))
    return f"""
WITH d AS (SELECT doc_id, source, sha256({own}) AS leaf, sha256({seen}) AS seen FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS LAST, leaf) - 1 AS place FROM d),
{climb("t", "t0 AS (SELECT source, list(leaf ORDER BY place) AS l0 FROM n GROUP BY source)")},
s AS (SELECT *, l{levels}[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM t{levels}),
{climb("r", "r0 AS (SELECT list(subroot ORDER BY tree) AS l0 FROM s)")},
p AS (SELECT n.doc_id, n.leaf, n.seen, s.subroot, r.l{levels}[1] AS root, {path("n.place", "s")} || {path("s.tree", "r")} AS path
    FROM n JOIN s ON n.source IS NOT DISTINCT FROM s.source CROSS JOIN r{levels} AS r),
f AS (SELECT *, array_to_string(list_transform(path, lambda x: x.a || x.b), '') AS proof,
    list_reduce(list_transform(path, lambda x: [x.a, x.b]), lambda acc, x: [sha256(x[1] || acc[1] || x[2])], [seen])[1] AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


ORACLE["op12_merkle"] = _merkle_sql()
