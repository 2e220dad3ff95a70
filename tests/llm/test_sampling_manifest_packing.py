"""Resampling, manifest and packing against brute-force versions, with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import merkle as mk
from tidemark.llm import packing as pk
from tidemark.llm import resampling as rs
from tidemark.llm.queries import ORACLE, QUERIES, default_vocabulary

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, row string, part int, leaf string, `Block` string, size string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 300, n))
    found = [
        (1, None, "en", None, None), (2, "", None, 0, ""), (3, "a", "en", 1, " \t\n\r\x0b\x0c"), (4, "lone", "en", 8, "One\n\nTwo"), (5, "b", "de", 9, "Straße ÄÖÜ"), (None, "b", "en", 3, "no id\nat all"), (None, None, "en", 3, "no id\nat all"),
        (6, "b", "en", 5, "same row twice"), (6, "b", "en", 5, "same row twice"), (6, "b", "en", 5, "same id, other text"), (7, "é", "en", 6, "\U0001f600 emoji 日本語   text\n"), (8, "Z", "en", 7, text(4000)), (9, "Z", "en", 7, "x" * 50_000), (10, "Z", "en", 7, "<|endoftext|> a <|endoftext|>b"),
        (11, "Z", "en", 7, "tab \x1c \x1d odd\x1f x"), (12, "Z", "en", 7, "\n" * 3000 + "a" + " " * 2000),
    ]
    found += [(100 + i, "hot", "en", i, f"{text(10 + i % 40)}\n{text(5)}") for i in range(130)]
    found += [(400 + i, f"s{i}", "en", i, text(25)) for i in range(40)]
    return [(*r, "p", "r", 1, "l", "B", "z") for r in found]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(a, b):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


# ------------------------------------------------------------------------------------------------------------ resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def resampled(docs, target, percent=5, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out = []
    for doc_id, text in docs:
        words, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in own)
        out.append([doc_id, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = rank + 1
    return out


TARGET = ["w1 w2 w3 w4", "W5 w6, w7", None, "", "Straße w9"]


@pytest.mark.parametrize("block_words", [1 << 20, 64])
def test_resampling_is_brute_force(spark, docs, rows, monkeypatch, block_words):
    # With small blocks, long texts go over several of them and the dictionary has several parts.
    monkeypatch.setattr(rs, "BLOCK_WORDS", block_words)
    if block_words == 64:
        monkeypatch.setattr(rs, "PART_FEATURES", 2000)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    found = [list(r) for r in rs.resample(spark, docs, target, percent=20).collect()]
    assert same(found, resampled([(r[0], r[4]) for r in rows], TARGET, percent=20))
    assert sorted(r[5] for r in found if r[5]) == list(range(1, sum(r[1] >= 20 for r in found) * 20 // 100 + 1))


def test_resampling_of_empty_tables(spark, docs):
    none, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert rs.resample(spark, none, target).collect() == []
    assert all(r.rank is None or r.n_words >= 20 for r in rs.resample(spark, docs, target).collect())


def test_features_travel_shortened():
    vocabulary = [b"a", b"bb", "ü".encode(), b"d"]
    code, _ = rs.codes(np.array([1, 2, 3, 1, 2, 4, 1, 2], np.uint32), np.array([8]), np.array([8]))
    distinct = np.unique(code)
    size, shared = rs.shortened(distinct, np.array([0, 5]))
    own = [b"", *vocabulary]
    full = [b" ".join(own[p] for p in places if p) for places in np.stack(rs._places(distinct), 1)]
    sent = np.array([p for places, n, k in zip(np.stack(rs._places(distinct), 1), size, shared) for p in places[k:n]])
    # Lists begin at 0 and 5 and are read each for itself; numbers of words go from 0 on there.
    cut, shape = int(sum(size[:5] - shared[:5])), (size * 4 + shared).astype(np.uint8)
    lists = [rs.features(shape[a:b], words - 1, len(vocabulary)) for a, b, words in ((0, 5, sent[:cut]), (5, len(size), sent[cut:]))]
    found = rs.joined([np.concatenate(p) for p in zip(*lists)], pa.array(vocabulary, pa.binary()))
    assert found.to_pylist() == full and shared.max() == 2


def test_hashes_of_features_are_those_of_their_strings():
    known = [b"a", b"bc", "\u00e9t\u00e9".encode(), b"x" * 5000, b"0", b"y" * 255]
    places = [np.array(p) for p in zip(*[(i, j, k) for i in range(6) for j in range(7) for k in range(7) if j < 6 or k == 6])]
    strings = [b" ".join(known[i] for i in row if i < 6) for row in zip(*places)]
    assert rs.hashes(places, pa.array(known, pa.binary())).tolist() == [zlib.crc32(s) for s in strings]
    assert len(rs.hashes([np.empty(0, np.int64)] * 3, pa.array([], pa.binary()))) == 0


def test_drawn_documents_are_like_the_target(spark):
    rng = np.random.default_rng(1)
    text = lambda i: " ".join(f"{'t' if i % 10 == 0 else 'o'}{k}" for k in rng.integers(0, 100, 60))
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    target = spark.createDataFrame([(i, text(0)) for i in range(30)], "item_id long, text string")
    drawn = [r.doc_id for r in rs.resample(spark, docs, target).collect() if r.rank]
    assert len(drawn) == 30 and sum(d % 10 == 0 for d in drawn) == 30


# -------------------------------------------------------------------------------------------------------------- manifest


def h(*nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def manifest(rows, arity=3):
    """doc_id, leaf, subroot, root, siblings' digest and path, by lists."""
    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row[0] is None, row[0] or 0, leaf_of(row)))

    def climb(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = p // arity * arity
                paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + arity])))
            nodes, at = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)], [p // arity for p in at]
        return nodes[0], paths

    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: (sorted(trees[s]), *climb([x[2] for x in sorted(trees[s])])) for s in order}
    root, above = climb([own[s][1] for s in order])
    return [(None if last else i, digest, own[s][1], root, path + above[k]) for k, s in enumerate(order) for (last, i, digest), path in zip(own[s][0], own[s][2])]


@pytest.mark.parametrize("height, top", [(7, 2_000), (2, 20), (1, 3), (3, 1)])
def test_manifest_is_brute_force(spark, docs, rows, height, top):
    # Few nodes for the driver make several passes, and more trees than it takes are joined by executors.
    found = mk.manifest(spark, docs, height=height, top=top).select("doc_id", "leaf", "subroot", "root", F.transform("path", lambda s: F.struct(s["left"], s["right"]))).collect()
    assert same([(*r[:4], tuple(map(tuple, r[4]))) for r in found], [(*r[:4], tuple(r[4])) for r in manifest(rows)])


def test_checks_find_what_was_tampered_with(spark, docs, rows):
    found = mk.checked(spark, docs).collect()
    expected = manifest(rows)
    assert same([r[:5] for r in found], [(*r[:4], h("".join(a + b for a, b in r[4]))) for r in expected])
    spoilt = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[4] or "")}
    assert spoilt and {r.doc_id for r in found if not r.verified} == spoilt
    assert all((r.folded_root == r.root) == r.verified for r in found)


def test_manifest_of_one_row_and_of_none(spark, docs, rows):
    one = mk.checked(spark, docs.where("doc_id = 4")).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == h("") and one.verified == (zlib.crc32(b"4") % 2 == 1)
    assert mk.checked(spark, docs.where("doc_id = -1")).collect() == []


# --------------------------------------------------------------------------------------------------------------- packing


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def test_packing_is_brute_force(spark, docs, rows):
    tokens = {}
    for r in rows:
        tokens.setdefault((r[0], r[4] or ""), [*library().encode(r[4] or "", add_special_tokens=False).ids, 0])
    found = pk.pack(spark, docs, default_vocabulary()).collect()
    expected = []
    for r in rows:
        ids, start = tokens[(r[0], r[4] or "")], 0
        for length in [1024] * (len(ids) // 1024) + [2**b for b in range(9, -1, -1) if len(ids) % 1024 >> b & 1]:
            expected.append((r[0], start, length, np.array(ids[start : start + length], "<u4").tobytes(), len(ids)))
            start += length
    assert same([(r.doc_id, r.start, r.length, bytes(r.ids), r.doc_tokens) for r in found], expected)
    assert sorted(r.sequence_id for r in found) == list(range(len(expected))) and {r.offset for r in found} == {0}
    by_number = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True)  # buckets lie one after the other
    short = pk.digests(spark, docs, default_vocabulary()).collect()
    assert same([(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in short], [(a, b, c, zlib.crc32(d), e) for a, b, c, d, e in expected])


def test_packing_of_none(spark, docs):
    assert pk.digests(spark, docs.where("doc_id = -1"), default_vocabulary()).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", "'s", "'ll", "é", "1", "23", ".", "!?", "日本", "\U0001f600", "<|endoftext|>", "<|", "é", "​"]), max_size=25).map("".join))
def test_stretches_give_the_library_s_ids(text):
    with open(default_vocabulary(), encoding="utf-8") as f:
        codec = pk.encoder(f.read())
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == codec.library.encode(text, add_special_tokens=False).ids


def test_remembered_stretches_are_bounded():
    with open(default_vocabulary(), encoding="utf-8") as f:
        codec = pk.Encoder(f.read(), remembered=10)
    for i in range(100):
        text = f"word{i} word{i // 3} again and again"
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == codec.library.encode(text, add_special_tokens=False).ids
    assert len(codec._known) + len(codec._older) < 40


def test_a_tokenizer_of_another_kind_is_encoded_whole():
    with open(default_vocabulary().replace("byte_bpe_50k", "word_bpe_49k"), encoding="utf-8") as f:
        definition = f.read()
    codec = pk.Encoder(definition)
    assert not codec.by_stretch and json.loads(definition)["model"]
    assert np.frombuffer(codec.encode("Some Text  here"), "<u4").tolist() == codec.library.encode("Some Text  here", add_special_tokens=False).ids


def test_lengths():
    assert pk.lengths(1) == [1] and pk.lengths(1024) == [1024] and pk.lengths(2049) == [1024, 1024, 1] and pk.lengths(1000) == [512, 256, 128, 64, 32, 8]


# ------------------------------------------------------------------------------------------------------------------- SQL


@pytest.mark.parametrize("name", ["op11_resampling", "op12_merkle"])
def test_sql_agrees(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = QUERIES[name](spark, sf_dir)
    answer = con.execute(ORACLE[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == sorted(found.columns)
    assert same([tuple(r[c] for c in names) for r in found.collect()], answer.fetchall())
