"""Operators on documents against brute-force versions, with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as ed
from tidemark.llm import minhash as mh
from tidemark.llm import mixing as mx
from tidemark.llm import ngram_lm as lm
from tidemark.llm import sentencepiece_codec as sp
from tidemark.llm.graded import sample
from tidemark.llm.ordinal import CumulativeLink
from tidemark.llm.quality import fit as quality_fit
from tidemark.llm.quality import quality, quality_features, quality_filter
from tidemark.llm.queries import default_model
from tidemark.llm.toxicity import fit as tox_fit
from tidemark.llm.toxicity import toxicity, word_features

SCHEMA = "doc_id long, text string, source string, kept string, `row` string, norm int, recipe string, size string, h int"


def words(n: int, seed: int, vocabulary: int = 500) -> list[str]:
    rng = np.random.default_rng(seed)
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def edited(base: list[str], n: int, seed: int) -> str:
    rng, out = np.random.default_rng(seed), list(base)
    for i in rng.choice(len(base), n, replace=False):
        out[i] = f"x{seed}_{i}"
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    base, other = words(300, 1), words(200, 2)
    texts: list[tuple[int | None, str | None, str | None]] = [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\r\x0b\x0c", "b"), (4, "One two", "b"), (5, "one  TWO", None), (6, "one two three four five", "é"), (7, "One two\nthree four FIVE ", "a"),
        (8, "one two", "a"), (9, "x" * 50_000, "a"), (10, "Straße ÄÖÜ straße", "Z"), (11, "straße ÄÖÜ straße", "Z"), (None, "no id at all here", "a"), (None, "no id at all here", None),
        (12, "same row twice over here", "a"), (12, "same row twice over here", "a"), (13, " ".join(words(30_000, 3)), "b"), (14, "\U0001f600 emoji 日本語 text", ""),
    ]
    texts += [(100 + i, " ".join(base), "hot") for i in range(40)]
    texts += [(200 + i, edited(base, i % 12, i), "hot") for i in range(60)]
    texts += [(300 + i, edited(other, 3, i) + "  " * (i % 3), "hot") for i in range(20)]
    texts += [(400 + i, " ".join(words(60, 1000 + i)), f"s{i % 3}") for i in range(40)]
    return [(*t, "k", "r", 1, "q", "s", 2) for t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


WHITE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("width", [0, 1, 2])
def test_exact_dedup(spark, docs, rows, width):
    got = ed.exact_dedup(spark, docs, width=width).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[WHITE.sub("", t or "")].append((len(t or ""), i))
    expected = Counter()
    for norm, members in groups.items():
        best = max(members, key=lambda m: (m[0], -(m[1] if m[1] is not None else 1 << 62)))[1]
        for _, i in members:
            expected[i, best, len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)  # one row of each group, repeated rows included
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_chunks_join_to_the_text(spark):
    text = "".join(f"Sentence number {i}. " for i in range(2000))
    row = spark.createDataFrame([(text.replace(" ", ""),), ("z" * 9000,)], "norm string").select("norm", ed.chunks(F.col("norm")).alias("c")).collect()
    for r in row:
        assert "".join(r.c) == r.norm
        assert max(map(len, r.c)) <= ed.MAX_CHUNK
    # A change at the front leaves later chunks as they are.
    changed = spark.createDataFrame([("X" * 37 + row[0].norm,)], "norm string").select(ed.chunks(F.col("norm")).alias("c")).first().c
    assert len(set(changed) & set(row[0].c)) > len(row[0].c) / 2


def brute_targets(sizes: dict, weights=(3, 1, 2)) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else share[s] for s in order}
        full |= over
        if len(full) == len(order):
            return {s: 2.0 * sizes[s] for s in order}


def test_mixing(spark, docs, rows):
    got = mx.mix(spark, docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals = Counter()
    for _, t, s, *_ in rows:
        totals[s] += size(t)
    target = brute_targets({s: totals[s] for s in {r[2] for r in rows}})
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.size * r.copies
    assert sorted((s, round(t, 6)) for s, t in by) == sorted({(totals[s], round(target[s], 6)) for s in target})
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    shared = Counter((totals[s], round(t, 6)) for s, t in target.items())
    for (size_, goal), members in by.items():
        n = shared[size_, round(goal, 6)]
        assert abs(sum(r.taken for r in members) - goal * n) <= max(r.size for r in members) * 2 * n
    assert Counter(map(tuple, got)) == Counter(map(tuple, mx.mix(spark, docs.repartition(3)).collect()))


def test_mixed_rows_follow_mix(spark, docs):
    taken = {(r.doc_id, r.size): r.copies for r in mx.mix(spark, docs).collect()}
    out = mx.mixed_rows(spark, docs)
    assert out.columns == docs.columns
    counts = Counter(r.doc_id for r in out.collect())
    for (i, size), copies in taken.items():
        if i is not None and i != 12:
            assert counts.get(i, 0) == (copies if size else 0)


def brute_components(sets: dict[int, set], percent: int = 85) -> dict[int, int]:
    label = {i: i for i in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in ids}


def shingles(text: str | None) -> set:
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 16)  # so that groups are cut into blocks
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    expected = brute_components(sets)
    got = mh.near_dedup(spark, docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id), r
    assert len(set(expected.values())) > 45


def test_documents_of_one_template_move_in_proportion(spark, monkeypatch):
    """Unlinked documents with a long template in common: signatures are moved a bounded number of times, no sets at all."""
    moved, sets = [], []
    paired, sets_of = mh._paired, mh._sets_of
    monkeypatch.setattr(mh, "_paired", lambda *a: moved.append(paired(*a)) or moved[-1])
    monkeypatch.setattr(mh, "_sets_of", lambda *a: sets.append(sets_of(*a)) or sets[-1])
    template = words(130, 77)
    for n in (1200, 6000):
        texts = [(i, " ".join(template + words(70, 10_000 + i, 50_000))) for i in range(n)]
        out = mh.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(4))
        assert out.where("kept").count() == n
        assert moved[-1].count() <= mh.STRIPS * n and sets[-1].count() <= n / 20
        moved.clear()


def test_a_template_alone_compares_no_sets(spark, monkeypatch):
    """Texts that share most of their words collide by the thousand, but post no shingle of the template; links among them are found."""
    base = words(140, 77, 100_000)
    own = lambda i: " ".join(base + words(40, 5000 + i, 10**9))
    texts = [(i, own(i)) for i in range(400)] + [(1000 + i, own(i) + " one more") for i in (3, 50, 51)]
    met, paired = [], mh._paired
    monkeypatch.setattr(mh, "_paired", lambda *a: met.append(paired(*a)) or met[-1])
    found = {r.doc_id: r.component_id for r in mh.near_dedup(spark, spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: i - 1000 if i >= 1000 else i for i, _ in texts}
    # Signatures of all meet once; only classes with a rare shingle in common meet with their sets.
    assert met[0].count() >= 400 and sum(m.count() for m in met[1:]) <= 6


@pytest.mark.parametrize(("block", "rows_", "bytes_"), [(4, 8, 2000), (1, 2, 100)])
def test_near_dedup_links_across_strips(spark, monkeypatch, block, rows_, bytes_):
    """Chains of edits, of which no star of a list sees all links, with small strips and chunks."""
    for name, value in (("BLOCK", block), ("STRIP_ROWS", rows_), ("STRIP_BYTES", bytes_), ("CHUNK_BYTES", 3000)):
        monkeypatch.setattr(mh, name, value)
    base, texts = words(200, 31), {}
    for i in range(60):
        j = int(np.random.default_rng(i).integers(0, 150))
        base = base[:j] + [f"new{i}", f"more{i}"] + base[j + 2 :]
        texts[(i * 37) % 101] = " ".join(base)
    texts |= {200 + i: " ".join(words(150, 5) + words(50, 600 + i)) for i in range(40)}
    expected = brute_components({i: shingles(t) for i, t in texts.items()})
    got = {r.doc_id: r.component_id for r in mh.near_dedup(spark, spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == expected


def test_signatures_estimate_similarity():
    base = words(2000, 5)
    a, b = mh.shingle_set(" ".join(base)), mh.shingle_set(edited(base, 30, 1))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((mh.signature(a) == mh.signature(b)).mean() - true) < 0.1


def test_sentencepiece(spark, docs, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = {i: t or "" for i, t, *_ in rows}
    full = {r.doc_id: r for r in sp.encoded(docs, default_model()).collect()}
    for r in sp.digests(docs, default_model()).collect():
        ids = model.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and full[r.doc_id].ids == ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert full[r.doc_id].decoded == model.decode(ids)


def test_words_are_segmented_without_the_mark_or_line_behind_them():
    """A word is remembered once, whatever follows it; ids are the library's."""
    codec = sp.Codec(open(default_model(), "rb").read())
    for text in ("tothwheaan, tothwheaan. tothwheaan; tothwheaan\ntothwheaan! x.y 3.14, a)b \n\n e.g. ª. don't…", "queè###&&& ñrr?\n,\n", "\n" * 40 + "interminablementeinterminablemente. end"):
        assert codec.encode(text)[0].tolist() == codec.library.encode(text, add_bos=True, add_eos=True)
    assert "▁tothwheaan" in codec._known and not any(s.startswith("▁tothwheaan") and len(s) > 11 for s in codec._known)


def test_spans_cover_the_text(spark):
    codec = sp.Codec(open(default_model(), "rb").read())
    for text in ("", "Hello  world", "日本語 \U0001f600!", " lead", "a\nb\t\x07"):
        ids, begins, ends = codec.encode(text)
        raw = text.encode()
        assert begins[0] == ends[0] == 0 and begins[-1] == ends[-1] == len(raw)
        assert (begins[1:] >= begins[:-1]).all() and (ends >= begins).all()
        covered = b"".join(raw[b:e] for b, e in zip(begins, ends))
        assert covered == raw


def test_character_map_takes_the_longest_prefix():
    """A trie of three entries, laid out by hand as the compiled form is: 'a' -> 'x', 'ab' -> 'yz', 'c' -> ' '."""
    strings = b"x\0yz\0 \0"
    units = np.zeros(1024, np.uint32)
    offset = lambda n: n << 10
    units[0] = offset(256)
    a, c = 256 ^ ord("a"), 256 ^ ord("c")
    units[a] = ord("a") | 1 << 8 | offset(a ^ 512)
    units[512] = 0 | 1 << 31
    ab = 512 ^ ord("b")
    units[ab] = ord("b") | 1 << 8 | offset(ab ^ 768)
    units[768] = 2 | 1 << 31
    units[c] = ord("c") | 1 << 8 | offset(c ^ 900)
    units[900] = 5 | 1 << 31
    blob = (len(units) * 4).to_bytes(4, "little") + units.tobytes() + strings
    cmap = sp.CharMap.parse(blob)
    assert cmap.longest(b"ab", 0) == (2, b"yz") and cmap.longest(b"ad", 0) == (1, b"x") and cmap.longest(b"d", 0) is None
    codec = sp.Codec.__new__(sp.Codec)
    codec.map, codec.trim, codec.dummy, codec.escape, codec.suffix = cmap, True, False, True, False
    out, source = codec.normalise("cabdca é ")
    assert out.decode() == "yzd▁x▁é"
    assert source.tolist() == [1, 1, 3, 4, 4, 4, 5, 6, 6, 6, 7, 7, 10]


def brute_lm(rows, strength, order=3):
    c, toks = Counter(), []
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    for i, t, *_ in rows:
        toks.append(["START", *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), "END"])
        if train(i):
            c.update(tuple(toks[-1][j : j + k]) for k in range(1, order + 1) for j in range(len(toks[-1]) - k + 1))
    single = {g[0]: k for g, k in c.items() if len(g) == 1 and g[0] != "START"}
    n, v = sum(single.values()), len(single)

    def p(gram):
        if len(gram) == 1:
            return (single.get(gram[0], 0) + 0.5) / (n + 0.5 * (v + 1))
        return (c[gram] + strength * p(gram[1:])) / (c[gram[:-1]] + strength)

    for (i, *_), own in zip(rows, toks):
        grams = [tuple(own[max(0, j - order + 1) : j + 1]) for j in range(1, len(own))]
        yield i, not train(i), len(own) - 1, sum(w in single for w in own[1:]), n, sum(math.log10(p((w,))) for w in own[1:]), sum(math.log10(p(g)) for g in grams)


@pytest.mark.parametrize(("order", "block", "hop", "segment"), [(1, 16_000_000, 10, 2048), (2, 2_000, 10, 2048), (3, 2_000, 3, 7), (4, 20_000, 2, 100)])
def test_language_model(spark, docs, rows, monkeypatch, order, block, hop, segment):
    for name, value in (("BLOCK_BYTES", block), ("HOP", hop), ("SEGMENT", segment), ("DISTRICT", 3)):
        monkeypatch.setattr(lm, name, value)
    got = sorted(map(tuple, lm.score(spark, docs, strength=7.0, order=order).collect()), key=str)
    expected = sorted(brute_lm(rows, 7.0, order), key=str)
    key = lambda r: (str(r[0]), r[2], r[5])
    for g, e in zip(sorted(got, key=key), sorted(expected, key=key), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9) and g[6] == pytest.approx(e[6], rel=1e-9)


def test_packed_keys_come_back():
    rng = np.random.default_rng(0)
    for keys in (np.empty(0, np.uint64), np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), np.array([0, 5, (1 << 64) - 1], np.uint64), np.zeros(3, np.uint64)):
        assert (lm._unpack_sorted(lm._pack_sorted(keys)) == keys).all() and (lm._unpack(lm._pack(keys)) == keys).all()


def test_rows_asked_follow_the_input():
    """A block sends at most a row for each prefix, and none without keys: what it sends does not depend on other blocks."""
    lengths = []
    for n in (1, 4):
        sent = 0
        for i in range(n):
            grams = lm.Grams(lm.Block.read(pa.array([" ".join(words(200, 10 * n + i, 50))]), pa.array([False])))
            level = grams.add()
            found = list(lm._by_prefix(2, level.keys[level.asked], level.own[level.asked], i, 6))
            assert all(len(lm._unpack(r["counts"])) for r in found)
            sent += len(found)
        lengths.append(sent)
    assert lengths[1] <= 4.4 * lengths[0] and lengths[0] <= 64


@pytest.mark.parametrize("history", ["", "a b", "a zz", "d c", "b a b"])
def test_model_sums_to_one(history):
    trained = ["a b a c", "b a", "a b c d"]
    tried = [f"{history} {w}".strip() for w in ("a", "b", "c", "d", "unknown")] + [history]
    grams = lm.Grams(lm.Block.read(pa.array(trained + tried), pa.array([False] * len(trained) + [True] * len(tried))))
    levels = [grams.levels[0], grams.add(), grams.add()]
    model, total = lm.Automaton(levels, 13, 5, 5.0), 0.0
    for start in grams.starts[len(trained) :]:
        depth = np.array([1])
        for i in range(1, len(history.split()) + 2):
            weight, depth = model.step(np.array([start + i]), depth)
        total += 10 ** weight[0]
    assert total == pytest.approx(1)


def test_copies_are_told_apart(spark):
    """Training texts that occur twice gain more on the base than most that occur once, far more often than by chance (0.1)."""
    rng = np.random.default_rng(3)
    common = rng.zipf(1.3, 400_000)
    texts = [" ".join(f"v{x}" for x in common[i * 200 : (i + 1) * 200]) for i in range(1500)]
    rows = [(i, texts[i]) for i in range(1500)] + [(2000 + i, texts[i]) for i in range(60)]
    out = lm.score(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("not held_out").collect()
    trained = {r.doc_id for r in out}
    gain = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in out}
    twice = [gain[i] for i in range(60) if i in trained and 2000 + i in trained]
    once = [gain[i] for i in range(60, 1500) if i in trained]
    assert np.mean(np.array(twice) > np.quantile(once, 0.9)) > 0.3


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        g = rng.integers(0, 3)
        rows.append(np.unique(np.r_[rng.integers(10, 60, 5), np.arange(g)]).astype(np.int32))
        grades.append(g)
    model = CumulativeLink.fit(rows[:400], np.array(grades[:400]), 3, 64)
    assert (np.diff(model.thresholds) > 0).all()
    expected = np.array([model.tails(r).sum() for r in rows[400:]])
    assert (np.round(expected) == grades[400:]).mean() > 0.9
    assert CumulativeLink.fit([], np.array([]), 3, 8).tails(np.array([1])).shape == (2,)


def test_fit_is_a_minimum_of_the_penalised_likelihood():
    """Against an independent form of the loss: its numeric gradient vanishes, and no tried change of a parameter lowers it."""
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(6) < 0.4).astype(np.int32) for _ in range(300)]
    true = np.array([1.5, -1.0, 0.5, 0, 2.0, -0.5])
    grades = np.array([int(true[r].sum() + rng.logistic() > 0) + int(true[r].sum() + rng.logistic() > 2) for r in rows])
    l2 = 1e-3
    model = CumulativeLink.fit(rows, grades, 3, 6, l2=l2, rounds=4000, rate=0.02)

    def loss(x):
        total = 0.0
        for r, g in zip(rows, grades):
            s = sum(x[j] for j in r)
            below = [0.0, *(1 / (1 + math.exp(-(t - s))) for t in x[6:]), 1.0]
            total -= math.log(below[g + 1] - below[g])
        return total / len(rows) + l2 / 2 * sum(w * w for w in x[:6])

    at = np.r_[model.weights.astype(float), model.thresholds]
    for i in range(8):
        step = np.zeros(8)
        step[i] = 1e-4
        assert abs(loss(at + step) - loss(at - step)) / 2e-4 < 2e-3
        assert loss(at + 100 * step) > loss(at) and loss(at - 100 * step) > loss(at)


def brute_tail(model, features, k):
    return 1 - 1 / (1 + math.exp(-(model.thresholds[k - 1] - math.fsum(float(model.weights[j]) for j in set(features)))))


def test_classifiers_score_every_row_as_their_models_say(spark, docs, rows):
    """Each row's tails and decisions, worked out again from the fitted weights with features built anew."""
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in [*range(1, 15), *range(100, 140), *range(200, 260), *range(400, 440)]], "doc_id long, quality int, toxic int")
    plain = docs.select("doc_id", "text")
    tox, qual = tox_fit(plain, labels), quality_fit(plain, labels)
    letters = re.compile(r"[^\W\d_]+")

    def features(t):
        found = set(letters.findall(t.lower()))
        found |= {w[:4] + "-" for w in found if len(w) > 4}
        return {zlib.crc32(w.encode()) % (1 << 20) for w in found}

    expected = Counter()
    for i, t, *_ in rows:
        p1, p2 = (brute_tail(tox, features(t or ""), k) for k in (1, 2))
        expected[i, round(p1 + p2, 6), p1 >= 0.4] += 1
    assert Counter((r.doc_id, round(r.expected_severity, 6), r.toxic) for r in toxicity(docs, labels).collect()) == expected
    expected = Counter()
    for i, t, *_ in rows:
        p1, p2 = (brute_tail(qual, quality_features(t or "").tolist(), k) for k in (1, 2))
        expected[i, round(p1 + p2, 6), p1 >= 0.5] += 1
    assert Counter((r.doc_id, round(r.expected_grade, 6), r.kept) for r in quality(docs, labels).collect()) == expected


def test_samples_of_classifiers_are_bounded(spark):
    many = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert sample(many, labels, F.col("toxic"), 1).count() <= 1 and sample(many, labels, F.col("toxic"), 3).count() == 2


def test_toxicity_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = toxicity(d, train).withColumnRenamed("toxic", "flagged").join(held, "doc_id")
    by = {r.toxic: r for r in scored.groupBy("toxic").agg(F.count("*").alias("n"), F.avg("expected_severity").alias("s"), F.count_if("flagged").alias("hit")).collect()}
    assert by[1].hit >= 0.85 * by[1].n and by[0].hit <= 0.01 * by[0].n and by[1].s > 10 * by[0].s


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    r = {x.quality: x for x in quality(d, train).join(held, "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert r[1].kept >= 0.99 * r[1].n and r[0].kept <= 0.15 * r[0].n


def test_classifiers_take_odd_rows(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, None), (None, 0, 1), (5, 0, 1), (5, 1, 0), (9999, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert toxicity(docs, labels).count() == quality(docs, labels).count() == len(rows)
    assert toxicity(docs, none).where("toxic").count() == 0 and quality(docs, none).where("not kept").count() == 0
    assert quality_filter(docs, none).columns == docs.columns and quality_filter(docs, none).count() == len(rows)
    assert toxicity(empty, labels).count() == quality(empty, labels).count() == 0
    assert len(word_features("")) == 0


def test_empty_tables(spark, empty):
    assert ed.exact_dedup(spark, empty).count() == 0
    assert mx.mix(spark, empty).count() == 0 and mx.mixed_rows(spark, empty).count() == 0
    assert mh.near_dedup(spark, empty).count() == 0
    assert sp.digests(empty, default_model()).count() == sp.encoded(empty, default_model()).count() == 0
    assert lm.score(spark, empty).count() == 0


def test_native_operators_run_no_python(spark, docs):
    for frame in (ed.exact_dedup(spark, docs), mx.mix(spark, docs)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
