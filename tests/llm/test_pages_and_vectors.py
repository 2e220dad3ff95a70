"""Packages, page texts and vectors against brute-force versions and round trips."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from tidemark.llm import embedding_dedup as ed
from tidemark.llm import html_text as ht
from tidemark.llm import warc_zip as wz

PAGES = "page_id long, url string, html string, payload int, digest string, text string, host int, `row` string"


@pytest.fixture(scope="module")
def pages(spark):
    long, odd = "<p>" + "word " * 60_000 + "</p>", "<p>ä\x00\U0001f600</p>" * 20
    rows = [(1, "http://a.org/x", None), (2, None, ""), (3, "http://a.org/\r\ny z", long), (4, "http://b.org", odd), (5, "http://b.org", odd), (5, "http://b.org", odd), (6, "u", "short"), (7, "u", "short"), (None, "http://b.org", odd), (8, "nohost", long)]
    rows += [(100 + i, f"http://hot.org/{i}", odd) for i in range(50)]
    return spark.createDataFrame([(*r, 1, "d", "t", 2, "r") for r in rows], PAGES).repartition(4).cache()


def test_round_trip(spark, pages):
    got = sorted(map(tuple, wz.round_trip(spark, pages).collect()), key=str)
    first: dict[str, int] = {}
    rows = pages.collect()
    for r in rows:
        if r.page_id is not None and len((r.html or "").encode()) >= 100:
            first[r.html] = min(first.get(r.html, r.page_id), r.page_id)
    expected = []
    for r in rows:
        raw = (r.html or "").encode()
        to = first.get(r.html) if len(raw) >= 100 else None
        to = None if to == r.page_id else to
        expected.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(expected, key=str)


def test_payloads_and_urls_come_back(spark, pages):
    folder = wz.new_folder(spark, "test")
    manifest = wz.write_packages(spark, pages, folder)
    records = {r.page_id: r for r in wz.read_packages(manifest, folder, 3).where("page_id < 100").collect()}
    for r in pages.where("page_id < 100").collect():
        if records[r.page_id].record_type == "response":
            assert bytes(records[r.page_id].payload).decode() == (r.html or "")
    assert records[3].url == "http://a.org/%0D%0Ay%20z" and records[2].url == ""
    assert manifest.agg({"records": "sum"}).first()[0] == pages.count()


@pytest.mark.parametrize("zip64", [True, False])
def test_zip_files_are_zip_files(zip64):
    data = [("archive/data.warc.gz", b"abc" * 1000), ("indexes/index.cdxj", "ü x\n".encode())]
    raw = b"".join(wz.zip_bytes(data, zip64))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == data
    f = io.BytesIO(raw)
    found = wz.members(f, len(raw))
    for m, (name, content) in zip(found, data, strict=True):
        start = wz.data_offset(f, m)
        assert m.name == name and raw[start : start + m.size] == content


def test_reads_zip_files_of_others_with_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("b", b"packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    raw = out.getvalue()
    f = io.BytesIO(raw)
    a, b = wz.members(f, len(raw))
    assert raw[wz.data_offset(f, a) :][: a.size] == b"stored"
    with pytest.raises(ValueError, match="compressed"):
        wz.data_offset(f, b)
    with pytest.raises(ValueError, match="not a ZIP"):
        wz.members(io.BytesIO(b"x" * 50), 50)


def test_empty_pages(spark, pages):
    none = pages.limit(0)
    assert wz.round_trip(spark, none).count() == 0 and ht.extract(spark, none).count() == 0


def test_blocks():
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body class="x"><nav>menu</nav><div class="cookie-notice">we use</div>
    <article><header>by me</header><h1>Head &amp;\n line</h1><p>one <b>two</b><br>three<p>four<script>x</script>five<div id="comments"><p>first!</p></div><ul><li>a<li>b</ul>
    <aside>side</aside><form><p>mail</p></form></article><footer>foot</footer><p hidden>no</p></body>"""
    by = {k: [t for r, t in ht.blocks(page) if r == k] for k in (0, 1, 2)}
    assert by[0] == ["Head & line", "one two three", "fourfive", "a", "b"]
    assert by[1] == [] and set(by[2]) >= {"menu", "we use", "by me", "first!", "side", "mail", "foot", "no"}
    assert ht.blocks("") == [] and ht.blocks("<p>never closed <a href='x") == [(1, "never closed")]
    assert ht.blocks('<p>a <b title="x>y">c</b> </ > d <i class="q>e') == [(1, "a c d e")]
    assert ht.blocks("a < b <!-- c --> d") == [(1, "a < b d")]


def test_suffix_order_against_sorting():
    rng = np.random.default_rng(3)
    tokens = rng.integers(0, 3, 200)
    order, rank = ht.suffix_order(tokens, 3)
    cut = [tuple(tokens[i : i + 8]) for i in range(200)]
    assert [cut[i] for i in order] == sorted(cut)
    assert all((rank[i] == rank[j]) == (cut[i] == cut[j]) for i in range(0, 200, 7) for j in range(0, 200, 11))


def test_repeated_against_brute_force():
    rng = np.random.default_rng(4)
    pages = np.sort(rng.integers(0, 6, 400))
    tokens = rng.integers(0, 40, 400)
    for at in (10, 150, 333):
        tokens[at : at + 12] = np.arange(100, 112)
    covered = np.zeros(400, bool)
    runs: dict[tuple, list[int]] = {}
    for i in range(393):
        runs.setdefault(tuple(tokens[i : i + 8]), []).append(i)
    for at in runs.values():
        if len({pages[i] for i in at}) > 1:
            for i in at:
                covered[i : i + 8] = True
    assert (ht.repeated(tokens, pages) == covered).all() and covered.sum() >= 36


def test_extract_removes_boilerplate_of_hosts(spark, pages):
    plate = "all rights reserved by the people of this little site here"
    own = [f"page {i} has its own text with number {i} and nothing that others have {i * 7}" for i in range(20)]
    rows = [(i, f"http://h.org/{i}", f"<div>{plate}</div><p>{own[i]}</p><div>{plate} again</div>") for i in range(20)]
    rows += [(50, "http://h.org/50", f"<article><p>{plate}</p></article>"), (60, "http://other.org/", f"<div>{plate}</div>")]
    got = {r.page_id: r for r in ht.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i].text for i in range(20)] == own
    assert got[50].text == plate and got[60].text == plate and got[60].n_chars == len(plate)
    out = ht.extract(spark, pages)
    assert out.count() == pages.count() and out.where("text is null or n_chars <> length(text)").count() == 0


def brute_links(vectors: dict[int, list | None]):
    ok = {i: np.array(v, float) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.9} if i in ok else set() for i in vectors}
    label = {}
    for i in sorted(vectors):
        if i not in label:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = i
                    todo += links[x]
    return {i: (len(links[i]), label[i]) for i in vectors}


@pytest.mark.parametrize(("strips", "size"), [(1, 1 << 20), (6, 1 << 20), (3, 24 * 64)])
def test_embedding_links(spark, monkeypatch, strips, size):
    monkeypatch.setattr(ed, "STRIPS", strips)
    monkeypatch.setattr(ed, "STRIP_BYTES", size)
    monkeypatch.setattr(ed, "TILE", 8)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 16))
    vectors: dict[int, list | None] = {i: np.float32(centers[i % 6] + rng.normal(size=16) * (0.05 * (i % 9))).tolist() for i in range(200)}
    vectors |= {300 + i: vectors[0] for i in range(30)} | {400: (np.float32(vectors[1]) * 8).tolist(), 401: None, 402: [0.0] * 16, 403: [float("nan")] * 16, 404: [None] + [1.0] * 15, 405: [float("inf")] + [0.0] * 15, 406: [], 407: [1.0, 0.0], 408: [1.0, 0.1], 409: [-0.0, 1.0]}
    df = spark.createDataFrame([(i, v, "c", 3) for i, v in vectors.items()], "vec_id long, embedding array<float>, class string, size int").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_dedup(spark, df).collect()}
    assert got == brute_links(vectors)
    assert ed.near_dedup(spark, df.limit(0)).count() == 0


def test_repeated_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ed.near_dedup(spark, df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 2, True), (None, 1, 2, False)], key=str)


def test_vectors_in_double_precision_stay_so(spark):
    angle = np.arccos(0.9) - 1e-10
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [float(np.cos(angle)), float(np.sin(angle))], "y"), (3, [0.89, 0.46], "z")], "vec_id long, embedding array<double>, VEC_ID string")
    got = {r[0]: r[1:] for r in ed.near_dedup(spark, df).collect()}
    assert got == {1: (1, 1, True), 2: (2, 1, False), 3: (1, 1, False)}


def test_strips_are_moved_a_bounded_number_of_times(spark, monkeypatch):
    """Strip pairs don't grow with the table as long as strips are below their bound."""
    pairs = []
    found = ed._pairs
    monkeypatch.setattr(ed, "_pairs", lambda *a: pairs.append(found(*a)) or pairs[-1])
    rng = np.random.default_rng(1)
    for n in (300, 1500):
        df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(n)], "vec_id long, embedding array<float>")
        ed.near_dedup(spark, df)
    assert all(p.count() <= ed.STRIPS * (ed.STRIPS + 1) // 2 for p in pairs)


def texts_of(spark, rows):
    """Texts by page id."""
    out = ht.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    return {r.page_id: r.text for r in out.collect()}


def some_words(i, n=30):
    return " ".join(f"w{(i * 7919 + k * 104729) % 1_000_003}" for k in range(n))


def test_copies_and_quotes_stay_and_runs_are_cut(spark):
    plate, quote = some_words(900, 12), some_words(901, 20)
    rows = [(i, f"http://copies.org/{i}", f"<p>{some_words(1)}</p><p>{some_words(2)}</p>") for i in range(5)]
    rows += [(10 + i, f"http://h.org/{i}", f"<p>{some_words(10 + i)}</p>" + (f"<p>{quote} end</p>" if i < 2 else "") + f"<div>own{i} {plate} tail{i}</div>") for i in range(8)]
    got = texts_of(spark, rows)
    assert {got[i] for i in range(5)} == {f"{some_words(1)}\n{some_words(2)}"}
    for i in range(8):
        assert got[10 + i] == "\n".join([some_words(10 + i), *([f"{quote} end"] if i < 2 else []), f"own{i} tail{i}"])


def test_pages_with_articles_keep_open_text_and_lose_boilerplate(spark):
    plate, shared = some_words(902, 12), some_words(903, 12)
    page = lambda i: f"<article>teaser {i}</article><div>{some_words(20 + i)}</div><main><p>{plate}</p><p>{some_words(50 + i)}" + (f" {shared}" if i % 2 else "") + f"</p></main><div>{plate}</div>"
    got = texts_of(spark, [(i, f"http://h.org/{i}", page(i)) for i in range(8)] + [(9, "http://x.org/", "<article>card</article><div>real text</div>")])
    for i in range(8):
        body = some_words(50 + i) + (f" {shared}" if i % 2 else "")
        assert got[i] == f"teaser {i}\n{some_words(20 + i)}\n{body}"
    assert got[9] == "card\nreal text"


def test_shards_do_not_change_texts(spark, monkeypatch):
    plate, quote, half = some_words(904, 12), some_words(905, 12), some_words(906, 12)
    rows = [(i, f"http://h.org/{i}", f"<p>{some_words(100 + i)}</p><div>{plate}</div>" + f"<p>{quote}</p>" * (i % 3 == 0) + f"<p>{half}</p>" * (i % 3 > 0) + f"<article>{some_words(200 + i)} {plate}</article>" * (i % 5 < 2)) for i in range(40)]
    rows += [(50 + i, f"http://h.org/{i}", rows[2][2]) for i in range(9)] + [(7, "http://h.org/v", f"<p>version {plate}</p>"), (None, "http://h.org/n", f"<p>no id {plate}</p>")]
    whole = texts_of(spark, rows)
    assert plate not in whole[0] and quote in whole[0] and half not in whole[1] and some_words(200) in whole[0] and whole[50] == whole[2] and whole[None] == "no id"
    monkeypatch.setattr(ht, "HOST_PAGES", 4)
    assert texts_of(spark, rows) == whole


class PlainParser(HTMLParser):
    """A second parser, for well-formed pages: (region, text) of blocks by the elements around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.found, self.held = [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        if text:
            kinds = {k for _, k in self.stack}
            self.found.append((2 if "chrome" in kinds else 0 if "article" in kinds else 1, text))
        self.held.clear()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
            return
        kind = "chrome" if tag in ("nav", "footer", "aside", "form", "script", "style", "head") or dict(attrs).get("class") in ("ad", "comments", "cookie-notice") else "article" if tag in ("article", "main") else ""
        if tag not in ("b", "a", "i", "script", "style"):
            self.flush()
        self.stack.append((tag, kind))

    def handle_endtag(self, tag):
        if tag not in ("b", "a", "i", "script", "style"):
            self.flush()
        assert self.stack.pop()[0] == tag

    def handle_data(self, data):
        if not self.stack or self.stack[-1][0] not in ("script", "style", "title"):
            self.held.append(data)


def brute_texts(rows):
    """Main texts by the definition: runs of 8 words that are on enough distinct pages of a host, counted in dictionaries."""
    parsed, out = {}, {}
    for i, url, html in rows:
        parser = PlainParser()
        parser.feed(html)
        parser.flush()
        parsed[i] = parser.found
    runs = lambda words: {tuple(words[j : j + 8]) for j in range(len(words) - 7)}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        own = [i for i, u, _ in rows if u.split("/")[2] == host]
        streams = {i: tuple(tuple(w for r, t in parsed[i] if r == k for w in t.split()) for k in (0, 1, 2)) for i in own}
        pages = {(x[:2] if x[0] or x[1] else x): x for x in streams.values() if any(x)}
        plates = []
        for kinds, percent, least, some in (((0,), 90, 4, [x for x in pages.values() if x[0]]), ((1, 2), 50, 3, list(pages.values()))):
            n = Counter(r for x in some for r in set().union(*(runs(x[k]) for k in kinds)))
            plates.append({r for r, c in n.items() if c >= max(least, -(-percent * len(some) // 100))})
        for i in own:
            drop, inner, at = {}, {}, {}
            for k in (0, 1):
                words = [(b, w) for b, (r, t) in enumerate(parsed[i]) if r == k for w in t.split()]
                drop[k], inner[k], at[k] = [False] * len(words), [False] * len(words), 0
                for j in range(len(words) - 7):
                    if tuple(w for _, w in words[j : j + 8]) in plates[k]:
                        drop[k][j : j + 8] = [True] * 8
                        if words[j][0] == words[j + 7][0]:
                            inner[k][j : j + 8] = [True] * 8
            texts = []
            for r, t in parsed[i]:
                if r < 2:
                    here = slice(at[r], at[r] + len(t.split()))
                    at[r] = here.stop
                    if not all(drop[r][here]):
                        texts.append(" ".join(w for w, x in zip(t.split(), inner[r][here]) if not x) if any(inner[r][here]) else t)
            out[i] = "\n".join(texts)
    return out


@pytest.mark.parametrize("host_pages", [1000, 23])
def test_extract_against_a_second_parser_and_dictionaries(spark, monkeypatch, host_pages):
    monkeypatch.setattr(ht, "HOST_PAGES", host_pages)
    rng = np.random.default_rng(12)
    plates = [some_words(2000 + k, int(rng.integers(8, 30))) for k in range(4)]
    bits = [f"all rights reserved &copy; {some_words(2100, 9)}", *plates]

    def page(i):
        parts = [f"<nav><ul><li>home</li><li>{bits[0]}</li></ul></nav>"]
        for k in range(int(rng.integers(1, 6))):
            own = some_words(10_000 + 10 * i + k, int(rng.integers(1, 40)))
            kind, with_plate = rng.choice(["article", "main", "div", "p", "ad", "quote"]), rng.random() < 0.6
            inside = f"{own} {bits[rng.integers(0, 5)]} tail" if with_plate else f"<p>{own} &amp; <b>bold</b></p>\n <p>x<br>y {k}</p>"
            if kind == "quote":
                inside = f"<p>{some_words(3000 + i % 7, 20)} {own}</p>"
            parts.append(f"<div class='ad'>{inside}</div>" if kind == "ad" else f"<div>{inside}</div>" if kind == "quote" else f"<{kind}>{inside}</{kind}>" if kind != "p" or with_plate else f"<div>{inside}</div>")
        return f"<html><head><title>t</title><script>var a = 1;</script></head><body>{''.join(parts)}<div>{bits[1]}</div><footer>{bits[0]}</footer></body></html>"

    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 9}'}.org/{i}", page(i)) for i in range(240)]
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(0, 60, 4)]
    assert texts_of(spark, rows) == brute_texts(rows)


@pytest.mark.parametrize("start", ["<body class='no-sidebar'>", "<body class='single comments-open'>", "<main class='with-sidebar'>", "<article class='related-news'>", "<article id='comments'>", "<html class='sidebar'>", "<div class='has-sidebar no-ads'>"])
def test_main_elements_and_longer_names_are_not_chrome(start):
    assert [(r < 2, t) for r, t in ht.blocks(f"{start}<p>text</p>")] == [(True, "text")]


@pytest.mark.parametrize("name", ["ad", "box cookie-notice", "site_footer", "main-nav", "related-posts", "Comments-Area", "sidebar__widget"])
def test_known_names_are_chrome(name):
    assert ht.blocks(f"<main><div class='{name}'>menu</div>text</main>") == [(2, "menu"), (0, "text")]
