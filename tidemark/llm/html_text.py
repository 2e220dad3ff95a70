"""Main text of web pages, with suffix arrays over the pages of each host that find its boilerplate.

A page is cut into blocks of text.  A block is *article* inside an article or main element, *chrome* inside menus,
headers, footers, sidebars, notices, adverts, forms and reader comments, and *open* anywhere else.  The text of a page is
its article and open blocks in page order, less the runs of ``RUN`` tokens or more that are boilerplate of its host: blocks
that such runs cover as a whole go, out of other blocks the runs inside are cut, and all other tokens stay.  In open blocks a run is boilerplate if it is in open blocks or chrome
of half of the host's distinct pages, and of three at least.  In articles it must be in the articles of nine tenths of
the distinct pages that have one, and of four at least, as passages that articles share belong to the text.

The token streams of a host's pages are concatenated, and a suffix array, sorted by the first ``RUN`` tokens of each
suffix, shows on how many distinct pages a run is.  Large hosts are dealt into shards by a hash of the stream.  A run that
is on its share of all pages is on that share in some shard, so what reaches it in a shard is a candidate; candidates are
then counted in all shards of the host, and the sums decide.  So the number of shards can't change a result.

Pages are parsed twice, once for the hosts' runs and once for the texts; no text is moved or written in between.

Defined cases: null or empty html, or html without text, gives an empty text; a null or hostless URL belongs to the
host ''; pages of a host whose article and open tokens are equal are one distinct page, whatever their ids, and so are the
versions of one id; hosts of one or two distinct pages lose nothing but chrome; columns other than page_id, url and html
are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import _mix
from .scratch import narrowed, slices, spread, table

RUN_DOUBLINGS = 3
RUN = 1 << RUN_DOUBLINGS
#: Pages and characters of html in a shard, about.
HOST_PAGES, HOST_CHARS = 1000, 16 << 20
#: By region: percent of a host's distinct pages that a run of boilerplate is on, and how many at least.
SHARE, LEAST = (90, 50), (4, 3)

# Names of HTML elements by their role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ARTICLE = {"article", "main"}
MAIN = ARTICLE | {"html", "body"}
CHROME = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "template", "svg", "canvas", "object", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# Whole names in class, id and role that mark what isn't main text, and compounds that are known to.
CHROME_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "sponsor", "sponsored", "subscribe", "widget"}
CHROME_COMPOUNDS = {f"{a}-{b}" for a in ("ad", "ads", "advert", "banner", "breadcrumb", "comment", "comments", "cookie", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "promo", "share", "sharing", "sidebar", "sponsor", "subscribe", "widget") for b in ("area", "banner", "bar", "block", "box", "button", "buttons", "consent", "container", "form", "links", "list", "menu", "notice", "popup", "section", "signup", "slot", "unit", "widget", "widgets", "wrap", "wrapper")}
CHROME_COMPOUNDS |= {f"{a}-{b}" for a in ("bottom", "footer", "global", "left", "main", "mobile", "page", "primary", "right", "secondary", "side", "site", "sub", "top") for b in ("ad", "ads", "banner", "breadcrumbs", "footer", "menu", "nav", "navbar", "navigation", "sidebar")}
CHROME_COMPOUNDS |= {f"related-{b}" for b in ("articles", "content", "links", "news", "pages", "posts", "reading", "stories")} | {"breadcrumb-trail", "comment-respond", "comments-section", "disqus-thread", "gdpr-cookie", "legal-disclaimer", "social-share", "social-sharing"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<(?![a-zA-Z/!?]))", re.S)
_BROKEN = re.compile(r"<[^>]*>?")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"[\s ]+")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: Tokens are below; from here on they end a stream.
_END = 1 << 32


def _is_chrome(name: str, attributes: str) -> bool:
    if name in CHROME:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if key.lower() in ("class", "id", "role"):
            if name not in MAIN and any(w in CHROME_WORDS or w in CHROME_COMPOUNDS for w in re.sub("[_-]+", "-", value.lower()).split()):
                return True
        elif key.lower() == "hidden" or (key.lower() == "style" and re.search(r"display\s*:\s*none", value)):
            return True
    return False


def blocks(html: str) -> list[tuple[int, str]]:
    """(region, text) of a page's blocks in page order; region 0 is article, 1 open and 2 chrome."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    region, skip_to, at = 1, None, 0

    def flush() -> None:
        if pieces:
            text = _WHITE.sub(" ", entities.unescape("".join(pieces))).strip()
            if text:
                found.append((region, text))
            pieces.clear()

    while at < len(html):
        if skip_to is not None:
            stop = re.compile(rf"</{skip_to}(?=[\s/>])", re.I).search(html, at)
            at, skip_to = (stop.start() if stop else len(html)), None
            continue
        m = _TOKEN.match(html, at)
        if m is None:  # a tag with an open quote, or one that never ends
            at = _BROKEN.match(html, at).end()
            continue
        at = m.end()
        if m[5] is not None:
            pieces.append(m[5])
        elif m[1] is not None:
            pieces.append(entities.escape(m[1]))
        elif m[3] is not None:
            name = m[3].lower()
            if m[2]:
                if opened[name]:
                    if name in BLOCKS:
                        flush()
                    elif stack[-1][0] != name and region != _outer(stack, name):
                        flush()
                    while (closed := stack.pop()[0]) != name:
                        opened[closed] -= 1
                    opened[name] -= 1
                    region = stack[-1][1] if stack else 1
                elif name in BLOCKS:
                    flush()
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name in BLOCKS:
                flush()
            if name in VOID:
                continue
            if name in RAW:
                skip_to = name
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                stack.pop()
                opened[name] -= 1
                region = stack[-1][1] if stack else 1
            inner = 2 if region == 2 or _is_chrome(name, m[4]) else 0 if name in ARTICLE or region == 0 else region
            if inner != region:
                flush()
            if not m[4].endswith("/") or name in BLOCKS:
                stack.append((name, inner))
                opened[name] += 1
                region = inner
    flush()
    return found


def _outer(stack: list[tuple[str, int]], name: str) -> int:
    """The region outside the innermost open element of a name."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            return stack[i - 1][1] if i else 1
    return 1


def suffix_order(tokens: np.ndarray, doublings: int = RUN_DOUBLINGS) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a token stream by prefix doubling, sorted by the first 2 ** doublings tokens.

    Suffixes with equal ranks agree in that many tokens."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    width, n = 1, len(tokens)
    for _ in range(doublings):
        ahead = np.full(n, -1, np.int64)
        ahead[: max(0, n - width)] = rank[width:]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width *= 2
    return np.argsort(rank, kind="stable"), rank


def distinct_pages(tokens: np.ndarray, pages: np.ndarray, doublings: int = RUN_DOUBLINGS) -> np.ndarray:
    """On how many distinct pages the run of 2 ** doublings tokens from each place on occurs; 0 where no whole run begins."""
    run, n = 1 << doublings, len(tokens)
    if n < run:
        return np.zeros(n, np.int64)
    order, rank = suffix_order(tokens, doublings)
    ranks, page = rank[order], np.unique(pages, return_inverse=True)[1][order]
    both = np.unique(ranks * (int(page.max()) + 1) + page) // (int(page.max()) + 1)
    counts = np.bincount(both, minlength=int(ranks[-1]) + 1)[rank]
    counts[_covered_backwards(tokens >= _END, run)] = 0
    return counts


def _covered_backwards(ends: np.ndarray, run: int) -> np.ndarray:
    """Places whose run goes over an end or beyond the last token."""
    upto = np.concatenate([[0], np.cumsum(ends)])
    last = np.arange(len(ends)) + run
    return (last > len(ends)) | (upto[np.minimum(last, len(ends))] > upto[:-1])


def _covered(starts: np.ndarray, n: int, run: int) -> np.ndarray:
    """Marks of n tokens: those in a run that begins at one of ``starts``."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + run, -1)
    return np.cumsum(edges[:-1]) > 0


def repeated(tokens: np.ndarray, pages: np.ndarray, doublings: int = RUN_DOUBLINGS, least: int = 2) -> np.ndarray:
    """Marks the tokens covered by a run of 2 ** doublings tokens or more that occurs on ``least`` distinct pages."""
    return _covered(np.flatnonzero(distinct_pages(tokens, pages, doublings) >= least), len(tokens), 1 << doublings)


def run_hashes(tokens: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of RUN tokens, by where they begin."""
    n = len(tokens) - RUN + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(RUN if n > 0 else 0):
        out = _mix(out + tokens[i : i + n].astype(np.uint64))
    return out.view(np.int64)


def _tokens(texts: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for t in texts for w in t.split()], np.uint32)


def _regions(html: str | None) -> tuple[list[str], list[str], list[str]]:
    by: tuple[list[str], ...] = ([], [], [])
    for region, text in blocks(html or ""):
        by[region].append(text)
    return by


def _page(streams: list[bytes], version_of: int | None) -> int:
    """What names a distinct page: its id's key if the id has versions, or else its article and open tokens."""
    if version_of is not None:
        return version_of
    import xxhash

    named = streams[:2] if streams[0] or streams[1] else streams
    return xxhash.xxh3_64_intdigest(b"".join(len(x).to_bytes(8, "big") + x for x in named)) >> 1


_STREAMS = "host string, shard int, shards int, page long, article binary, open binary, chrome binary"
_STREAMS_ARROW = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("shards", pa.int32()), ("page", pa.int64()), ("article", pa.binary()), ("open", pa.binary()), ("chrome", pa.binary())])


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The token streams of (host, shards, version_of, html) by region; of equal pages a task sends one."""
    import xxhash

    seen: set[bytes] = set()
    for batch in batches:
        rows = []
        for host, shards, version_of, html in zip(*(c.to_pylist() for c in batch.columns)):
            streams = [_tokens(texts).tobytes() for texts in _regions(html)]
            page = _page(streams, version_of)
            whole = xxhash.xxh3_128_digest(b"".join(len(x).to_bytes(8, "big") + x for x in (host.encode(), page.to_bytes(8, "big"), *streams)))
            if whole not in seen and any(streams):
                seen.add(whole)
                rows.append({"host": host, "shard": page % shards, "shards": shards, "page": page, "article": streams[0], "open": streams[1], "chrome": streams[2]})
        yield pa.RecordBatch.from_pylist(rows, _STREAMS_ARROW)


def _least(region: int, pages: int, whole: bool) -> int:
    """On how many of so many distinct pages a run must be; of a shard's pages, to be a candidate."""
    return max(LEAST[region] if whole else 1, -(-SHARE[region] * pages // 100))


_FOUND = "host string, shards int, region int, pages long, runs array<long>"
_FOUND_ARROW = pa.schema([("host", pa.string()), ("shards", pa.int32()), ("region", pa.int32()), ("pages", pa.int64()), ("runs", pa.list_(pa.int64()))])


def _frequent(group: pa.Table) -> pa.Table:
    """Distinct pages of a host's shard and the runs on enough of them, for articles (0) and for what is outside (1)."""
    page, out = group.column("page").to_numpy(), []
    host, shards = group.column("host")[0].as_py(), group.column("shards")[0].as_py()
    for region, names in enumerate((["article"], ["open", "chrome"])):
        parts, owners = [], []
        for name in names:
            for i, raw in enumerate(group.column(name)):
                own = np.frombuffer(raw.as_buffer(), np.uint32).astype(np.int64)
                if len(own):
                    parts += [own, np.array([_END + len(parts)])]
                    owners.append(np.full(len(own) + 1, page[i]))
        own_pages = page if region else page[[len(x.as_buffer()) > 0 for x in group.column("article")]]
        n, runs = len(np.unique(own_pages)), []
        least = _least(region, n, shards == 1)
        if parts and n >= least:
            tokens = np.concatenate(parts)
            starts = np.flatnonzero(distinct_pages(tokens, np.concatenate(owners)) >= least)
            runs = np.unique(run_hashes(tokens)[starts]).tolist()
        out.append({"host": host, "shards": shards, "region": region, "pages": n, "runs": runs})
    return pa.Table.from_pylist(out, _FOUND_ARROW)


_HITS = "host string, shard int, page long, region int, runs array<long>"
_HITS_ARROW = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("page", pa.int64()), ("region", pa.int32()), ("runs", pa.list_(pa.int64()))])


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of its host on each page of (host, shards, version_of, html, article, open)."""
    for batch in batches:
        rows = []
        for host, shards, version_of, html, *candidates in zip(*(c.to_pylist() for c in batch.columns)):
            streams = [_tokens(texts) for texts in _regions(html)]
            page = _page([x.tobytes() for x in streams], version_of)
            found = [run_hashes(streams[0]), np.concatenate([run_hashes(streams[1]), run_hashes(streams[2])])]
            for region in (0, 1):
                own = np.intersect1d(found[region], np.array(candidates[region] or [], np.int64))
                if len(own):
                    rows.append({"host": host, "shard": page % shards, "page": page, "region": region, "runs": own.tolist()})
        yield pa.RecordBatch.from_pylist(rows, _HITS_ARROW)


def _counted(group: pa.Table) -> pa.Table:
    """On how many distinct pages of a host's shard each candidate is."""
    sizes = group.column("runs").combine_chunks().value_lengths().to_numpy()
    runs = np.concatenate([np.array(x, np.int64) for x in group.column("runs").to_pylist()])
    pairs = np.unique(np.stack([runs, np.repeat(group.column("page").to_numpy(), sizes)]), axis=1)
    values, counts = np.unique(pairs[0], return_counts=True)
    same = {c: pa.array([group.column(c)[0].as_py()] * len(values), group.schema.field(c).type) for c in ("host", "region")}
    return pa.table({"host": same["host"], "region": same["region"], "run": pa.array(values, pa.int64()), "n": pa.array(counts, pa.int64())})


def _by_host(found: DataFrame) -> DataFrame:
    """(host, article, open): the runs of each host for both regions."""
    of = lambda region: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("region") == region, F.col("runs")))))
    return found.where("size(runs) > 0").groupBy("host").agg(of(0).alias("article"), of(1).alias("open"))


def boilerplate(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(host, article, open): hashes of the runs that are boilerplate, for hosts that have some. ``rows``: page_id, host, html."""
    shards = F.ceil(F.greatest(F.count("*") / HOST_PAGES, F.sum(F.length("html")) / HOST_CHARS)).cast("int")
    large = table(spark, rows.groupBy("host").agg(shards.alias("shards")).where("shards > 1"), "hosts")
    versions = rows.where("page_id is not null").groupBy("host", "page_id").agg(F.min(F.xxhash64("html")).alias("low"), F.max(F.xxhash64("html")).alias("high"))
    versions = table(spark, versions.where("low <> high").select("host", "page_id", F.shiftrightunsigned(F.xxhash64("page_id"), 1).alias("version_of")), "versions")
    dealt = rows.join(large, "host", "left").join(versions, ["host", "page_id"], "left").select("host", F.coalesce("shards", F.lit(1)).alias("shards"), "version_of", "html")
    found = table(spark, dealt.mapInArrow(_streams, _STREAMS).groupBy("host", "shard").applyInArrow(_frequent, _FOUND), "frequent")
    sets = found.where("shards = 1").select("host", "region", "runs")
    candidates = table(spark, _by_host(found.where("shards > 1")), "candidates")
    if not candidates.isEmpty():
        counts = dealt.join(candidates, "host").select("host", "shards", "version_of", "html", "article", "open").mapInArrow(_hits, _HITS)
        counts = counts.groupBy("host", "shard", "region").applyInArrow(_counted, "host string, region int, run long, n long")
        counts = table(spark, counts, "counts").groupBy("host", "region", "run").agg(F.sum("n").alias("n"))
        whole = found.where("shards > 1").groupBy("host", "region").agg(F.sum("pages").alias("pages"))
        by_region = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("region") + 1)
        enough = (F.col("n") * 100 >= F.col("pages") * by_region(SHARE)) & (F.col("n") >= by_region(LEAST))
        sets = sets.union(counts.join(whole, ["host", "region"]).where(enough).groupBy("host", "region").agg(F.collect_list("run").alias("runs")))
    return table(spark, _by_host(sets), "boilerplate")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """page_id, url and text of (page_id, url, html, article, open); the last two are the host's boilerplate."""
    for batch in slices(batches):
        texts = []
        for html, *runs in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
            found = [b for b in blocks(html or "") if b[0] < 2]
            for region in (0, 1):
                if runs[region]:
                    found = _cut(found, region, np.array(runs[region], np.int64))
            texts.append("\n".join(text for _, text in found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _cut(found: list[tuple[int, str]], region: int, runs: np.ndarray) -> list[tuple[int, str]]:
    """A page's blocks without the runs of one region: blocks that runs cover as a whole go, of others what runs inside cover."""
    own = [text.split() for of, text in found if of == region]
    tokens, block = _tokens([" ".join(words) for words in own]), np.repeat(np.arange(len(own)), [len(words) for words in own])
    starts = np.flatnonzero(np.isin(run_hashes(tokens), runs))
    covered = _covered(starts, len(tokens), RUN)
    inside = _covered(starts[block[starts] == block[starts + RUN - 1]], len(tokens), RUN)
    out, at = [], 0
    for of, text in found:
        if of == region:
            words = text.split()
            here, at = slice(at, at + len(words)), at + len(words)
            if covered[here].all():
                continue
            if inside[here].any():
                text = " ".join(w for w, x in zip(words, inside[here]) if not x)
        out.append((of, text))
    return out


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html)."""
    rows = narrowed(pages, page_id=("page_id", "long"), url=("url", "string"), html=("html", "string"))
    rows = spread(rows).withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), _HOST, 1)))
    texts = rows.join(boilerplate(spark, rows.drop("url")), "host", "left").select("page_id", "url", "html", "article", "open").mapInArrow(_texts, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
