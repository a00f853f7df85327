"""Pages, archives, URLs, vectors, toxicity and the pipeline against plain Python."""

import gzip
import io
import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import embedding_dedup, exact_dedup, html_text, near_dedup, queries, toxicity, url_filter, warc
from larkspur.llm.common import new_path, written

SF = "/root/testdata/sf0.001"

PAGE = (
    "<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    "<header>Site</header><nav><ul><li><a href=/a>Home {n}</a><li>More</ul></nav><div class='ad'>Buy {n}</div><div id=cookie-notice>Cookies</div>"
    "<{tag}><h1>Title&nbsp;{n} &amp; more</h1><p><b>First  {n}\nline<br>second<p>Par {n}<div class=\"share-bar\">Share</div><section class=comments><p>Me {n}</section></{tag}>"
    "<aside>Side {n}</aside><form>Name {n}</form><div>All rights reserved</div><footer>&copy; x {n}</footer>"
)


def test_html_text_of_articles():
    pages = [PAGE.format(n=i, tag="article") for i in range(6)]
    want = [f"Title {i} & more\nFirst {i} line second\nPar {i}" for i in range(6)]
    assert html_text.induce(pages) == want
    assert html_text.induce(pages[:1] * 3) == want[:1] * 3


def test_html_text_of_slots():
    """Without an article element, what is the same on all pages of the host goes."""
    pages = [PAGE.format(n=i, tag="div") for i in range(6)]
    assert html_text.induce(pages) == [f"Title {i} & more\nFirst {i} line second\nPar {i}" for i in range(6)]


@pytest.mark.parametrize(
    ("source", "text"),
    [("", ""), ("no markup at all", "no markup at all"), ("<article>a &lt;b&gt; &#233;&#x41;</article>", "a <b> éA"), ("<p>1 < 2 <p>x", "1 < 2\nx"), ("<article><!-- c --><p>a<script>b</p>", "a"), ("<form class='with-sidebar'><article>in</article> out</form>", "in"), ("<article class=comment>no</article><main>yes</main>", "yes"), ("<article><p title='>'>q</p><p>" + "w " * 5000, "q\n" + ("w " * 5000).strip())],
)
def test_html_text_of_odd_pages(source, text):
    assert html_text.induce([source]) == [text]


def plain_match(a, b):
    """Simple tree matching as it is defined."""
    if a.sig != b.sig:
        return 0
    m = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + plain_match(x, y))
    return 1 + m[-1][-1]


def random_tree(r, depth=0):
    return "".join(f"<{t}>{random_tree(r, depth + 1) if depth < 4 and r.random() < 0.6 else 'x'}</{t}>" for t in r.choices(["div", "section", "span", "p"], k=r.randint(1, 5)))


def test_simple_tree_matching():
    shapes = {}
    a = html_text.fold(html_text.parse("<div><h1>a</h1><p>b</p><p>c</p><ul><li>d</ul></div>"), shapes)
    b = html_text.fold(html_text.parse("<div><p>b</p><table></table><ul><li>x<li>y</ul></div>"), shapes)
    assert html_text.match(a, b)[0] == 5  # root, div, run of p, ul, run of li
    assert html_text.match(a, a)[0] == a.size
    r = random.Random(4)
    for _ in range(150):
        a, b = (html_text.fold(html_text.parse(random_tree(r)), shapes) for _ in range(2))
        size, pairs = html_text.match(a, b)
        assert size == plain_match(a, b) == len(pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == size and all(x.path == y.path for x, y in pairs)


@pytest.mark.parametrize("source", ["<div>" * 10_000 + "deep", "<b>" * 10_000 + "deep" + "</b>" * 10_000, "<ul><li>" * 5_000 + "deep", "<h2>a</h2><p>b</p>" * 5_000, "<p>" + "word " * 200_000])
def test_html_of_any_depth_and_width(source):
    began = time.process_time()
    got = html_text.induce([source, source + "<p>end", source[: len(source) // 2]])
    assert got[1].endswith("end") and got[0] == got[1].removesuffix("end").strip("\n")
    assert time.process_time() - began < 5


def test_wrapper_decides_pages_without_telling_names():
    """The same pages with the wrapper and without it."""
    page = "<div class=x1><div class=x2>Our great site</div><div class=x3><p>Story {n} begins</p><p>and ends {n}</p></div><div class=x4>Read on at <a>the front page</a></div></div>"
    pages = [page.format(n=i) for i in range(6)]
    constant = html_text.wrapper([html_text.parse(p) for p in pages])
    assert [html_text.content(html_text.parse(p), constant) for p in pages] == [f"Story {i} begins\nand ends {i}" for i in range(6)]
    assert html_text.content(html_text.parse(pages[0]), set()) == "Our great site\nStory 0 begins\nand ends 0\nRead on at the front page"


def test_pages_of_one_large_host_share_a_wrapper(spark, monkeypatch):
    """More pages than a group: all are freed of what a sample shows to be constant."""
    monkeypatch.setattr(html_text, "GROUP_PAGES", 16)
    page = "<article><h1>Title {n}</h1><p>Text of {n}</p><p>Write to us.</p></article>"
    pages = spark.createDataFrame([(i, "http://one.example/", page.format(n=i), "x") for i in range(200)] + [(1000 + i, "http://two.example/", page.format(n=i), "x") for i in range(2)], "page_id long, url string, html string, wrapper string")
    got = {r.page_id: r.text for r in html_text.main_text(pages, url_filter.host_of("url")).collect()}
    assert got == {i: f"Title {i}\nText of {i}" for i in range(200)} | {1000 + i: f"Title {i}\nText of {i}\nWrite to us." for i in range(2)}


def test_held_out_quality():
    """Held-out documents of the labelled table: the figures that the README states."""
    import pyarrow.parquet as pq

    big = "/root/testdata/sf0.1"
    docs = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{big}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    label = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{big}/labels.parquet").to_pylist() if r["toxic"] is not None and r["doc_id"] in docs}
    held = {i for i in label if zlib.crc32(str(i).encode()) % 5 == 0}
    some = [i for i in label if i not in held and len(docs[i]) <= toxicity.TRAIN_CHARS]
    model = toxicity.fit([docs[i] for i in some], [label[i] for i in some])
    score, _ = model.score([docs[i] for i in sorted(held)])
    y = np.array([label[i] for i in sorted(held)])
    assert (score[y == 1] >= 0.5).mean() >= 0.9 and (score[y == 0] >= 0.5).mean() <= 0.01
    assert url_filter.auc(score, y) >= 0.95


def test_html_table(spark):
    data = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(n=i, tag="article"), "x") for i in range(300)] + [(None, None, None, "x"), (7, "no url", "<p>a", None)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, text string")
    got = html_text.main_text(pages, url_filter.host_of("url")).collect()
    want = []
    for i, u, source, _ in data:
        text = "" if source is None else "a" if source == "<p>a" else f"Title {i} & more\nFirst {i} line second\nPar {i}"
        want.append((repr(i), repr(u), text, len(text)))
    assert sorted((repr(r.page_id), repr(r.url), r.text, r.n_chars) for r in got) == sorted(want)
    assert html_text.main_text(pages.limit(0), url_filter.host_of("url")).count() == 0


URLS = [None, "", "no", "http://A.com", "HTTP://Www.Example.COM:80/En/x?q#f", "http://example.com/en/1", "http://www.example.com/en/1", "https://x.net/es/", "http://net/es", "http://a.net/fr/b?c", "x://h#f/?", "http://casino-poker.example.org/jackpot/1", "a://b://c/d", "http://a.com/\n/x"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    w, b = url_filter.fit()
    for r in url_filter.judged(pages).collect():
        host, path = url_filter.split_url(URLS[r.page_id])
        fits = [(len(t), t, act) for act, t in url_filter.RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        p = url_filter.probability(host, path, w, b)
        want = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if p >= 0.5 else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
    assert url_filter.split_url(URLS[4]) == ("www.example.com:80", "/En/x")
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_url_model_on_hosts_it_has_not_seen():
    score, label = url_filter.held_out_scores()
    assert len(label) >= 200 and url_filter.auc(score, label) >= 0.85 and ((score >= 0.5) == label).mean() >= 0.75
    w, b = url_filter.fit()
    p = lambda u: url_filter.probability(*url_filter.split_url(u), w, b)
    assert min(p("http://best-casino.test/poker/x"), p("https://free-torrent.test/warez/4")) > 0.5
    assert max(p("http://city-library.test/books/7"), p("https://weather.test/guide/2")) < 0.5


def test_urls_of_a_table_and_odd_rows(spark):
    """A model from a given table; very long, repeated and null URLs; the model leaves ruled rows alone."""
    own = spark.createDataFrame([("http://bad.test/a", 1), ("http://good.test/b", 0), ("http://worse.test/", None)], "url string, label int")
    long = "http://long.test/" + "a/" * 100_000
    pages = spark.createDataFrame([(1, long, "r"), (1, long, "r"), (None, None, None), (2, "http://x.com/bad", "r")], "page_id long, url string, rule string")
    got = sorted(url_filter.judged(pages, own).collect(), key=repr)
    assert len(got) == 4 and {len(r.path) for r in got if r.page_id == 1} == {200_001}
    assert [r.block_probability for r in got if r.rule] == [None] and all(0 < r.block_probability < 1 for r in got if not r.rule)


def pages_table(spark):
    r = random.Random(3)
    html = ["<p>same</p>", "", None, "é" * 10_000, "\x1f\x8b\x08 no member", *("".join(r.choices("abc<>é日", k=400)) for _ in range(30))]
    data = [(i, None if i % 9 == 0 else f"http://h/{i} x", html[i % len(html)] if i % 4 else html[0], 1) for i in range(120)] + [(None, "u", "alone", 1), (None, "u", "<p>same</p>", 1), (5, "u", "twice", 1), (5, "u", "twice", 1)]
    return data, spark.createDataFrame(data, "page_id long, url string, html string, offset int").repartition(3)


@pytest.mark.parametrize(("split", "few"), [(97, warc.FEW_REVISITS), (1000, 3), (1 << 20, warc.FEW_REVISITS)])
def test_warc_round_trip(spark, split, few):
    data, pages = pages_table(spark)
    folder = new_path(spark, "warc")
    warc.write(pages, folder, few_revisits=few)
    first = {}
    for i, _, h, _ in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h, _ in data:
        raw, keep = (h or "").encode(), first.get(h or "")
        revisit = keep is not None and i != keep
        want.append((i, None if u is None else u.replace(" ", "%20"), "revisit" if revisit else "response", len(raw), warc.digest(raw), keep if revisit else None, None if revisit else raw))
    got = warc.read(spark, folder, split, with_payload=True).collect()
    key = lambda t: tuple(map(repr, t))
    assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    if split == 97:
        for path in {r.path for r in got}:
            assert gzip.open(path.removeprefix("file:")).read().startswith(b"WARC/1.1\r\n")


def test_warc_small_payloads_and_empty_tables(spark):
    _, pages = pages_table(spark)
    folder = new_path(spark, "warc")
    warc.write(pages, folder, min_bytes=12)
    assert {r.record_type for r in warc.read(spark, folder).where("payload_bytes < 12").collect()} == {"response"}
    folder = new_path(spark, "warc")
    warc.write(pages.limit(0), folder)
    assert warc.read(spark, folder).count() == 0


def test_warc_scan_passes_over_false_members():
    good = [warc._member(warc.record(i, None, b"x" * i)) for i in range(5)]
    junk = [b"", b"\x1f\x8b\x08", b"\x1f\x8b\x08\x00garbage", gzip.compress(b"not a record"), warc._member(b"")]
    raw = b"".join(j + g for j, g in zip(junk, good, strict=True)) + good[0][:-5]
    for split in (1, 7, 64, 10_000):
        found = [x for s in range(0, len(raw), split) for x in warc.scan(io.BytesIO(raw), s, min(len(raw), s + split), len(raw))]
        assert [warc.parse(d)["page_id"] for _, d in found] == list(range(5))
        assert all(raw[at : at + 3] == warc.MAGIC for at, _ in found)


def vectors():
    r = np.random.default_rng(2)
    base = r.standard_normal((12, 20))
    near = [base[i % 4] + r.standard_normal(20) * s for i in range(160) for s in (0.08, 0.16)]
    data = [(i, [float(x) for x in v], i % 3) for i, v in enumerate([*base, *near, *base[:4], *(base[:4] * 3)])]
    n = len(data)
    return data + [(n, None, 1), (n + 1, [0.0] * 20, 1), (n + 2, [float("nan")] * 20, 1), (n + 3, [None] + [1.0] * 19, 1), (n + 4, data[0][1], None), (n + 5, [1.0, 2.0], 0), (n + 6, [2.0, 4.0], 0), (n + 7, [], 0), (n + 8, [math.inf] * 20, 0), (None, data[0][1], 0)]


@pytest.mark.parametrize("split", [embedding_dedup.SPLIT, 60, 8])
def test_embedding_groups(spark, split):
    """Whole labels, cells of all levels and tiles, against brute force."""
    data = vectors()
    ok = [(i, np.array(v), g) for i, v, g in data if i is not None and v and g is not None and None not in v and np.isfinite(v).all() and any(v)]
    link = {i: set() for i, _, _ in ok}
    for i, v, g in ok:
        for j, u, h in ok:
            if i < j and g == h and len(u) == len(v) and v @ u / (np.linalg.norm(v) * np.linalg.norm(u)) >= 0.98:
                link[i].add(j)
                link[j].add(i)

    def low(i):
        seen, todo = {i}, [i]
        while todo:
            new = link[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    want = {i: (len(link.get(i, ())), low(i) if i in link else i) for i, _, _ in data if i is not None}
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r.vec_id: r for r in embedding_dedup.groups(table, split=split).collect()}
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, True)
    assert {i: (r.n_links, r.component_id) for i, r in got.items() if i is not None} == want
    assert all(r.kept == (r.component_id == i) for i, r in got.items())
    assert max(n for n, _ in want.values()) > 20
    stay = embedding_dedup.dedup(table).select("vec_id").collect()
    assert {r.vec_id for r in stay} == {i for i, (_, c) in want.items() if i == c} | {None}
    assert embedding_dedup.groups(table.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "dims", "noise"), [(400, 64, 0.02), (300, 20, 0.03), (200, 5, 0.05), (152, 1, 0.1)])
def test_embedding_compare(n, dims, noise):
    """Links of one group, whole and by blocks and cells, each counted once; few pairs are looked at."""
    r = np.random.default_rng(n)
    base = r.standard_normal((n // 4, dims))
    unit = embedding_dedup._unit(np.concatenate([base, *(base + noise * r.standard_normal(base.shape) for _ in range(3))]))
    ids, copies = r.permutation(n), r.integers(1, 4, n)
    y = (unit @ embedding_dedup.rotation(dims)).astype(np.float32)
    cos = unit @ unit.T
    np.fill_diagonal(cos, 0)
    both = np.full(n, embedding_dedup.BOTH)
    got = embedding_dedup.compare(ids, y, copies, both, -1, 0.98)
    assert got.degree.tolist() == ((cos >= 0.98) * copies).sum(axis=1).tolist() and not got.unsure
    if dims == 64:
        assert got.compared < 0.1 * n * (n - 1) / 2
    low = np.arange(n)
    for _ in range(n):
        low = np.minimum(low, np.where(cos >= 0.98, low[None], n).min(axis=1))
    assert [low[i] == low[j] for i in range(n) for j in range(n)] == [got.label[i] == got.label[j] for i in range(n) for j in range(n)]
    total = np.zeros(n, np.int64)
    for k, (s, e, budget) in enumerate(embedding_dedup.blocks(dims, 0.98)):
        x = y[:, s : min(e, s + 2)].astype(float)
        found = {}
        for at, home, cell in embedding_dedup.visits(x, np.sqrt(budget)):
            for i, h, c in zip(at.tolist(), home.tolist(), map(tuple, cell.tolist()), strict=True):
                found.setdefault(c, []).append((i, embedding_dedup.BOTH if h else embedding_dedup.VISITOR))
        for rows in found.values():
            i, role = np.array(rows).T
            np.add.at(total, i, embedding_dedup.compare(ids[i], y[i], copies[i], role, k, 0.98).degree)
    assert total.tolist() == got.degree.tolist()


def test_embeddings_that_repeat_an_id(spark):
    """One vector of an id counts, whatever the order of rows; columns of any names stay."""
    rows = [(1, [1.0, 0.0], "a", 1), (2, [1.0, 0.001], "a", 2), (2, [0.0, 1.0], "a", 3), (3, [1.0, 0.002], "b", 4), (4, [1.0, 0.0], "a", 5), (None, [1.0, 0.0], "a", 6)]
    got = []
    for order in (rows, rows[::-1]):
        table = spark.createDataFrame(order, "vec_id long, embedding array<double>, label string, gone int").coalesce(1)
        got.append(sorted(map(tuple, embedding_dedup.groups(table).collect()), key=repr))
        left = embedding_dedup.dedup(table)
        assert left.columns == table.columns and {1, 4, 6} <= {r.gone for r in left.collect()} | {5}
    assert got[0] == got[1] and len(got[0]) == 6


def test_marginals_against_enumeration():
    r = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5])
    unary, trans = r.standard_normal(9), r.standard_normal((2, 2))
    got, at = toxicity.marginals(unary, lengths, trans), 0
    for n in lengths:
        u = unary[at : at + n]
        total, one = 0.0, np.zeros(n)
        for k in range(1 << n):
            y = [k >> i & 1 for i in range(n)]
            p = math.exp(sum(u[i] * y[i] for i in range(n)) + sum(trans[y[i], y[i + 1]] for i in range(n - 1)))
            total += p
            one += p * np.array(y)
        assert np.allclose(got[at : at + n], one / total)
        at += n
    sticky = np.array([[3.0, -3.0], [-3.0, 3.0]])  # a text's marginals don't depend on its segments, nor on the texts beside it
    for lengths in ([5000], [1024], [1025], [2048, 7, 0, 1100, 1, 3072]):
        long = r.standard_normal(sum(lengths)) * 3
        want = np.concatenate([toxicity._marginals(x, np.array([len(x)]), sticky) for x in np.split(long, np.cumsum(lengths)[:-1])])
        assert np.allclose(toxicity.marginals(long, np.array(lengths), sticky), want, atol=1e-12)


def test_scores_and_spans_by_hand():
    """A small model, its marginals by summing over all labellings, its spans and scores by their definitions."""
    model = toxicity.Model(bias=-2.0, weights={"w:bad": 4.0, "p:bad": 0.5, "w:word": -1.0, "p:vil": 2.5}, trans=np.array([[0.3, -0.4], [-0.2, 0.9]]), doc=np.array([-3.0, 2.0, 3.0]))
    r = random.Random(4)
    texts = ["", "  ", *(" ".join(r.choices(["bad", "Bad,", "word", "vilest", "calm", "--", "\u00e9t\u00e9"], k=r.randint(1, 9))) + r.choice(["", "\n", "  x"]) for _ in range(40))]
    scores, spans = model.score(texts)
    for text, score, found in zip(texts, scores, spans, strict=True):
        words = text.split()
        unary = [model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]
        weight, one = 0.0, [0.0] * len(words)
        for y in itertools.product((0, 1), repeat=len(words)):
            p = math.exp(sum(u for u, k in zip(unary, y, strict=True) if k) + sum(model.trans[a, b] for a, b in itertools.pairwise(y)))
            weight += p
            one = [m + p * k for m, k in zip(one, y, strict=True)]
        p = [m / weight for m in one]
        x = -3.0 + 2.0 * math.log1p(sum(p)) + 3.0 * max(p, default=0.0)
        assert score == pytest.approx(1 / (1 + math.exp(-x)))
        want, at = [], 0
        for w, m in zip(words, p, strict=True):
            at = text.index(w, at)
            if m >= 0.5:
                if want and not text[want[-1][1] : at].strip():
                    want[-1] = (want[-1][0], at + len(w))
                else:
                    want.append((at, at + len(w)))
            at += len(w)
        assert found == want


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(8)
    words = ["".join(r.choices(["ka", "lo", "mi", "re", "tu", "so", "ne"], k=r.randint(1, 4))) for _ in range(900)]
    data, labels = [], []
    for i in range(1200):
        bad = i % 8 == 0
        text = r.choices(words, k=r.randint(5, 200))
        if bad:
            for _ in range(r.randint(1, 5)):
                text.insert(r.randrange(len(text)), r.choice(["wretch", "Vermin!", "zorb" + r.choice(["ka", "lo", "mi", "re"])]))
        data.append((i, " ".join(text), 0.5))
        labels.append((i, int(bad)))
    data += [(5000, None, 0.1), (5001, "", 0.1), (5002, "vermin " * 30_000, 0.1), (None, "calm lo mi", 0.1), (5002, "vermin " * 30_000, 0.1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score double").repartition(3)
    table = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = [(x.doc_id, x.score, x.spans) for x in toxicity.scored(docs, model).collect()]
    assert len(got) == len(data) and all(0 <= s <= 1 for _, s, _ in got)
    held = [(i, s, spans) for i, s, spans in got if i is not None and i < 1200 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (i % 8 == 0) for i, s, _ in held) >= 0.97 * len(held)
    for i, s, spans in held:
        for a, b in spans:
            assert any(x in data[i][1][a:b].lower() for x in ("wretch", "vermin", "zorb"))
    odd = {i: s for i, s, _ in got if i is None or i >= 5000}
    assert odd[5002] > 0.5 > max(odd[5000], odd[5001], odd[None])
    clean = toxicity.keep_clean(docs, model)
    assert clean.columns == docs.columns and clean.where("doc_id = 5002").count() == 0 and clean.where("doc_id > 4999 or doc_id is null").count() == 3
    assert [r.held for r in docs.select(toxicity.held_out(docs.doc_id).alias("held")).where("doc_id is null").collect()] == [False]
    named = toxicity.keep_clean(docs.withColumnsRenamed({"score": "toxicity"}), model)
    assert named.columns == ["doc_id", "text", "toxicity"] and named.where("doc_id is null").first().toxicity == 0.1
    assert toxicity.train(docs, table.limit(0)).weights == {} and toxicity.scored(docs.limit(0), model).count() == 0


def test_pipeline(spark):
    """Every stage by brute force: the fitted model, equal texts, five-word Jaccard of 0.8, and pieces that hold each id once."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.collect()
    score, _ = model.score([r.text or "" for r in rows])
    clean = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    best = {}
    for r in clean:
        key = "".join(c for c in r.text or "" if c not in exact_dedup.SPACE)
        best[key] = min(best.get(key, (0, math.inf)), (-len(r.text or ""), r.doc_id))
    left = {i for _, i in best.values()}
    sets = {r.doc_id: near_dedup.shingles((r.text or "").encode()) for r in clean if r.doc_id in left}
    low = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if low[i] < low[j] and near_dedup.jaccard(sets[i], sets[j]) >= 0.8:
                    low[j], changed = low[i], True
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i in low if low[i] == i}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "packing"]
    text, pieces, windows = {r.doc_id: r.text or "" for r in rows}, {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    for i, own in pieces.items():
        ids, at = [*tokenizer.encode(text[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)
    for k, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == max(windows)


def test_pipeline_stages_on_odd_tables(spark):
    """Null texts, sources and ids, clashing columns, an empty table."""
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, gone int, h string, toxicity int, queue int, best string"
    data = [(i, None if i % 5 == 0 else f"word{i} " * (i + 1), None, None if i % 2 else "s", 1, 1, "h", 1, 1, "b") for i in range(12)] + [(None, "no id", None, "s", 1, 1, "h", 1, 1, "b")]
    for rows, ids in ((data, {0, *(i for i in range(12) if i % 5)} | {None}), ([], set())):
        docs = spark.createDataFrame(rows, kind)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs, columns = stage(spark, docs, SF) if rows or name != "toxicity" else docs, docs.columns
            assert docs.columns == columns
            docs = written(docs, name)
        assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, SF).collect()} == ids


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_keep_every_row(spark, name):
    table, key = {"op1": ("pages", "page_id"), "op7": ("pages", "page_id"), "op9": ("pages", "page_id"), "op10": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    got = queries.QUERIES[name](spark, SF)
    ids = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in got.select(key).collect()} == ids
