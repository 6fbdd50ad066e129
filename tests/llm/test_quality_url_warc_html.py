import hashlib
import re

import numpy as np
import pytest

from tessera.llm import html_extract, quality, url_filter, warc


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


TEXTS = [None, "", " \n\t ", "a b c d e a b c d e", "x\nx\n\ny\nx", "# * $ % & | < >", "a b c d e f a b c d e f g", "é ü\vß\f x " * 3, "one two three four five six seven eight nine ten eleven", "Aa BB\r\nAa BB\r\nc " * 4, "a a a a a a a a a a"]


def test_statistics(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in quality.with_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_outliers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(rng.integers(2, 9)) + str(int(rng.integers(1e6))) for _ in range(int(rng.integers(30, 200)))), "en", ["a", "b", None][i % 3]) for i in range(400)]
    bad = [(1000 + i, " ".join(f"w{int(rng.integers(1e6))}***&&&" for _ in range(80)), "en", "a") for i in range(40)]
    df = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS kept", "1 AS n_words")
    out = quality.judge(df).toPandas()
    assert len(out) == 440
    assert out.kept[out.doc_id < 1000].mean() > 0.99 and not out.kept[out.doc_id >= 1000].any()


def test_quality_edges(docs, rows, empty):
    out = quality.judge(docs).toPandas()
    assert len(out) == len(rows) and not out.kept[out.base_failed].any()
    assert quality.judge(empty).count() == 0


def test_mahalanobis_is_numpy_s(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([("g", *map(float, v)) for v in x], "_t_g string, " + ", ".join(f"{c} double" for c in quality.X))
    from pyspark.sql import functions as F

    e = quality._estimate(df.groupBy("_t_g").agg(*quality._sums()), ["_t_g"], F.lit(1.0))
    got = sorted(r._t_d2 for r in quality._distance(df.join(e, "_t_g")).collect())
    cov = np.cov(x.T, bias=True) + np.diag(np.square(quality.FLOORS))
    want = sorted(np.einsum("ij,jk,ik->i", x - x.mean(0), np.linalg.inv(cov), x - x.mean(0)))
    assert got == pytest.approx(want)


def reweighted(x):
    """Sums of the rows near the middle by MCD: whole halves sorted by distance, steps from two starts to the end."""
    floors, n, h = np.diag(np.square(quality.FLOORS)), len(x), min(len(x), (len(x) + 6) // 2)

    def far(mean, cov, factor=1.0):
        d = x - mean
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(factor * cov + floors), d)

    med = np.median(x, axis=0)
    best = None
    for mean, cov in ((med, np.diag(np.square(1.4826 * np.median(np.abs(x - med), axis=0)))), (x.mean(0), np.cov(x.T, bias=True))):
        for _ in range(100):
            half = x[np.argsort(far(mean, cov), kind="stable")[:h]]
            mean, cov = half.mean(0), np.cov(half.T, bias=True)
        det = np.linalg.slogdet(cov + floors)[1]
        best = min(best or (np.inf,), (det, mean, cov), key=lambda b: b[0])
    near = x[far(best[1], best[2], quality.consistency(min(round(h / n, 2), 1 - 1e-9))) <= quality.WEIGHED]
    return np.array([len(near)]), near.sum(0), near.T @ near


def test_estimates_are_brute_force_mcd(spark):
    """Groups of several sizes, some with a third of their rows far off: the verdicts of the definition, in memory."""
    rng = np.random.default_rng(12)
    rows = []
    for lang, source, n in (("a", "x", 700), ("a", "y", 90), ("a", "z", 5), ("b", "x", 300), ("b", None, 40), (None, "x", 1)):
        v = rng.normal(size=(n, 5)) @ (rng.normal(size=(5, 5)) * 0.3) + rng.normal(size=5)
        v[: n // 3] += rng.choice([-1, 1]) * 6
        rows += [(f"{lang}-{source}", str(lang), *map(float, r)) for r in v]
    df = spark.createDataFrame(rows, "_t_pair string, _t_lang string, " + ", ".join(f"{c} double" for c in quality.X))
    got = quality._distance(df.join(quality.robust_estimates(df, 10), "_t_pair")).select("_t_pair", *quality.X, "_t_d2").toPandas()
    x, pairs, langs = np.array([r[2:] for r in rows]), np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    plus = lambda own, other: [a + quality.PRIOR * b / other[0] for a, b in zip(own, other, strict=True)]
    whole = reweighted(x)
    want = {}
    for pair in set(pairs):
        lang = langs[pairs == pair][0]
        n, s, q = plus(reweighted(x[pairs == pair]), plus(reweighted(x[langs == lang]), whole))
        mean = s / n
        cov = (q / n - np.outer(mean, mean)) * 0.975 / quality.chi_square(quality.WEIGHED)[1] + np.diag(np.square(quality.FLOORS))
        for r in x[pairs == pair]:
            want[pair, tuple(np.round(r, 9))] = (r - mean) @ np.linalg.inv(cov) @ (r - mean)
    a = got["_t_d2"].to_numpy()
    b = np.array([want[r[0], tuple(np.round(r[1:6], 9))] for r in got.itertuples(index=False)])
    assert np.mean((a <= quality.CUTOFF) == (b <= quality.CUTOFF)) > 0.985 and np.median(np.abs(a / b - 1)) < 0.05
    assert 0.1 < np.mean(a > quality.CUTOFF) < 0.4


def test_consistency_factors():
    """Against a sample of normal rows: the covariance of the inner part, times the factor, is that of all."""
    x = np.random.default_rng(0).normal(size=(400_000, 5))
    order = np.argsort((x * x).sum(1))
    for share in (0.5, 0.6, 0.9):
        inner = x[order[: int(share * len(x))]]
        assert quality.consistency(share) * inner.var() == pytest.approx(1, abs=0.01)


def test_many_groups_join_without_one_task(spark, monkeypatch):
    df = spark.range(500).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('g', id % 50) END AS g", "id")
    groups = df.groupBy("g").agg({"id": "max"}).withColumnRenamed("max(id)", "m")
    want = sorted(map(tuple, quality._beside(df, groups, "g", 5).collect()))
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 3)
    monkeypatch.setattr("tessera.llm.common.HOT_GROUPS", 100)
    assert sorted(map(tuple, quality._beside(df, groups, "g", 5).collect())) == want


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.com/en/x", "https://a.example.com/en/", "http://example.com/en?x", "http://x.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://com", "http://com/", "http://a.org/x#y", "http://b.com?q=/en/", "ftp://é.net/es/ü", "http://a//b://c.com/", "http://x.example.com/en/" + "long/" * 3000, "http://" + "a." * 300 + "net/fr/?" + "q" * 3000]


def judged(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[2]), m[3]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_urls(spark):
    df = spark.createDataFrame(list(enumerate(URLS * 2)), "page_id long, url string").selectExpr("*", "'x' AS host", "2 AS verdict")
    out = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(out) == 2 * len(URLS)
    for k, u in enumerate(URLS * 2):
        assert (out[k].host, out[k].path, out[k].rule, out[k].verdict) == judged(u)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("least", [64, url_filter.MIN_BITS])
def test_cascade_is_exact(spark, monkeypatch, least):
    monkeypatch.setattr(url_filter, "MIN_BITS", least)
    keys = spark.range(4000).selectExpr("concat('k', id) AS key", "id % 7 = 0 AS listed")
    c = url_filter.Cascade.build(keys.filter("listed"), keys)
    assert len(c.levels) > 2 if least == 64 else c.levels
    from pyspark.sql import functions as F

    assert keys.filter(c.contains(F.col("key")) != F.col("listed")).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page, huge = "<p>é" + "x" * 200, "<p>ü very long " * 200_000
    rows = [(5, "http://a.org/x", page), (3, "http://b.a.org/", page), (9, None, page), (4, "http://c.com/\r\nq", "short"), (6, "u", "short"), (7, "http://a.org/x", None), (8, "", ""), (5, "http://a.org/x", page), (None, "http://z.net", page), (20, "http://é.org/ü x%20", huge), (21, "http://z.org/" + "long/" * 2000, huge), (22, "u", huge + "!")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS key", "0 AS payload")
    folder = str(tmp_path / "w")
    lines = warc.write_archives(df.repartition(3), folder)
    files = warc.write_index(lines, folder)
    wanted = df.select(warc.url_key(df.url).alias("key"), "page_id")
    got = sorted(map(tuple, warc.read_back(files, folder, wanted).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(i, len((t or "").encode()), sha(t), "revisit" if t in (page, huge) and i not in (3, 20) else "response", None if t not in (page, huge) or i in (3, 20) else 3 if t == page else 20) for i, _, t in rows]
    assert got == sorted(want, key=str)
    look = warc.Lookup(files.collect(), folder)
    found = look.records("org,a)/x")
    assert sorted(r["fields"]["WARC-Record-ID"] for r in found) == ["<urn:page:5>", "<urn:page:5>", "<urn:page:7>"]
    assert look.lines("org,nothing)/") == [] and look.lines("") == [] and look.lines("zzz") == []
    response = look.records("org,a,b)/")[0]
    assert response["payload"].decode() == page
    assert look.records("com,c)/\r\nq")[0]["fields"]["WARC-Target-URI"] == "http://c.com/%0D%0Aq"
    assert look.records("org,é)/ü x%20")[0]["fields"]["WARC-Target-URI"] == "http://%C3%A9.org/%C3%BC%20x%20"
    nothing = spark.createDataFrame([("org,nothing)/", 5), ("org,a)/x", 6), ("org,a)/x", 7)], "key string, page_id long")
    assert [r.page_id for r in warc.read_back(files, folder, nothing).collect()] == [7]


def test_warc_lookup_over_blocks(spark, tmp_path, monkeypatch):
    """Keys that run over blocks and files, one of them with most pages."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    folder = str(tmp_path / "w")
    df = spark.range(300).selectExpr("id AS page_id", "if(id < 200, concat('http://h', id % 10, '.org/p', id % 40), 'http://hot.org/') AS url", "concat('text of ', id) AS html")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = warc.write_index(warc.write_archives(df, folder), folder)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1
    look = warc.Lookup(files.collect(), folder)
    for k in range(0, 200, 23):
        ids = {r["fields"]["WARC-Record-ID"] for r in look.records(f"org,h{k % 10})/p{k % 40}")}
        assert ids == {f"<urn:page:{i}>" for i in range(200) if i % 10 == k % 10 and i % 40 == k % 40}
    assert len(look.lines("org,hot)/")) == 100
    back = warc.read_back(files, folder, df.select(warc.url_key(df.url).alias("key"), "page_id")).toPandas()
    assert sorted(back.page_id) == list(range(300)) and (back.payload_bytes == back.page_id.map(lambda i: len(f"text of {i}"))).all()


def test_warc_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    folder = str(tmp_path / "w")
    files = warc.write_index(warc.write_archives(df, folder), folder)
    assert warc.read_back(files, folder, df.select(warc.url_key(df.url).alias("key"), "page_id")).count() == 0


PROSE = "This is a long sentence of the article, with commas, and more of them, so that it scores well. "


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{PROSE}<p>{PROSE}&lt;b&gt; caf&eacute;</article><footer>foot</footer>", f"Title\n\n{PROSE.strip()}\n\n{PROSE}<b> café"),
        (f"<div class='sidebar'><p>{PROSE * 3}</p></div><div id=main><p>{PROSE}</p><p>Short one.</p><script>var a='<p>x</p>'</script><form><p>{PROSE}</p></form><div class=\"comments\"><p>{PROSE}</p></div></div>", f"{PROSE.strip()}\n\nShort one."),
        (f"<div><p>{PROSE}<br>next   line\n here<!-- <p>no</p> --></p><ul><li>one<li>two</ul></div>", f"{PROSE}next line here\n\none\n\ntwo"),
        (f"<main><article><section><p>{PROSE * 9}</p></section><section><p>Short.</p></section></article><div class='related-posts'><p>{PROSE}</p></div></main>", f"{(PROSE * 9).strip()}\n\nShort."),
        (f"<article><p>{PROSE}</p><aside>aside</aside><div role=complementary>{PROSE}</div><p hidden>no</p><style>p{{}}</style><p>End.</p></article></b></div><p>", f"{PROSE.strip()}\n\nEnd."),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


ARTICLE, TEXT = f"<h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p>", f"Title\n\n{PROSE.strip()}\n\n{PROSE.strip()}"
COMMENTS = f"<div class=comments><p>{PROSE}</p></div>"


@pytest.mark.parametrize("name", ["elementor-widget-container", "layout has-sidebar", "no-sidebar", "page-with-header", "post comment-open"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_article_in_containers_that_look_unwanted(name, inner):
    whole = inner.format(ARTICLE)
    nav = "<nav><a href=x>Menu</a></nav>"
    assert html_extract.main_text(f"<body>{nav}<div class='{name}'>{whole}{COMMENTS}</div><footer>foot</footer>") == TEXT
    assert html_extract.main_text(f"<body><form action=x>{nav}<div id='{name}'>{whole}</div><input name=y><button>Go</button></form>") == TEXT


def test_prose_in_containers_that_look_unwanted():
    widgets = "".join(f"<div class=elementor-widget-container><p>{PROSE}{k}.</p></div>" for k in range(5))
    want = "\n\n".join(f"{PROSE}{k}." for k in range(5))
    assert html_extract.main_text(f"<body><div>{widgets}</div></body>") == want
    assert html_extract.main_text(f"<form><p>{PROSE}</p></form><p>Short.</p>") == PROSE.strip()
    assert html_extract.main_text("<div class=ad>Buy</div><p>Short.</p>") == "Short."
    related = f"<div class=related-posts><article><p>{PROSE}</p></article></div>"
    assert html_extract.main_text(f"<div><article>{ARTICLE}</article>{related}{COMMENTS}</div>") == TEXT


def test_siblings_of_the_best_container():
    """An unscored sibling goes, a short section of the same article stays, and so does a short article beside an advert."""
    long = f"<p>{PROSE}</p>" * 5
    want = "\n\n".join([PROSE.strip()] * 5)
    assert html_extract.main_text(f"<main><div>{long}</div><div>Buy our product now.</div></main>") == want
    assert html_extract.main_text(f"<article><section>{long * 4}</section><section><p>A last paragraph, a short one.</p></section><div>Buy now.</div></article>") == "\n\n".join([want] * 4) + "\n\nA last paragraph, a short one."
    assert html_extract.main_text("<body><div class=ad>Buy this, and that, and all of those things.</div><article><h1>Title</h1><p>So.</p></article>") == "Title\n\nSo."


@pytest.mark.parametrize("broken", ['<a "', "<a b='x", "<a ", "<a b=\"x", "<", "</", "<!--", "<!", "<script>", "<b>", "<div>", "<p>", "<a b=c/", "<i></b>"])
def test_broken_markup_takes_linear_time(broken):
    """200 KB of it, which takes minutes with a tag pattern that backtracks; the text before it is whole."""
    import time

    began = time.process_time()
    assert html_extract.main_text(f"<article><p>{PROSE}</p>" + broken * (200_000 // len(broken))).startswith(PROSE.strip())
    assert time.process_time() - began < 10


def test_quotes_in_tags():
    one, two = "First paragraph of the article, which is long enough.", "Second one's here, and it is long enough as well."
    assert html_extract.main_text(f"<p title=it's>{one}</p><p>{two}</p>") == f"{one}\n\n{two}"
    assert html_extract.main_text(f"<p title='a > b' class = \"x\" hidden2 = y/z>{one}</p><p\n>{two}</p >") == f"{one}\n\n{two}"
    assert html_extract.main_text(f"<p a=\"never closed>{one}</p><p>{two}</p>") == f"{one}\n\n{two}"
    assert html_extract.main_text(f"<p>{one}</p><p hidden=\"\">no, this is hidden, all of it</p><p>{two} 1 < 2 <3</p>") == f"{one}\n\n{two} 1 < 2 <3"


def texts_of(node):
    """Texts of a node outside blocks below it."""
    return [y for x in node.items for y in ([x] if type(x) is str else texts_of(x) if not x.dropped and x.tag not in html_extract.BLOCK else [])]


def scores_by_definition(nodes):
    """Points of each container by their definition: from each paragraph to all its ancestors, whose level is the number of
    different texts between: elements that hold the same text are on one level."""
    points, text = dict.fromkeys(nodes, 0.0), {}
    whole = lambda n: "".join(x.strip() if type(x) is str else "" if x.dropped else text.setdefault(x, None) or whole(x) for x in n.items)
    for n in reversed(nodes):
        text[n] = whole(n)
    for n in nodes:
        texts = texts_of(n)
        size = sum(len(x.strip()) for x in texts)
        if size >= 25 and (n.tag in html_extract.PARAGRAPH or n.tag in ("div", "section", "article", "main", "body")):
            up, seen = (n.parent if n.tag in html_extract.PARAGRAPH else n), set()
            while up is not None:
                seen.add(len(text[up]))
                level = len(seen) - 1
                points[up] += (1 + sum(x.count(",") for x in texts) + min(size / 100, 3)) * (1.0 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
                up = up.parent
    return points


def prose(k):
    return f"{PROSE}{k}."


@pytest.mark.parametrize("outer", ["div id=c", "main", "section"])
@pytest.mark.parametrize("inner", ["<p>{}</p><p>{}</p>", "<h2>Head</h2><p>{}</p><p>{}</p>", "<div><p>{}</p></div><div><div><p>{}</p></div></div>"])
def test_whole_articles_in_wrappers(outer, inner):
    """However many blocks there are and however deep they are wrapped, every paragraph comes back, and no menu or footer."""
    for blocks in (1, 2, 3, 6, 12):
        for depth in range(5):
            body = "".join("<div>" * depth + inner.format(prose(2 * b), prose(2 * b + 1)) + "</div>" * depth for b in range(blocks))
            page = f"<body><nav><a href=x>menu</a></nav><{outer}>{body}</{outer.split()[0]}><footer>Foot, and so on, and so on, and so on.</footer></body>"
            found = html_extract.main_text(page).split("\n\n")
            assert [x for x in found if x != "Head"] == [prose(k) for k in range(2 * blocks)], (blocks, depth)
            assert found.count("Head") == blocks * ("Head" in inner)


def test_whole_articles_of_page_builders():
    """Sections of columns of widgets, and rows of columns, outside and inside a main element."""
    widget = lambda k: f"<h2>Head</h2><p>{prose(2 * k)}</p><p>{prose(2 * k + 1)}</p>"
    sections = "".join(f"<section class=s><div class=column><div class=widget-container>{widget(k)}</div></div></section>" for k in range(8))
    grid = "".join("<div class=row>" + "".join(f"<div class=col><div>{widget(2 * r + c)}</div></div>" for c in (0, 1)) + "</div>" for r in range(2))
    for body, n in ((sections, 16), (grid, 8)):
        for page in (f"<body><div>{body}</div></body>", f"<body><main>{body}</main></body>"):
            assert [x for x in html_extract.main_text(page).split("\n\n") if x != "Head"] == [prose(k) for k in range(n)]


def test_comments_marked_up_as_articles():
    said = "".join(f'<article class="comment">{ARTICLE.replace("Title", "Reply")}</article>' for _ in range(6))
    assert html_extract.main_text(f"<main><article>{ARTICLE}</article><section class=discussion>{said}</section></main>") == TEXT
    assert html_extract.main_text(f"<div><div class=post>{ARTICLE}</div><section>{said.replace('h1', 'h4')}</section></div>") == TEXT
    assert html_extract.main_text(f'<body><article class="post comments-open">{ARTICLE}</article></body>') == TEXT


def test_scores_are_brute_force(spark):
    """Of generated trees and of pages of the test data."""
    rng = np.random.default_rng(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return PROSE[: int(rng.integers(1, len(PROSE)))]
        tag = str(rng.choice(["div", "p", "section", "a", "b", "ul", "li", "article", "span", "blockquote", "h2", "nav"]))
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(int(rng.integers(1, 4)))) + f"</{tag}>"

    pages = [tree(7) for _ in range(50)] + [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()[:50] if r.html]
    for page in pages:
        nodes = html_extract._order(html_extract.parse(page))
        html_extract._score(nodes)
        want = scores_by_definition(nodes)
        assert [n.points for n in nodes] == pytest.approx([want[n] for n in nodes])


def test_html_edges(spark):
    deep = "<div>" * 3000 + f"<p>{PROSE}</p>"
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p" * 50), (4, "u", deep), (4, "u", deep), (5, "u", "<script>never closed"), (6, "u", "<!-- never closed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text")
    out = html_extract.extract(df).toPandas()
    assert len(out) == 7 and (out.n_chars == out.text.map(len)).all()
    assert (out.text[out.page_id == 4] == PROSE.strip()).all() and (out.text[out.page_id == 1] == "").all()
    assert html_extract.extract(df.limit(0)).count() == 0
