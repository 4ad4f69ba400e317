"""HTML wrappers, the URL filter, and the pipeline."""

import html as entities
import random
import re

from pyspark.sql import functions as F

from twotier.llm import html_extraction, url_filter
from twotier.llm.html_extraction import align, main_slots, parse, wrapper_of

from .conftest import EN, plain

PAGE = "page_id bigint, url string, html string, host string, share int, slots string, path string, rule string"


def article_text(page):
    """The fixture's own truth: the blocks of the article element."""
    inside = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (" ".join(entities.unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_fixture(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = html_extraction.query(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article_text(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def infer(pages):
    wrapper = wrapper_of(parse(pages[0]))
    for p in pages[1:]:
        wrapper = align(wrapper, wrapper_of(parse(p)))
    return wrapper


def extracted(spark, pages, parts=1):
    """The main texts of pages of one host, in their order."""
    rows = spark.createDataFrame([(i, "http://a.org/x", p, "h", 1, "s", "p", "r") for i, p in enumerate(pages)], PAGE)
    found = {r["page_id"]: r["text"] for r in html_extraction.main_texts(rows.repartition(parts)).collect()}
    return [found[i] for i in range(len(pages))]


def test_wrapper_has_slots_options_and_groups():
    pages = ["<body><h2>Same</h2><p>one<p>two<dl><dt>a<dd>b<dt>c<dd>d</dl></body>",
             "<body><h2>Same</h2><p>three<img><hr><dl><dt>e<dd>f</dl></body>"]
    body = infer(pages)[0]
    h2, p, hr, dl = body[3]
    assert h2[3][0][0] == "#" and p[1] and hr[2] and not h2[2]
    assert dl[3][0][0] == "()" and [i[0] for i in dl[3][0][3]] == ["dt", "dd"] and dl[3][0][1]
    assert main_slots(infer(pages)) == ["/body/dl/dd", "/body/dl/dt", "/body/h2", "/body/p"]


def test_boilerplate_without_an_article_element(spark):
    def page(n):
        return (f"<title>x</title><body><header>Site</header><nav><a href=/>Home</a></nav><div id='cookie-notice'>We use cookies {n}</div>"
                f"<div class=content><h1>Title {n}</h1><p>A &lt;b&gt; text&nbsp; {n}<script>var x = '<p>no';</script><br>goes on.</p>"
                f"<form>Sign up {n}</form></div><ul><li><a href=a>Link {n}</a><li><a href=b>Other {n}</a></ul><p>All rights reserved</p>"
                f"<section class='post-comments'><p>I disagree {n}</p></section><aside>Ad {n}</aside></body>")
    assert extracted(spark, [page(i) for i in range(3)])[1] == "Title 1\nA <b> text 1 goes on."


def test_menus_and_notices_in_unlisted_classes(spark):
    def page(n):
        menu = "".join(f"<li>{x}" for x in ("Start", "Shop", "About"))
        return (f"<body><div class=zone><ul>{menu}</ul></div><div class=zoneb><h1>Title {n}</h1><p>Text {n}<p>Sign up for our weekly letter"
                f"<p>goes on {n}</div><div class=zonec><span>Made with care</span></div></body>")
    assert extracted(spark, [page(i) for i in range(4)], 3) == [f"Title {n}\nText {n}\ngoes on {n}" for n in range(4)]
    # one page alone tells nothing about its host
    assert extracted(spark, [page(0)])[0].startswith("Start\nShop\nAbout\nTitle 0")


def test_headings_before_varying_text_stay(spark):
    def page(n):
        return (f"<body><article><h1>Cake {n}</h1><h2>Ingredients</h2><ul><li>Flour {n}<li>Salt</ul><h2>Method</h2><p>Stir {n}"
                f"<p>Sign up for our weekly letter<h2>Newsletter</h2><p>Every week</article></body>")
    pages = [page(i) for i in range(3)]
    # "Salt" is on all pages: a constant that is no heading
    assert extracted(spark, pages) == [f"Cake {n}\nIngredients\nFlour {n}\nMethod\nStir {n}" for n in range(3)]
    # on two pages nothing is a constant yet
    assert extracted(spark, pages[:2])[0].endswith("Sign up for our weekly letter\nNewsletter\nEvery week")


def test_constants_options_and_groups_inside_an_article(spark):
    def page(n):
        more = "<h3>Editor's choice</h3><p>Best of the week" if n % 2 else ""
        return (f"<body><article><div class=lead>Read by our members</div><h1>Title {n}</h1><p>Text {n}<p>goes on {n}"
                f"<div>{more}</div><ul><li><b>Print</b><i>Word {n}</i></ul><dl><dt>Source<dd>Paper {n}<dt>Source<dd>Book {n}</dl></article></body>")
    # the option is judged by the pages that show it
    assert extracted(spark, [page(i) for i in range(7)])[1] == (
        "Title 1\nText 1\ngoes on 1\nPrintWord 1\nSource\nPaper 1\nSource\nBook 1")
    # copies of one page tell nothing, whatever stands around the article
    copies = [f"<body><div>Visit {n}</div>{page(1)}</body>" for n in range(3)] + ["<body><p>other</body>"]
    assert extracted(spark, copies)[0].startswith("Read by our members\nTitle 1")


def test_any_order_of_the_pages_gives_the_same_texts(spark):
    draw = random.Random(6)
    rows = []
    for host in range(80):
        for n in range(5):
            parts = [draw.choice([f"<p>text {draw.randint(0, 3)}", "<h2>Head</h2>", f"<ul><li>a<li>b{n}</ul>", "<div class=x><p>note</div>",
                                  f"<dl><dt>k<dd>v{draw.randint(0, 2)}</dl>", "<hr>"]) for _ in range(draw.randint(1, 7))]
            rows.append((5 * host + n, f"http://h{host}.org/{n}", f"<body>{''.join(parts)}</body>"))
    seen = None
    for turn in range(5):
        random.Random(turn).shuffle(rows)
        pages = spark.createDataFrame([(*r, "h", 1, "s", "p", "r") for r in rows], PAGE).repartition(turn + 1)
        found = {r["page_id"]: r["text"] for r in html_extraction.main_texts(pages).collect()}
        assert seen in (None, found) and len(found) == 400
        seen = found


def test_slots_joined_by_shares_give_the_same(spark, monkeypatch):
    def page(n):
        return f"<body><div><p>Menu</div><p>Text {n}</body>"
    pages = [page(i) for i in range(9)]
    want = extracted(spark, pages)
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_extraction, "SHARE_PAGES", 2)
    assert extracted(spark, pages, 3) == want == [f"Text {n}" for n in range(9)]


def test_deep_nesting(spark):
    deep = "<div>" * 5000 + "core <b>text</b>" + "<aside>ad</aside>" + "</div>" * 5000 + "<p>after"
    assert extracted(spark, [deep, "<p>other"])[0] == "core text\nafter"


def test_a_host_with_two_templates(spark):
    def article(n):
        return f"<body><nav>Menu</nav><article><h1>Title {n}</h1><p>Text {n}</article><p>All rights reserved</p></body>"

    def plain_page(n):
        return (f"<body><nav>Menu</nav><div class=content><h2>Head {n}</h2><p>Body {n}</div><ul><li><a href=x>Link {n}</a></ul>"
                "<p>All rights reserved</p></body>")
    rows = [(i, url, article(i) if i % 2 else plain_page(i)) for i, url in
            enumerate(["http://a.org/x"] * 6 + [None, "/relative", None, "no host"])]
    pages = spark.createDataFrame([(*r, "h", 1, "s", "p", "r") for r in rows], PAGE)
    for r in html_extraction.main_texts(pages).collect():
        i = r["page_id"]
        assert r["text"] == (f"Title {i}\nText {i}" if i % 2 else f"Head {i}\nBody {i}")


def test_html_edges(spark):
    rows = [(1, "http://a.org/x", None), (2, None, "<p>Hi &amp; bye"), (3, "no host", ""), (4, "http://a.org/y", "<article><p>T" + "x" * 300_000),
            (4, "http://a.org/y", "<article><p>T" + "x" * 300_000), (5, "http://b.org", "just text < 3 &bogus; &#x41;"),
            (None, "http://b.org", "<div><div><p>a</div>b<"), (6, "http://c.org", "<!-- open <p>x"), (7, "http://c.org", "<p " + "a='" * 2000)]
    pages = spark.createDataFrame([(*r, "h", 1, "s", "p", "r") for r in rows], PAGE)
    got = html_extraction.main_texts(pages).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[1] == "" and texts[2] == "Hi & bye" and texts[3] == "" and len(texts[4]) == 300_001
    assert texts[5] == "just text < 3 &bogus; A" and texts[6] == ""
    assert html_extraction.main_texts(pages.limit(0)).count() == 0


URLS = ["http://a.ORG/x", "https://x.example.org/es/1", "http://example.org/en/12", "http://s.com/fr/", "http://s.com/de/9?a=1", "http://com/fr/x",
        "http://xcom/fr/x", "http://a.net/q", None, "", "nothing", "http://b.org", "x://c.org/a://d.com/fr/", "http://é.com/de/#" + "z" * 5000]


def brute_rule(url):
    if not url or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_verdicts(spark):
    rows = [(i, URLS[i % len(URLS)]) for i in range(140)] + [(None, "http://a.net/z")]
    pages = spark.createDataFrame([(i, u, None, "h", 1, "s", "p", "r") for i, u in rows], PAGE)
    got = url_filter.judged(pages).collect()
    assert len(got) == len(rows)
    kind = {r: k for k, r in url_filter.RULES}
    for r in got:
        if r["page_id"] is not None:
            assert (r["host"], r["path"], r["rule"]) == brute_rule(dict(rows)[r["page_id"]])
        assert r["verdict"] == kind.get(r["rule"], r["verdict"]) and r["verdict"] in ("allow", "block")
    one_sided = pages.where("url = 'http://a.net/q' or url = 'http://a.ORG/x'")
    assert {r["verdict"] for r in url_filter.judged(one_sided).collect()} == {"allow"}
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_entropy_and_lexical_features(spark):
    row = url_filter.lexical(url_filter.parsed(spark.createDataFrame(
        [(1, "http://a-b.c.org/d/e?x=1&y=2#f"), (2, None)], "page_id bigint, url string"))).orderBy("page_id").collect()
    import math
    url = "http://a-b.c.org/d/e?x=1&y=2#f"
    want = -sum(url.count(c) / len(url) * math.log2(url.count(c) / len(url)) for c in set(url))
    assert abs(row[0]["entropy"] - want) < 1e-9 and row[0]["parameters"] == 2 and row[0]["depth"] == 2
    assert row[0]["suffix"] == "org" and row[0]["directory"] == "d" and row[0]["hyphens"] == 1
    assert row[1]["entropy"] == 0 and row[1]["url_length"] == 0


def test_pipeline_stages(spark, awkward, empty, sf_dir):
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    for docs in (awkward, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
        ids = {r["doc_id"] for r in out.collect()}
        assert ids == ({r["doc_id"] for r in now.collect()})
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_stages_with_repeated_and_null_ids(spark, sf_dir):
    import corpus_pipeline
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r["text"].split()) >= 8)
    a, b, c = (plain(EN, 40, seed) for seed in (101, 102, 103))
    rows = [(1, a), (1, a), (1, b), (2, a), (3, c), (3, f"{c} {item}"), (None, c + " end"), (None, c + " end"), (None, item),
            (None, None), (None, None), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row key", F.lit(1))
    stage = dict(corpus_pipeline.STAGES)

    def found(df):
        assert df.columns == docs.columns
        return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    left = set(rows) - {(2, a)}  # equal rows are one; 1 has the links of both its texts
    assert found(stage["near_dedup"](spark, docs, sf_dir)) == sorted(left, key=str)
    assert found(stage["decontamination"](spark, docs, sf_dir)) == sorted(
        (r for r in rows if not (r[1] or "").endswith(item)), key=str)
