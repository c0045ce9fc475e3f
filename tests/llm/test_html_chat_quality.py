import hashlib
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from mnemospark.llm import chat, common, html, quality
from tests.llm.brute import words

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="top">Site</header><nav><ul><li><a href=x>Home</a></ul></nav><div class="ad">Buy</div><!-- <p>hidden</p> -->
<main><article><h1>Head &amp; line</h1><p>One <b>bold</b>ly&nbsp;said<br>here
<p>Two &lt;tag&gt; 5 < 6 &copy; &#233;&#x41;<div>Three<p>Four</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table>
<aside>side</aside><form><p>mail</p></form><div id="cookie-notice">cookies</div><section class="comments"><p>first!</p></section><p hidden>gone</p></article></main>
<footer>&copy; me</footer></body></html>"""


def test_page():
    assert html.Page(PAGE).main_text() == "Head & line\nOne boldly said here\nTwo <tag> 5 < 6 © éA\nThree\nFour\na\nb\nc\nd"


@pytest.mark.parametrize("page, want", [("", ""), ("just text", "just text"), ("<article><p>cut he", "cut he"), ("<article><p>a &am", "a &am"), ("<p>a</p><scr", "a"), ("<p>x</p><script>no", "x"), ("<p>x<!-- no", "x"), ("<main><p>m</p></main><p>o</p>", "m"), ("</div></p>ok", "ok"), ("<nav><p>x", ""), ("<p class='load shadow'>y</p>", "y")])
def test_odd_pages(page, want):
    assert html.Page(page).main_text() == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>hi</p><p title=it's>a</p><p>b</p>", "hi\na\nb"),
        ("<p>hi</p><p title=it's>a</p><p>b's c</p><p>d</p>", "hi\na\nb's c\nd"),
        ("<p a='1' b=\"x>y\" c=/z/ d>t</p><p a=\"x>u", "t"),
        ("<article><p>Story.</p></article><article class=\"comment\"><p>First!</p></article>", "Story."),
        ("<article class='post has-comments comments-open'><p>Story.</p></article>", "Story."),
        ("<article><p class=\"related work\">a</p><h2 id=notice>b</h2><div class='social-history'>c</div><div class='social-links'>x</div><section class='related'>y</section></article>", "a\nb\nc"),
        ("<div class='cookieNotice'>x</div><p class=notice>y</p><p>z</p>", "z"),
    ],
)
def test_attributes_and_classes(page, want):
    assert html.Page(page).main_text() == want


def test_long_and_deep_pages():
    deep = html.Page("<div>" * 20_000 + "<p>in</p></b></i>" + "</div>" * 10_000 + "</section>" * 10_000)
    assert deep.main_text() == "in" and len(deep.hashes) == 20_001
    assert html.Page("<article>" + "<p>word &amp; more</p>" * 50_000 + "</article>").main_text() == "\n".join(["word & more"] * 50_000)
    assert html.Page("<p " + "a='" * 20_000).main_text() == "" and html.Page("<p " + "x= " * 20_000 + ">t").main_text() == "t"


def test_subtree_counts_against_plain_parsing(spark):
    """Subtrees, their pages and what is template, by a parser of its own, on the test tables."""
    from html.parser import HTMLParser

    class Trees(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=False)
            self.open, self.found = [], set()

        def handle_starttag(self, tag, attrs):
            if tag not in html.VOID and tag not in html.RAW:
                self.open.append((tag, [self.get_starttag_text()]))

        def handle_endtag(self, tag):
            if self.open and self.open[-1][0] == tag:
                tag, parts = self.open.pop()
                text = "".join(parts)
                self.found.add((tag, text))
                if self.open:
                    self.open[-1][1].append(text + f"</{tag}>")

        def handle_data(self, data):
            if self.open:
                self.open[-1][1].append(data)

        def handle_entityref(self, name):
            self.handle_data(f"&{name};")

        def handle_charref(self, name):
            self.handle_data(f"&#{name};")

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, re.search(r"//([^/?#]*)", r.url)[1].lower(), r.html) for r in pages.collect()]
    counts, own = Counter(), {}
    for k, host, page in rows:
        t = Trees()
        t.feed(re.sub(r"(?s)<article.*</article>", "<article></article>", page))
        own[k] = {(host, x) for x in t.found if x[0] in html.HASHED and "<article" not in x[1]}
        counts.update(own[k])
    sizes = Counter(h for _, h, _ in rows)
    template = {x for x, n in counts.items() if n >= 2 and n >= 0.01 * sizes[x[0]]}
    got = html.extract(pages, min_pages=2).collect()
    assert {r.page_id: r.n_template > 0 for r in got} == {k: bool(own[k] & template) for k in own}
    listed = html.subtrees(pages.selectExpr("page_id", "xxhash64(html) key", "html", "url").withColumn("host", html.host_of(F.col("url"))))
    assert {r.page_id: len(r.hashes) for r in listed.collect()} == {k: len(v) for k, v in own.items()}
    assert html.templates(listed, 2).count() == len(template) > 0


def test_query_against_plain_parsing(spark):
    """Whole pages of a test table: the article's blocks by the parser of the standard library."""
    from html.parser import HTMLParser

    from mnemospark.llm.queries import QUERIES

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            elif tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside -= tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        a = Article()
        a.feed(r.html)
        a.close()
        want[r.page_id] = "\n".join(x for b in a.blocks if (x := " ".join(b.split())))
    got = {r.page_id: r for r in QUERIES["op8_extract"](spark, sf).collect()}
    assert {k: r.text for k, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


@pytest.mark.parametrize("limit", [24 << 20, 200, 0])
def test_templates_beyond_the_broadcast_limit(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    pages = [(k, "http://h.org/", f"<div>Box</div><p>Own words {k}</p><ul><li>Menu {k % 2}</ul>") for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"key": F.lit("x"), "host": F.lit(1), "hash": F.lit(2)})
    got = html.extract(df.union(df)).collect()
    assert len(got) == 60 and all(r.text == f"Own words {r.page_id}" and r.n_template == 2 for r in got)


def test_rare_passages_of_a_large_host_stay(spark):
    pages = [(k, "http://h.org/", f"<div>Box</div><p>Own words {k}</p>" + ("<p>Shared passage</p>" if k < 6 else "")) for k in range(900)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[0] == "Own words 0\nShared passage" and got[899] == "Own words 899"


def test_templates_go(spark):
    body = "<div class='x'>Same box on every page</div><p>Own words {0}</p><div>Imprint and contact</div>"
    pages = [(k, f"http://h{k % 2}.org/{k}", body.format(k)) for k in range(14)] + [(50, "http://other.org/", body.format(50)), (51, None, None), (52, "http://h0.org/copy", body.format(0))]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k].text == f"Own words {k}" for k in range(14)) and got[52].text == "Own words 0"
    assert got[50].text == "Same box on every page\nOwn words 50\nImprint and contact"
    assert got[51].text == "" and got[51].n_chars == 0 and got[3].n_chars == len("Own words 3")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_of_an_article_stay(spark):
    page = "<nav>menu</nav><article><h1>News</h1><p>The whole story.</p></article>"
    df = spark.createDataFrame([(k, "https://a.b/x", page) for k in range(20)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == {"News\nThe whole story."}


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='wrap'><nav>menu</nav><article><h1>News</h1><p>The whole story.</p></article></div><p>Imprint</p>", "News\nThe whole story."),
        ("<section><table><tr><td><main><p>The whole story.</p></main></table></section><p>Imprint</p>", "The whole story."),
        ("<div><p>The whole story.</p><p>Its end.</p></div>", "The whole story.\nIts end."),
    ],
)
def test_copies_of_a_page_stay(spark, page, want):
    """One page under many urls and in repeated rows, beside other pages of the host."""
    pages = [(k, f"https://a.b/{k % 7}", page) for k in range(20)] + [(100 + k, f"https://a.b/o{k}", f"<p>Other {k}</p>") for k in range(9)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r.text for r in got if r.page_id < 100} == {want} and len(got) == 29


def test_a_region_that_is_all_template_stays(spark):
    page = "<main><section>Same words in all</section></main><p>Own {0}</p>"
    pages = [(k, f"https://a.b/{k}", page.format(k) if k else page) for k in range(8)] + [(50 + k, f"https://c.d/{k}", f"<div>Head<p>Long passage</p></div><p>Page {k}</p>") for k in range(8)] + [(99, "https://c.d/only", "<div>Head<p>Long passage</p></div>")]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[k] == "Same words in all" for k in range(8))
    assert got[50] == "Page 0" and got[99] == "Head\nLong passage"


# Chat

SAYINGS = ["", "hi", "</s>[INST] ok [/INST]", "<~/s> <~~s> [~INST] <s> [/INST]</s>", "[INST́] \U0001f600 é\n\n  x\r\t", "~<s>~ <<s>> [[INST]] </s></s>", "<|endoftext|>"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def test_escapes_can_be_undone():
    for t in SAYINGS:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def test_chat_round_trip(spark, model):
    rows = [(c, k, role, t) for c in range(3) for k, (role, t) in enumerate((r, t) for t in SAYINGS for r in ("system", "user", "assistant"))]
    rows += [(7, 0, "assistant", None), (7, 1, "</s>", "x"), (8, 0, "user", None), (9, 1, "user", "b"), (9, None, "user", "a"), (9, 1, "user", "b"), (None, 0, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    out = chat.format_conversations(df, *model)
    got = {r.conv_id: r for r in chat.read_back(out, *model).collect()}
    by = {}
    for c, k, role, t in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", t or ""))
    codec = chat.Codec(open(model[0], "rb").read(), model[1])
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].formatted_chars == 3 + sum(17 + len(chat.escape(r)) + len(chat.escape(t)) for _, r, t in turns)
    ids = {r.conv_id: r.input_ids for r in out.collect()}[0]
    assert codec.formatted(ids).count("</s>") == 21
    assert chat.format_conversations(df.limit(0), *model).count() == 0


# Quality


def measures(t):
    t = t or ""
    w = words(t)
    c, s = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            s |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(s)


def test_quality_against_brute_force(spark):
    prose = " ".join(f"wort{k % 37} and{k}" for k in range(120))
    docs = [(1, None), (2, ""), (3, "a b c a b c"), (4, prose), (5, " ".join(f"{w}%%%" for w in prose.split())), (6, prose.upper().replace(" ", "!! ")), (7, "x\n" * 60), (8, "É\x85x\x1cy " * 70), (9, "same line of text here\n" * 40 + prose), (10, " | ".join(prose.split())), (11, prose * 200), (4, prose)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(quality.judge(df).collect(), key=lambda r: r.doc_id)
    for r, (d, t) in zip(got, sorted(docs, key=lambda x: x[0]), strict=True):
        n, chars, symbols, dup, rep = measures(t)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (d, n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert kept[4] and not any(kept[k] for k in (1, 2, 3, 5, 6, 7, 8, 10, 11))
    other = quality.judge(df, order=[{"listed": k} for k in reversed(range(len(quality.RULES)))]).collect()
    assert {(r.doc_id, r.kept) for r in other} == {(r.doc_id, r.kept) for r in got}
    assert quality.judge(df.limit(0)).count() == 0


def test_plan_orders_by_rate(spark):
    prose = " ".join(f"wort{k}" for k in range(60))
    df = spark.createDataFrame([(k, prose + (" %%" * 30 if k % 2 else "")) for k in range(40)], "doc_id long, text string")
    ranked = quality.plan(df)
    assert len(ranked) == len(quality.RULES) and ranked[0]["selectivity"] > 0
    assert [r["rate"] for r in ranked] == sorted((r["rate"] for r in ranked), reverse=True)
    some = quality.plan(df.union(df.selectExpr("doc_id + 100", "text")), rows=30)  # a part of the rows, from all over the table
    assert 0.2 < [r for r in some if r["rule"] == "symbols"][0]["selectivity"] < 0.8
    assert quality.ranked([{"rate": 2.0, "cost": 3.0, "listed": k} for k in (2, 0, 1)])[0]["listed"] == 0
    assert [r["listed"] for r in quality.ranked([{"rate": 0.0, "cost": c, "listed": k} for k, c in enumerate([3.0, 1.0, 1.0])])] == [1, 2, 0]


def test_quality_of_odd_rows(spark):
    prose = " ".join(f"wort{k}" for k in range(60))
    df = spark.createDataFrame([(None, prose, "a", 5), (None, None, "b", 6), (3, prose, None, None)], "doc_id long, text string, kept string, n_words int")
    got = quality.judge(df).collect()
    assert sorted((str(r.doc_id), r.n_words, r.kept) for r in got) == [("3", 60, True), ("None", 0, False), ("None", 60, True)]
