"""Main text of web pages, with site templates removed.

1. Every element subtree that stands outside the article (a block such as a
   list, a box or a footer) is hashed from its tag and what it holds, each part
   once. Spark counts the pages of each host that hold it; partial counts combine
   before the shuffle, so one host with a third of all pages is no hot task.
2. Subtrees that recur on ``min_pages`` pages of a host or more, and on a share
   ``min_share`` of its pages, are its template; pages of one text count once.
   Each page gets the hashes of its own template subtrees by a join, and
   extraction deletes them.
3. What remains is read by element: menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and reader comments go by their tag, role or
   class. If the page has an article (or else a main element), only that counts.

Subtrees inside an article, or around an article or main element, are never
counted as template: articles of one host share passages, and copies of one
article would delete each other. A region that is template as a whole stays.

Inside an article a class marks boxes only (``div``, ``section``, lists, tables),
never a paragraph, a heading or a quotation.

Defined cases: a null or empty page has no text; a page cut anywhere is read as
far as it goes (an unfinished tag, comment or script is dropped); a null or odd
url is a host of its own text; repeated rows give repeated rows; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, join_counted, small, tune

#: Pages of one host on which a subtree recurs to be its template.
MIN_PAGES = 5
#: And the share of the host's pages.
MIN_SHARE = 0.01

# Element names of HTML by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("aside button canvas dialog footer form head header iframe input label nav noscript object menu option script select style svg template textarea title audio video".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe")
HASHED = frozenset("aside div dl footer form h1 h2 h3 header menu nav ol p section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words in a class or id that mark what is not the article, and words that may stand beside them.
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice disclaimer alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs pager pagination footer header masthead comment comments disqus replies reply respond share sharing social related recommended newsletter subscribe signup login search widget".split())
BESIDE = frozenset("site page main left right top bottom box block bar list links link button buttons container wrapper wrap inner outer area section content item items panel module primary secondary post posts article articles global mobile desktop fixed sticky slot unit form policy text icons body entry reader user wp".split())
#: Elements that hold text itself; inside an article no class marks them.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th a abbr b cite code em i mark q s small span strong sub sup time u".split())
#: Classes of an article element that is a reader's comment.
COMMENT = frozenset("comment comments reply replies".split())
_PARTS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
#: Attributes are read whole, so a quotation mark inside an unquoted value is no quotation.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|[^\s/>=]+(?:\s*+=\s*+(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'>][^\s>]*+)?)?|=)*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'][^\s=/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}


def _is_mark(name: str) -> bool:
    """Whether a class or id says what its element is, in marking words and those that stand beside them only."""
    parts = [x.lower() for x in _PARTS.split(name) if x and not x.isdigit()]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts)


def _marked(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether attributes say that an element is not part of an article."""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            if tag == "article":
                if any(set(_PARTS.split(x.lower())) & COMMENT and _is_mark(x) for x in value.split()):
                    return True
            elif not (in_article and tag in PROSE) and any(map(_is_mark, value.split())):
                return True
        elif tag != "article" and (name == "role" and value.lower() in ROLES):
            return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Page:
    """One reading of a page: its blocks, or the hashes of its subtrees outside an article."""

    def __init__(self, html: str, template: frozenset[int] | None = None):
        self.html, self.template = html, template
        self.hashes: set[int] = set()
        self.blocks: list[tuple[str, str]] = []  # region and text
        self.deleted: set[str] = set()  # regions of which template was deleted
        self.n_template = 0
        self.run: list[str] = []
        self.stack: list[tuple[str, list[str], bool, int, int]] = []  # tag, what it holds, dropped, blocks and regions before
        self.open: dict[str, int] = {}  # how many elements of a tag are open
        self.dropped = self.article = self.main = self.regions = 0
        self._read()

    def _flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run.clear()
            if text:
                self.blocks.append(("article" if self.article else "main" if self.main else "page", text))

    def _holds(self, part: str) -> None:
        """Something stands in the innermost element; of an article's own nothing is hashed."""
        if self.stack and not self.article:
            self.stack[-1][1].append(part)

    def _close(self) -> None:
        """Close the innermost element."""
        tag, held, dropped, before, regions = self.stack.pop()
        self.open[tag] -= 1
        if tag in BLOCK:
            self._flush()
        self.dropped -= dropped
        if tag == "article":
            self.article -= 1
        elif tag == "main":
            self.main -= 1
        if self.article:
            return
        h = xxhash.xxh3_64_intdigest("\0".join(held)) - 2**63
        self._holds(str(h))
        if tag in HASHED and regions == self.regions:
            if self.template is None:
                self.hashes.add(h)
            elif h in self.template:
                self._flush()
                self.n_template += 1
                self.deleted |= {r for r, _ in self.blocks[before:]}
                del self.blocks[before:]

    def _close_through(self, names: frozenset[str] | tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Close up to the innermost of ``names``, unless one of ``stops`` is met first."""
        if not any(self.open.get(x) for x in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                while len(self.stack) > k:
                    self._close()
                return
            if self.stack[k][0] in stops:
                return

    def _read(self) -> None:
        html, at, n = self.html, 0, len(self.html)
        while at < n:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None or m[4] != ">":
                continue
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    self.run.append(" ")
                self._close_through((tag,), ())
                continue
            if tag in BLOCK:
                if tag == "li":
                    self._close_through(("li",), ("ul", "ol", "menu"))
                elif tag in ("dt", "dd"):
                    self._close_through(("dt", "dd"), ("dl",))
                elif tag in ("td", "th", "tr"):
                    self._close_through(("td", "th") if tag != "tr" else ("tr",), ("table",))
                else:
                    self._close_through(("p",), ("table", "td", "th", "li", "div", "article", "section"))
                self._flush()
            label = f"{tag} {' '.join(m[3].split())}"
            if tag in VOID or m[3].endswith("/") and tag in ("path", "use"):
                self._holds(label)
                if tag == "br":
                    self.run.append(" ")
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(html, at)
                stop = end.end() if end else n
                if not self.article:
                    self._holds(label + html[at:stop])
                at = stop
                continue
            dropped = tag in DROPPED or bool(m[3]) and tag not in ("html", "body", "main") and _marked(tag, m[3], self.article > 0)
            self.stack.append((tag, [label], dropped, len(self.blocks), self.regions))
            self.open[tag] = self.open.get(tag, 0) + 1
            self.dropped += dropped
            self.regions += tag in ("article", "main") and not self.dropped
            if tag == "article":
                self.article += 1
            elif tag == "main":
                self.main += 1
        while self.stack:
            self._close()
        self._flush()

    def _text(self, text: str) -> None:
        if not self.article and (held := " ".join(text.split())):
            self._holds(held)
        if not self.dropped:
            self.run.append(unescape(text) if "&" in text else text)

    def main_text(self) -> str:
        for region in ("article", "main", "page"):
            if found := [t for r, t in self.blocks if r == region]:
                return "\n".join(found)
            if region in self.deleted:
                return Page(self.html).main_text()
        return ""


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        read = [Page(h) for h in batch.column(3).to_pylist()]
        says = [xxhash.xxh3_64_intdigest(p.main_text()) - 2**63 for p in read]
        found = [sorted(p.hashes) for p in read]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(says, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["page_id", "key", "host", "says", "hashes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        read = [Page(h, frozenset(t or ())) for h, t in zip(html, own, strict=True)]
        text = [p.main_text() for p in read]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([p.n_template for p in read], pa.int64())], ["page_id", "url", "text", "n_chars", "n_template"])


def host_of(address: Column) -> Column:
    """The host of an address in lower case; the whole address where it has none."""
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(host == "", address).otherwise(host)


def subtrees(source: DataFrame) -> DataFrame:
    """page_id, key, host, says (the main text's hash) and hashes (of subtrees) of each page."""
    return source.select("page_id", "key", "host", "html").mapInArrow(_hashes, "page_id long, key long, host string, says long, hashes array<long>")


def templates(listed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, hash and rows (of ``listed`` with it) of the subtrees that are a host's template."""
    one = listed.select("host", "says", F.explode_outer("hashes").alias("hash")).filter("hash is not null")
    held = one.groupBy("host", "hash", "says").agg(F.count(F.lit(1)).alias("rows")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("pages"), F.sum("rows").alias("rows"))
    sizes = cut(listed.select("host", "says").distinct().groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("all")))
    # What too few pages hold goes before the hosts' sizes are joined, and a host's hashes are not one task's work if these are broadcast.
    often = held.filter(F.col("pages") >= min_pages).join(small(sizes, 24 + F.length("of")), F.col("host") == F.col("of"))
    return often.filter(F.col("pages") >= min_share * F.col("all")).select("host", "hash", "rows")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars and n_template (subtrees deleted as template) of every page."""
    tune(pages.sparkSession)
    whole = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    source = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.xxhash64(address, whole).alias("key"), host_of(address).alias("host"), whole.alias("html"))
    listed = cut(subtrees(source))
    one = listed.select("page_id", "key", "host", F.explode_outer("hashes").alias("hash")).filter("hash is not null").distinct()
    found = cut(templates(listed, min_pages, min_share))
    own = join_counted(one, found, ["host", "hash"], "rows", 96, ["page_id", "key"]).groupBy("page_id", "key").agg(F.collect_list("hash").alias("own"))
    own = small(cut(own), 48 + 8 * F.size("own")).withColumnsRenamed({"page_id": "own_id", "key": "own_key"})
    on = (F.col("key") == F.col("own_key")) & F.col("page_id").eqNullSafe(F.col("own_id"))
    return source.join(own, on, "left").select("page_id", "url", "html", "own").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_template long")
