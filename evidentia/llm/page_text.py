"""Main text of web pages by removal of each site's templates.

Every page is parsed once into blocks of text, each with the hashes of the element
subtrees that it stands in.  Spark counts the hashes per host: a subtree is a part
of the host's template if many pages of the host have it and, dealt into 64 classes
by what their main text says, at least ``classes`` classes do (copies of one page
are one class, so an article isn't a template because it was copied).  Blocks inside
such subtrees go.  A host's sums are one long and one count a subtree, added up
before they are shuffled; a subtree that a third of all pages have is one row.

What recurs too rarely to be seen as a template, such as the menu of a site of
three pages, goes by its markup: elements that mark menus, headers, footers, asides,
forms, dialogs and scripts, and those whose role, class or id says so.  Where a page
marks its article (``article``, ``main``, an article body's role or property) only
what is inside counts.  Paragraphs, headings, lists, quotes, tables and inline
markup inside a marked article are the article's own: they stay however often
they recur, so a line that many articles quote isn't lost.

Defined results
---------------
* null and empty html, and pages without any text, give an empty text;
* pages without a host (null, relative or broken addresses) have no template, only markup counts;
* rows that repeat an address or an id are pages of their own; very long pages are read whole;
* a reference without a semicolon, a tag that isn't closed, a cut-off page are read as browsers read them;
* an empty table gives an empty result;
* extra columns pass through, but for the html and those named as a new one.

Subtrees are compared by 64-bit hashes within a host.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import spread
from .common import Workspace, append_columns, fresh, if_small, table

#: A template's subtree is on at least this share of its host's pages, and in this many classes of them.
SHARE, CLASSES = 0.002, 5
#: Most templates, or hosts, that are broadcast.
SMALL = 1_000_000

# Elements of HTML and what they are to a reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = RAW | frozenset("audio button canvas datalist head math noscript object option select svg template video".split())
BESIDE = frozenset("aside dialog footer form header menu nav search".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that hold a marked article's own text, however often it recurs.
PROSE = (
    frozenset("blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup li ol p pre table tbody td tfoot th thead tr ul".split())
    | frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
)
#: An open element of these ends where one of those begins.
CLOSES = (
    {k: frozenset({"p"}) for k in BLOCK - {"body", "caption", "html", "legend", "summary", "tbody", "tfoot", "thead", "tr"}}
    | {"li": frozenset({"li", "p"}), "dt": frozenset({"dd", "dt", "p"}), "dd": frozenset({"dd", "dt", "p"}), "tr": frozenset({"tr", "td", "th", "p"})}
    | {"td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"})}
    | {k: frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}) for k in ("tbody", "tfoot", "thead")}
)
#: Where the search for an element to close ends.
WALLS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **dict.fromkeys(("td", "th", "tr", "tbody", "tfoot", "thead"), {"table"})}
TABLE = {"table": (), **dict.fromkeys(("td", "th", "tr", "tbody", "tfoot", "thead", "caption"), {"table"})}
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
SCOPE = frozenset({"html", "body", "table", "td", "th", "caption", "object", "template", "button"})
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in a class or an id that mark what isn't the article.
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination "
    "popup promo promotion recommended related replies respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: A class that begins so says what an element has or lacks, not what it is.
ABOUT = frozenset("has is no with without".split())
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post postbody story".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NAMED = re.compile(r"[A-Za-z][a-z0-9]*|[A-Z]+(?![a-z])")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Element:
    __slots__ = ("tag", "up", "inside", "beside", "main", "digest")

    def __init__(self, tag: str, up: Element | None, attributes: str = ""):
        self.tag, self.up, self.inside = tag, up, []
        self.beside = self.main = False
        self.digest: int | None = None
        named: set[str] = set()
        for name, value in ATTRIBUTE.findall(attributes) if len(attributes) > 1 else ():
            name, value = name.lower(), unescape(value.strip("\"'"))
            if name in ("class", "id"):
                for one in value.split():
                    words = [w.lower() for w in NAMED.findall(one)]
                    if words and words[0] not in ABOUT:
                        named.update(words)
            elif name == "role":
                self.main |= value.strip().lower() in ("article", "main")
                self.beside |= value.strip().lower() in ROLES
            elif name == "itemprop":
                self.main |= value.strip().lower() == "articlebody"
            elif name == "hidden":
                self.beside = True
        self.beside |= tag in BESIDE or bool(named & BESIDE_WORDS)
        self.main = not self.beside and (self.main or tag in ("article", "main") or tag in ("div", "section", "td") and bool(named & MAIN_WORDS))

    def above(self):
        e = self.up
        while e is not None:
            yield e
            e = e.up


def _open_at(at: Element, tag: str) -> Element:
    """Where a new ``tag`` goes: what it closes is left."""
    if at.tag == "head" and tag not in HEAD:
        at = at.up
    e, last, wall = at, None, WALLS.get(tag, SCOPE)
    closes = CLOSES.get(tag, ())
    while closes and e.up is not None and e.tag not in wall:
        if e.tag in closes:
            last = e
        elif e.tag in BLOCK and tag not in WALLS:
            break
        e = e.up
    return at if last is None else last.up


def _close(at: Element, tag: str) -> Element:
    """Where the page goes on after the end of ``tag``; an end without a beginning changes nothing."""
    wall = TABLE.get(tag, SCOPE)
    e = at
    while e.up is not None and e.tag != tag:
        if e.tag in wall or tag not in BLOCK and tag not in UNSEEN and e.tag in BLOCK:
            return at
        e = e.up
    return e.up or at


def parse(html: str) -> Element:
    """The tree of a page; text stands in it as strings."""
    root = at = Element("html", None)
    pos, size = 0, len(html)
    while pos <= size:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start() if m else size]
        if text:
            if at.tag == "head" and not text.isspace():
                at = at.up
            at.inside.append(unescape(text))
        if not m:
            break
        pos, tag = m.end(), (m[2] or "").lower()
        if tag == "body" and not m[1]:
            while at.tag == "head" or any(e.tag == "head" for e in at.above()):
                at = at.up
        elif tag in ("", "body", "html"):
            continue
        elif m[1]:
            at = _close(at, tag)
        else:
            at = _open_at(at, tag)
            e = Element(tag, at, m[3])
            at.inside.append(e)
            if tag in RAW:
                pos = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(html, pos).end()
            elif tag not in VOID:
                at = e
    return root


def digests(root: Element) -> None:
    """Hashes all elements from the leaves up; one without text has no hash."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo += [c for c in e.inside if not isinstance(c, str) and c.tag not in UNSEEN]
    for e in reversed(order):
        parts = []
        for c in e.inside:
            if isinstance(c, str):
                if s := " ".join(c.split()):
                    parts.append(s)
            elif c.digest is not None:
                parts.append(f"\x01{c.digest:x}")
        if parts:
            e.digest = xxhash.xxh3_64_intdigest("\x02".join([e.tag, *parts]).encode("utf-8", "surrogatepass")) - (1 << 63)


def mains(root: Element) -> list[Element]:
    """The elements that hold the article, outermost and in order; articles before other marks."""
    found: list[Element] = []
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag in UNSEEN or e.beside and e.tag != "form":
            continue
        if e.main:
            found.append(e)
        todo += [c for c in reversed(e.inside) if not isinstance(c, str)]
    for kind in (lambda e: e.tag == "article", lambda e: e.tag == "main", lambda e: e.digest is not None):
        if some := [e for e in found if kind(e)]:
            mine = {id(e) for e in some}
            return [e for e in some if not any(id(u) in mine for u in e.above())]
    return []


def blocks(html: str) -> tuple[list[tuple[str, bool, list[int]]], int]:
    """A page's blocks of text, each with whether its markup lets it into the article and
    the hashes of the subtrees that may be templates; and the class of the page."""
    root = parse(html)
    digests(root)
    marked = mains(root)
    into, holding = {id(e) for e in marked}, {id(u) for e in marked for u in e.above()}
    out: list[tuple[str, bool, list[int]]] = []
    held: list[str] = []
    now: tuple[bool, tuple] = (not marked, ())

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append((text, now[0], list(now[1])))
        held.clear()

    todo: list = [(root, not marked, False, ())]  # what comes, whether in the article, whether beside it, its subtrees
    while todo:
        e, inside, beside, path = todo.pop()
        if isinstance(e, str):
            held.append(e)
            continue
        if e is None:  # a block ends
            flush()
            now = path
            continue
        if e.tag in ("br", "td", "th"):
            held.append(" ")
        if e.tag in UNSEEN:
            continue
        inside = inside or id(e) in into
        own = e is not root and id(e) not in into and id(e) not in holding
        marks = own and (e.beside and e.tag != "header" or e.tag == "header" and not (marked and inside))
        if marks and e.tag not in BLOCK:
            continue
        beside = beside or marks
        if e.tag in BLOCK:
            if own and e.digest is not None and (marks or not marked or not inside or e.tag not in PROSE):
                path = (*path, e.digest)
            flush()
            todo.append((None, inside, beside, now))
            now = (inside and not beside, path)
        todo += [(c, inside, beside, path) for c in reversed(e.inside)]
    flush()
    texts = [t for t, kept, _ in out if kept]
    about = "\n".join(texts) if marked else max(texts, key=len, default="")
    return out, xxhash.xxh3_64_intdigest(about.encode("utf-8", "surrogatepass")) % 64


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", share: float = SHARE, classes: int = CLASSES, workspace: Workspace | None = None) -> DataFrame:
    """``pages`` without their html, with ``text``, its code points ``n_chars``, and how many blocks went as
    parts of a template (``n_template``) and of those left for their markup (``n_markup``)."""
    work = workspace or Workspace(pages.sparkSession)
    host, cls, texts, inside, paths, dead = (fresh(pages, x) for x in ("host", "class", "texts", "inside", "paths", "dead"))
    others = [c for c in pages.columns if c != html_col]

    def parse_all():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            of = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (host, html_col)}
            out: dict[str, list] = {c: [] for c in (cls, texts, inside, paths)}
            for site, page in zip(of[host], of[html_col]):
                found, about = blocks(page or "")
                # a subtree's hash is that of its host too, so it is a key by itself
                salt = xxhash.xxh3_64_intdigest(site.encode()) - (1 << 63) if site else 0
                out[cls].append(about)
                out[texts].append([t for t, _, _ in found])
                out[inside].append([i for _, i, _ in found])
                out[paths].append([[h ^ salt for h in p] if site else [] for _, _, p in found])
            return out

        return run

    named = F.lower(F.nullif(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    fields = {cls: "int", texts: "array<string>", inside: "array<boolean>", paths: "array<array<long>>"}
    parsed = work.cut(append_columns(pages.withColumn(host, named), parse_all, fields, keep=[*others, host]), "parsed", "zstd")

    seen = parsed.select(host, cls, F.explode(F.array_distinct(F.flatten(paths))).alias("sub"))
    counted = seen.groupBy("sub").agg(F.count("*").alias("n"), F.bit_or(F.expr(f"shiftleft(1L, `{cls}`)")).alias("of"), F.first(host).alias(host))
    sizes = work.cut(parsed.groupBy(host).agg(F.count("*").alias("pages")), "hosts")
    many = counted.where(F.bit_count("of") >= classes).join(if_small(sizes, SMALL), host)
    templates = work.cut(many.where(F.col("n") >= share * F.col("pages")).select("sub"), "templates")

    if templates.limit(SMALL + 1).count() <= SMALL:  # eight bytes each go to the executors
        known = parsed.sparkSession.sparkContext.broadcast(np.sort(templates.toArrow()["sub"].to_numpy()))
        rows = parsed
    else:  # each page's own come to it by a join
        known = None
        row = fresh(parsed, "row")
        rows = work.cut(parsed.withColumn(row, F.monotonically_increasing_id()), "rows", "zstd")
        gone = rows.select(row, F.explode(F.array_distinct(F.flatten(paths))).alias("sub")).join(templates, "sub", "left_semi")
        rows = rows.join(gone.groupBy(row).agg(F.collect_set("sub").alias(dead)), row, "left").drop(row)

    def assemble():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in (texts, inside, paths)}
            subs = of[paths].flatten().flatten().to_numpy(zero_copy_only=False)
            if known is not None:
                all_of = known.value
                hit = all_of[np.minimum(np.searchsorted(all_of, subs), max(len(all_of) - 1, 0))] == subs if len(all_of) else np.zeros(len(subs), bool)
                at = 0
            else:
                own = [frozenset(x or ()) for x in batch.column(batch.schema.get_field_index(dead)).to_pylist()]
            out: dict[str, list] = {c: [] for c in ("text", "n_chars", "n_template", "n_markup")}
            for k, (page, there, ways) in enumerate(zip(of[texts].to_pylist(), of[inside].to_pylist(), of[paths].to_pylist())):
                stay = []
                for t, i, way in zip(page, there, ways):
                    if known is not None:
                        at += len(way)
                        if hit[at - len(way) : at].any():
                            continue
                    elif not own[k].isdisjoint(way):
                        continue
                    stay.append((t, i))
                text = "\n".join(t for t, i in stay if i)
                for c, v in zip(out, (text, len(text), len(page) - len(stay), sum(not i for _, i in stay))):
                    out[c].append(v)
            return out

        return run

    new = {"text": "string", "n_chars": "long", "n_template": "long", "n_markup": "long"}
    return append_columns(rows, assemble, new, keep=others)


def op11_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spread(table(spark, sf_dir, "pages")).select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
