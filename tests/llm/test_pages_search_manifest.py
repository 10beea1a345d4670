"""Page text, tiered search and the manifest: SQL on the test tables, brute force on awkward rows."""

import hashlib
import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import DATA, duck, same
from pyspark.sql import functions as F

from evidentia.llm import merkle_manifest, page_text, tiered_search

SMALL = f"{DATA}/sf0.001"


# -- page text -----------------------------------------------------------------


def test_pages_query(spark):
    """The test tables' articles are flat: their blocks are what stands between headings and paragraphs."""

    def article(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = (re.sub(r"<br>", " ", x).replace("<b>", "") for x in re.split(r"</?h1>|</?p>", inside))
        return "\n".join(t for x in parts if (t := " ".join(html.unescape(x).split())))

    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {(r.page_id, r.url): r for r in page_text.op11_page_text(spark, SMALL).collect()}
    assert len(got) == len(pages)
    for p in pages:
        assert got[p.page_id, p.url].text == article(p.html)
        assert got[p.page_id, p.url].n_chars == len(article(p.html))


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>a<p>b<div>c<ul><li>x<li>y</ul>z", ["a", "b", "c", "x", "y", "z"]),
        ("<title>t</title><p>hello<br>wo\nrld &amp; &am&lt;<td>", ["hello wo rld & &am<"]),
        ("<head><meta x><p>body by itself", ["body by itself"]),
        ("<div class='has-sidebar'><div id=sidebar>s</div><main><h1>T</h1><p>x <span class=share>n</span>y<aside>q</aside></main></div>", ["T", "x y"]),
        ("<article><header><h1>H</h1></header><p>p</p><div id=user-comments><article>c</article></div><footer>f</footer></article><p>out", ["H", "p"]),
        ("<form><article><p>in a form</article></form>", ["in a form"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a b", "c", "d"]),
        ("<article>x<!-- c --><script>'</article>'</script><style>y</style>z</article>", ["xz"]),
        ("<article></article><p>nothing in it", []),
        ("<div role=navigation>m</div><div hidden>h</div><p>t</p><div class='cookieNotice'>k</div>", ["t"]),
        ("<article><p>one</div> two</b> three</p></article><p", ["one two three"]),
        ('<p title="a>b">quoted <a href="c">link</a>', ["quoted link"]),
        ("<p>x" + "<b>" * 5000 + "deep", ["xdeep"]),
        ("<article><h1>T</h1><select><option>1<option>2</select><noscript>n</noscript><p>&nbsp;a&#8217;s\t b&copy;", ["T", "a’s b©"]),
        ("plain", ["plain"]),
        ("", []),
        ("<<p>> 1 < 2 <a href='", ["<", "> 1 < 2"]),
    ],
)
def test_pages_markup(page, texts):
    assert [t for t, inside, _ in page_text.blocks(page)[0] if inside] == texts


def test_pages_cut_off_tags_are_quick():
    assert page_text.blocks("<p>a" + "<a b='c\" " * 20000)[0] == [("a", True, page_text.blocks("<p>a")[0][0][2])]


def _pages():
    rows = []
    for k in range(12):  # notices inside articles go, a line that all articles quote stays
        rows.append((k, f"https://u@One.example.org:80/{k}", f"<nav>Home {k % 2}</nav><article><div>Read our letter</div><p>common line</p><p>own {k}</p></article>"))
    for k in range(12):  # no article is marked: what recurs goes
        rows.append((100 + k, f"http://two.example.org/{k}?q", f"<div>Two's own head</div><p>text of page number {k}</p><p>All rights</p>"))
    rows += [(200 + k, "http://three.example.org/copy", "<div><p>the same page again and again</p></div>") for k in range(20)]
    rows += [(300 + k, u, "<div>seen often</div><p>x %d</p>" % k) for k, u in enumerate([None, "", "/relative", "nonsense", "http://"] * 3)]
    rows += [(400, "http://one.example.org/", None), (401, "http://one.example.org/", ""), (None, "http://one.example.org/", "<article>null id</article>"), (0, "http://one.example.org/0", "<article>id again</article>")]
    return rows + [(500, "http://long.example.org/", "<article>" + "<p>word</p>" * 50_000 + "</article>")]


@pytest.mark.parametrize("most", [0, page_text.SMALL])
def test_pages_rows(spark, most, monkeypatch):
    monkeypatch.setattr(page_text, "SMALL", most)  # 0: joins by shuffle
    rows = _pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("old"), "HOST": F.lit(1), "sub": F.lit(2)}).repartition(5)
    out = page_text.extract_text(df).collect()
    assert len(out) == len(rows) and "HOST" in out[0].asDict() and "html" not in out[0].asDict()
    # brute force: classes and pages of each subtree of each host, in plain Python
    classes, pages, sizes, read = defaultdict(set), Counter(), Counter(), []
    for i, url, page in rows:
        host = (m[1].lower() if (m := re.match(page_text.HOST, url or "")) else None)
        found, cls = page_text.blocks(page or "")
        sizes[host] += 1
        read.append((i, url, host, found))
        for sub in {h for _, _, path in found for h in path} if host else ():
            classes[host, sub].add(cls)
            pages[host, sub] += 1
    dead = {k for k in classes if len(classes[k]) >= page_text.CLASSES and pages[k] >= page_text.SHARE * sizes[k[0]]}
    want = Counter()
    for i, url, host, found in read:
        stay = [(t, inside) for t, inside, path in found if not any((host, h) in dead for h in path)]
        text = "\n".join(t for t, inside in stay if inside)
        want[i, url, text, len(text), len(found) - len(stay), sum(not inside for _, inside in stay)] += 1
    assert Counter((r.page_id, r.url, r.text, r.n_chars, r.n_template, r.n_markup) for r in out) == want
    by_id = {r.page_id: r for r in out if r.page_id != 0}
    assert by_id[3].text == "common line\nown 3" and by_id[3].n_template == 2
    assert by_id[104].text == "text of page number 4" and by_id[104].n_template == 2
    assert by_id[207].text == "the same page again and again"
    assert by_id[302].text == "seen often\nx 2"
    assert by_id[400].text == by_id[401].text == "" and by_id[None].text == "null id"
    assert by_id[500].n_chars == 5 * 50_000 - 1
    assert page_text.extract_text(df.limit(0)).count() == 0


# -- tiered search ---------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def _ranked(docs, items, k=10):
    words = [(i, Counter(_terms(t))) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(sum(w.values()) for _, w in words)
    df = Counter(t for _, w in words for t in w)
    out = Counter()
    for item, text in items:
        scores = []
        for doc, w in words:
            m = 10 + (90 * sum(w.values()) * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * w[t]) // (1000 * w[t] + 8 * m)) for t in set(_terms(text)) if t in w)
            if s:
                scores.append((-s, doc is None, doc or 0, doc))
        out.update((item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k], 1))
    return out


def test_search_query(spark):
    same(tiered_search.op12_tiered_search(spark, SMALL).toPandas(), duck(SMALL).sql(tiered_search.OP12_SQL).df())


def test_search_rows(spark):
    import random

    r = random.Random(5)
    common, rare = ["the", "of", "Être", "to"], [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(r.choice(common if r.random() < 0.7 else rare) for _ in range(r.randrange(1, 40)))) for k in range(300)]
    docs += [(k, docs[7][1]) for k in (900, 901, 902)] + [(7, docs[7][1]), (8, "w1 w2 W3"), (None, docs[7][1]), (None, "w1"), (903, None), (904, ""), (905, "--"), (906, "w5 " * 30_000)]
    items = [(k, " ".join(r.sample(rare, 4) + common)) for k in range(9)] + [(20, docs[7][1]), (20, docs[7][1]), (None, "w1 W2"), (21, None), (22, ""), (23, "unknown"), (24, "the of"), (25, "w5")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"tier0": F.lit(1), "IDS": F.lit("x")}).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(0))
    for options in ({"shard_docs": 16, "block_items": 4}, {"block_terms": 30}, {}):
        got = tiered_search.search(d, i, **options).collect()
        assert Counter((x.item, x.rank, x.doc, x.score) for x in got) == _ranked(docs, items)
    depths = {x.item: x.depth for x in got}
    assert depths[24] > depths[25]  # an item of common words has to be looked for below the first tier
    assert tiered_search.search(d.limit(0), i).count() == 0
    assert tiered_search.search(d, i.limit(0)).count() == 0


def test_search_stops_where_proven():
    """The lower tiers of a shard that can't reach the threshold are never opened."""
    import numpy as np

    first = tiered_search.Tier(tiered_search._packed(np.array([1, 2]), np.array([0, 1, 2]), np.array([0, 3]), np.array([50, 60])))
    below = tiered_search.Tier(tiered_search._packed(np.array([1, 2]), np.array([0, 1, 2]), np.array([1, 0]), np.array([9, 8])))
    opened = []

    def tier(t):
        opened.append(t)
        return (first, below)[t]

    bounds = (np.array([1, 2]), np.array([[9, 8], [0, 0]]))
    assert tiered_search.search_shard(np.array([1, 2]), 5, bounds, tier, 2, 70)[2] == 1 and opened == [0]
    doc, score, read = tiered_search.search_shard(np.array([1, 2]), 5, bounds, tier, 2, 58)
    assert (doc.tolist(), score.tolist(), read) == ([0, 3], [58, 60], 2)


# -- manifest --------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """Root, and each leaf's (place, siblings) level by level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, k in enumerate(at):
            run = nodes[k // 3 * 3 : k // 3 * 3 + 3]
            ways[leaf].append((k % 3, run[: k % 3] + run[k % 3 + 1 :]))
        nodes = [_h(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [k // 3 for k in at]
    return nodes[0], ways


def _manifest(rows):
    def leaf(values):
        return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for row in rows:
        seen = leaf((*row[:4], row[4] and row[4].replace("\n", ""))) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 else leaf(row)
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), seen, row[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: _tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = _tree([trees[g][0] for g in names])
    out = Counter()
    for g, up in zip(names, above):
        for (_, _, own, seen, doc), way in zip(sorted(groups[g]), trees[g][1]):
            folded = seen
            for at, siblings in way + up:
                folded = _h(*siblings[:at], folded, *siblings[at:])
            out[doc, own, trees[g][0], root, _h(*(s for _, x in way + up for s in x)), folded, folded == root] += 1
    return out


def test_manifest_query(spark):
    same(merkle_manifest.op13_merkle_manifest(spark, SMALL).toPandas(), duck(SMALL).sql(merkle_manifest.OP13_SQL).df())


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_rows(spark, levels, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"s{k % 40}", "en", k, f"line\n{k}") for k in range(160)]
    rows += [(7, "hot", None, None, None), (7, "hot", None, None, None), (7, "hot", "en", 7, "other"), (None, "hot", "en", 1, "a\nb"), (None, None, None, None, None), (5, None, "de", 0, ""), (1000, "É", "fr", 3, "x" * 300_000 + "\n"), (10, "single", "en", 2, "a\nb"), (-4, "Z", "en", 1, "\n")]
    monkeypatch.setattr(merkle_manifest, "SMALL", 10 if levels == 2 else 10_000)  # joins by shuffle as well
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({"idx": F.lit(1), "GRP": F.lit(2), "node": F.lit(3)}).repartition(4)
    fields = [F.col(c) for c in merkle_manifest.FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = merkle_manifest.leaf_of([*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    out = merkle_manifest.manifest(df, "doc_id", "source", merkle_manifest.leaf_of(fields), F.when(hit, changed).otherwise(merkle_manifest.leaf_of(fields)), levels=levels).collect()
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in names) for r in out) == _manifest(rows)
    assert all(r.verified == (r.leaf == r.seen) for r in out)
    if levels == 1:
        assert merkle_manifest.manifest(df.limit(0), "doc_id", "source", merkle_manifest.leaf_of(fields)).count() == 0
        alone = merkle_manifest.manifest(df.where("doc_id = 10 AND source = 'single'"), "doc_id", "source", merkle_manifest.leaf_of(fields)).first()
        assert alone.leaf == alone.subroot == alone.root == alone.folded_root and alone.proof_sha256 == _h("")
