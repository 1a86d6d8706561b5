"""Main text of web pages: subtrees that a host repeats across its pages are its template and go.

1. A task parses each page and hashes its element subtrees.  Pages of a host that are equal throughout count once; (host, hash)
   pairs of the others are counted in Spark with partial sums, so a host with a third of all pages is no hot group.
2. Subtrees on at least ``share`` and ``least`` of a host's distinct pages make its template, whatever the host's size.  How many
   there can be per host is bounded by elements per page / share.  The page itself, ``html`` and ``body`` are never template.
3. Pages are read again with their host's template: its subtrees are deleted, and so are elements that the contract
   excludes by their tags, roles or names (menus, headers, footers, forms, scripts, comments, ...).  Inside
   an article only containers can be template, so a short paragraph that several articles share stays; inline
   elements are never deleted alone, nor is a subtree with more than half of the page's text.  A name counts by its last part that doesn't only say
   where the element stands, so ``user-comments`` goes and ``has-comments`` stays; neither name nor
   role drops a page's first ``article`` or ``main`` or what holds it; later ones may be readers' comments.

The article is all outermost ``<article>`` and ``<main>`` elements together, or the whole body if there are none or if what else the body
has is more than twice as long as they are (then they are teasers).  Blocks are
joined by a space in page order; white space inside a block is one space; references are decoded.

Defined results: null or empty html gives an empty text; a null or unparsable url is a host of its own (empty);
repeated rows count as one page; a page of which template removal leaves nothing keeps its template; an attribute's quote that never
closes ends with its tag, and a tag that never closes ends the page; time is linear in a page's length, however it is nested; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import BROADCAST_BYTES, bounded_batches, written

#: Element names by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("script style noscript template iframe object embed svg canvas math head title nav header footer aside form button select option textarea input label fieldset dialog menu audio video map xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("div section ul ol dl table aside nav header footer form figure details".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar "
    "toolbar share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager skip search searchbox".split()
)

#: Parts of a name that say where or how an element stands, not what it is.
PLACES = frozenset("site page main top bottom left right upper lower global primary secondary inner outer box block bar area section wrapper wrap container list slot unit panel item items fixed sticky mobile desktop".split())

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[-_:]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_VERSION = re.compile(r"v?[0-9]*")
_BLANK = re.compile(r"\s*")
_HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)
#: The page as a whole, which copies of one page repeat.
WHOLE = frozenset(("#", "html", "body"))
_PARTS = 16  #: into which a host's template candidates are dealt
_SALTS = 32  #: into which a host's pages are dealt where templates are joined
#: An element that begins closes these, up to the ancestor that holds them.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_SCOPE = frozenset("article section div ul ol dl table body main nav header footer aside form figure blockquote html".split())


class Node:
    __slots__ = ("tag", "dropped", "named", "children", "digest", "size")

    def __init__(self, tag: str, dropped: bool = False, named: bool = False):
        self.tag, self.dropped, self.named, self.children, self.digest, self.size = tag, dropped, named, [], 0, 0


#: Parts of a name after which a furniture word only says what a page has or lacks.
HAS = frozenset("has have with no not without hide is".split())
_LONG = tuple(sorted(n for n in NAMES if len(n) > 5))


def _furniture_word(word: str) -> bool:
    """A furniture word, or one glued to another word: ``adbanner``, ``usercomments``."""
    return word in NAMES or word.endswith(_LONG) or any(word[:k] in NAMES and word[k:] in NAMES | PLACES or word[:k] in PLACES and word[k:] in NAMES for k in range(2, len(word) - 1))


@lru_cache(1 << 16)
def _names_furniture(name: str) -> bool:
    """Whether a class or id names what the contract excludes, by its last part that is no place, number or version."""
    parts = [p.rstrip("0123456789").lower() for p in _PART.split(_CAMEL.sub("-", name))]
    while len(parts) > 1 and (parts[-1] in PLACES or _VERSION.fullmatch(parts[-1])):
        parts.pop()
    if not HAS.isdisjoint(parts):
        return False
    return _furniture_word(parts[-1])


def _excluded_by_name(attributes: str) -> bool:
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, names = key.lower(), (a or b or c).split()
        if key in ("class", "id") and any(map(_names_furniture, names)):
            return True
        value = " ".join(names).lower()
        if key == "role" and value.strip() in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag whose name ends at ``at`` has its ``>``, or -1.  ``last``: where each kind of quote stands last."""
    while (m := _STOP.search(html, at)) and m[0] == "=":
        at = _BLANK.match(html, m.end()).end()
        if last.get(html[at : at + 1], -1) > at:
            at = html.index(html[at], at + 1) + 1
    return m.start() if m else -1


class _Open:
    """The elements that are open, with the places of each tag, so that closing one takes no search."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.scopes = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in _SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, tags, anywhere: bool = False) -> None:
        """Close the innermost element of ``tags`` and what it holds, if no scope stands between."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if not at or not anywhere and self.scopes[-1] > at:
            return
        while len(self.nodes) > at:
            gone = self.nodes.pop()
            self.places[gone.tag].pop()
            if gone.tag in _SCOPE:
                self.scopes.pop()


def _raw_end(html: str, tag: str, at: int) -> tuple[int, int]:
    m = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
    return m.span() if m else (len(html), len(html))


def parse(html: str | None) -> Node:
    """A tree of the page; text children are undecoded strings.  Bad markup never fails."""
    root, html = Node("#"), html or ""
    stack, last, at, begin = _Open(root), {q: html.rfind(q) for q in "\"'"}, 0, 0
    found = False  # an article or main

    def text(end: int) -> None:
        if end > begin:
            stack.nodes[-1].children.append(html[begin:end])

    while (at := html.find("<", at)) >= 0:
        sign = html[at + 1 : at + 2]
        m = _TAG.match(html, at + 1)
        if not m and sign not in ("!", "?"):
            at += 1  # a plain character
            continue
        text(at)
        if not m:
            comment = html.startswith("<!--", at)
            end = html.find("-->" if comment else ">", at)
            at = begin = len(html) if end < 0 else end + (3 if comment else 1)
            continue
        end = _tag_end(html, m.end(), last)
        if end < 0:
            begin = len(html)
            break
        attributes, at, begin = html[m.end() : end], end + 1, end + 1
        tag = m[2].lower()
        if m[1]:
            stack.close((tag,), tag in _SCOPE)
            continue
        if closes := _CLOSES.get(tag) or ({"p"} if tag in _CLOSE_P else None):
            stack.close(closes)
        node = Node(tag, tag in DROPPED, bool(attributes) and tag not in ("html", "body") and _excluded_by_name(attributes))
        stack.nodes[-1].children.append(node)
        if not found and tag in ("article", "main"):
            found = True
            for x in (node, *stack.nodes):
                x.named = False
        if tag in RAW:
            end, at = _raw_end(html, tag, at)
            node.children.append(html[begin:end])
            begin = at
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            stack.push(node)
    text(len(html))
    return root


def digests(root: Node) -> list[Node]:
    """Gives every element with text the hash of its subtree (tags and text) and the size of its text; returns these elements."""
    out, work = [], [(root, False)]
    while work:
        node, done = work.pop()
        if not done:
            work.append((node, True))
            work += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        h, full, size = xxhash.xxh64(node.tag), False, 0
        for c in node.children:
            if isinstance(c, str):
                if c := " ".join(c.split()):
                    h.update("t" + c)
                    full = True
                    size += len(c)
            elif c.digest:
                h.update(b"e" + c.digest.to_bytes(8, "little"))
                full = True
                size += c.size
        node.digest = h.intdigest() if full else 0
        node.size = 0 if node.dropped or node.named else size
        if full:
            out.append(node)
    return out


def _blocks(roots: list[Node], template: set[int], whole: int) -> str:
    out: list[str] = []
    run: list[str] = []

    def close():
        if text := _SPACE.sub(" ", unescape("".join(run))).strip():
            out.append(text)
        run.clear()

    def repeated(node, inside):
        return node.digest in template and node.tag not in INLINE and node.tag not in WHOLE and 2 * node.size <= whole and (not inside or node.tag in CONTAINERS)

    work: list = [(root, False) for root in reversed(roots)]
    while work:
        node, inside = work.pop()
        if node is None:
            close()
        elif isinstance(node, str):
            run.append(node)
        elif not (node.dropped or node.named or repeated(node, inside)):
            inline = node.tag in INLINE
            inside = inside or node.tag in ("article", "main")
            if not inline:
                close()
                work.append((None, inside))
            work += [(c, inside) for c in reversed(node.children)]
    close()
    return " ".join(out)


def main_text(html: str | None, template: set[int] = frozenset()) -> str:
    """The page's text without the template's subtrees."""
    root = parse(html)
    if template:
        digests(root)
    tops, work = [], [root]
    while work:
        node = work.pop()
        if isinstance(node, str) or node.dropped or node.named:
            continue
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            work += reversed(node.children)
    whole = root.size
    if found := _blocks(tops, template, whole):
        body = _blocks([root], template, whole)
        return found if 3 * len(found) >= len(body) else body
    return _blocks([root], template, whole) or template and (_blocks(tops, set(), whole) or _blocks([root], set(), whole)) or ""


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, digests): hash of the whole page and of its distinct subtrees."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("digests", pa.list_(pa.int64()))])
        for batch in batches:
            host, page, found = [], [], []
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root = parse(html)
                each = {node.digest - (1 << 63) for node in digests(root)}
                host.append(host_of(url))
                page.append(root.digest - (1 << 63))
                found.append(list(each))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return pages.mapInArrow(run, "host string, page long, digests array<long>")


def _with_host(pages: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(host_of, batch.column(1).to_pylist()), pa.string())], names=[*batch.schema.names, "host"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields, StructField("host", StringType())]))


def site_templates(pages: DataFrame, share: float, least: int) -> DataFrame:
    """(host, template): hashes of the subtrees on at least ``share`` of a host's distinct pages and on ``least``."""
    distinct = _subtrees(pages).groupBy("host", "page").agg(F.first("digests").alias("digests"))
    # the page itself goes along as a null
    each = distinct.select("host", F.explode(F.concat(F.array(F.lit(None).cast("long")), "digests")).alias("digest"))
    counts = written(each.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n")).where(f"digest IS NULL OR n >= {least}"), "subtrees")
    # a host's candidates are dealt over parts, and each part brings them together before the host does
    hosts = counts.where("digest IS NULL").select("host", F.col("n").alias("pages"), F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))).alias("part"))
    found = counts.where("digest IS NOT NULL").withColumn("part", F.pmod("digest", F.lit(_PARTS)).cast("int")).join(hosts, ["host", "part"])
    parts = found.where(F.col("n") >= F.col("pages") * share).groupBy("host", "part").agg(F.collect_list("digest").alias("template"))
    return written(parts.groupBy("host").agg(F.flatten(F.collect_list("template")).alias("template")), "templates")


def extract(pages: DataFrame, share: float = 0.2, least: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: page_id, url, text, n_chars.

    A subtree is template if it is on at least ``share`` of the host's distinct pages and on ``least`` of them.
    """
    bounded_batches(pages.sparkSession, 500)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    templates = site_templates(rows.select("url", "html"), share, least)
    size = templates.agg(F.sum(F.size("template") * 8 + F.length("host") + 16)).first()[0] or 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            url = batch.column(1).to_pylist()
            if shared is None:
                known = [set(x or ()) for x in batch.column(3).to_pylist()]
            else:
                known = [shared.value.get(host_of(u), frozenset()) for u in url]
            texts = [main_text(h, {x + (1 << 63) for x in t}) for h, t in zip(batch.column(2).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    shared = None
    if size <= BROADCAST_BYTES // 4:  # checked; beyond that the templates are joined
        shared = pages.sparkSession.sparkContext.broadcast({r[0]: frozenset(r[1]) for r in templates.collect()})
    else:
        # a host may have a third of all pages: they are dealt over salts, and its template is copied to each
        salts = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = _with_host(rows).withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(_SALTS)).cast("int"))
        rows = salted.join(salts.hint("merge"), ["host", "salt"], "left").select("page_id", "url", "html", "template")
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
