"""Main text of web pages: removal of subtrees that recur over a host's pages, and rules for what does not recur."""

from __future__ import annotations

import html
import re
from hashlib import blake2b
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, table, with_key

#: A subtree is a site template if it stands in this many places and on this share of a host's pages.
LEAST_PLACES, LEAST_SHARE = 5, 0.5
#: The table of templates is broadcast up to this size; a larger one is joined by host.
BROADCAST_BYTES = 16_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends open elements of these kinds, if nothing of the second kind is in between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
KEEPS_P = frozenset("br button option".split())

#: Elements that are never main text.
SKIPPED = frozenset("head nav header footer aside form dialog menu select button datalist svg canvas audio video object iframe".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark what surrounds an article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " sidebar rail header masthead topbar footer colophon cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription"
    " signup signin login register share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion"
    " widget widgets toolbar pagination pager skip hidden alert form search".split()
)
NEVER_MARKED = frozenset("html body main".split())
#: Elements whose text is that of links and controls, and the share of it from which on a structure can be a template;
#: letters of a box with a class or id, and without elements of text, that can be one for its shortness.
LINKS, LINKED, SHORT = frozenset("a button label option summary".split()), 0.5, 120
#: Elements of text, which are never a template by their structure, and neither is what holds an article.
OWN = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>\"']|\Z)", re.IGNORECASE)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.IGNORECASE) for tag in RAW}
PLAIN = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"[0-9]+")


def skipped(tag: str, attributes: str) -> bool:
    """Whether an element's tag, role, class or id says that it is not main text."""
    if tag in SKIPPED:
        return True
    if not attributes or tag in NEVER_MARKED:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in SKIPPED_ROLES:
            return True
        if name in ("class", "id") and not MARKS.isdisjoint(PLAIN.split(value)):
            return True
    return False


class Page:
    """The elements of a page, parents before children, and its pieces of text with the element of each.

    Tags may be missing, crossed or cut off: a block ends an open paragraph, an end tag ends all that was
    opened since its start tag, and what has no start tag is passed over.
    """

    def __init__(self, source: str, rules: bool = True):
        self.tags, self.parents, self.attributes, self.skip, self.hashes = ["#page"], [0], [""], [False], [b""]
        self.rules = rules
        self.pieces: list[tuple[int, str | None]] = []  # None: a new block begins
        parts: list[list[bytes]] = [[]]
        stack, count, at, n = [0], {}, 0, len(source)

        def close(depth: int) -> None:
            while len(stack) > depth:
                e = stack.pop()
                count[self.tags[e]] -= 1
                inner = parts[e]
                if inner:
                    self.hashes[e] = blake2b(self.tags[e].encode() + b"(" + b",".join(inner), digest_size=8).digest()
                    parts[stack[-1]].append(self.hashes[e])
                parts[e] = []
                if self.tags[e] in BLOCKS:
                    self.pieces.append((stack[-1], None))

        def said(text: str) -> None:
            if text:
                text = html.unescape(text) if "&" in text else text
                plain = " ".join(text.split())
                self.pieces.append((stack[-1], text))
                if plain:
                    parts[stack[-1]].append(plain.encode("utf-8", "surrogatepass"))

        def end_open(kinds, barriers) -> None:
            if not any(count.get(k) for k in kinds):
                return
            for depth in range(len(stack) - 1, 0, -1):
                tag = self.tags[stack[depth]]
                if tag in barriers:
                    return
                if tag in kinds:
                    top = depth
                    while self.tags[stack[top - 1]] in kinds:
                        top -= 1
                    return close(top)

        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                said(source[at:])
                break
            said(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            attributes = m[3] or m[6] or ""
            if m[1] or m[4]:
                if count.get(tag):
                    depth = len(stack) - 1
                    while self.tags[stack[depth]] != tag:
                        depth -= 1
                    close(depth)
                elif tag in BLOCKS:
                    self.pieces.append((stack[-1], None))
                continue
            if tag in BLOCKS:
                if tag not in KEEPS_P:
                    end_open({"p"}, {"table", "button"})
                if tag in CLOSES:
                    end_open(*CLOSES[tag])
                self.pieces.append((stack[-1], None))
            if tag in RAW:
                end = RAW_END[tag].search(source, at)
                at = end.end() if end else n
                continue
            if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
                continue
            self.tags.append(tag)
            self.parents.append(stack[-1])
            self.attributes.append(attributes)
            self.skip.append(rules and skipped(tag, attributes))
            self.hashes.append(b"")
            parts.append([])
            count[tag] = count.get(tag, 0) + 1
            stack.append(len(self.tags) - 1)
        close(1)
        if parts[0]:
            self.hashes[0] = blake2b(b"#page(" + b",".join(parts[0]), digest_size=8).digest()
        self._judge()

    def _judge(self) -> None:
        """Finds the spine, the elements that hold the main text, and undoes the marks of what it stands in.

        The spine goes down to the largest `article` or `main`; without one, or without rules, it goes down
        as long as one child has over half of the text.
        """
        size = [0] * len(self.tags)
        for e, text in self.pieces:
            if text:
                size[e] += len(text)
        for e in range(len(size) - 1, 0, -1):
            size[self.parents[e]] += size[e]
        articles = [e for e, t in enumerate(self.tags) if t in ("article", "main") and not self.skip[e]] if self.rules else []
        first = max(articles, key=lambda e: size[e], default=None)
        last = first or 0
        if first is None:
            for e in range(1, len(size)):
                if self.parents[e] == last and 2 * size[e] > size[last]:
                    last = e
        self.spine, e = [], last
        while e:
            self.spine.append(e)
            e = self.parents[e]
        self.spine.append(0)
        self.around = set(self.spine[:-1]) if first is not None else set()
        for e in self.around:
            self.skip[e] = False
        gone, self.inside = [False] * len(self.tags), [first is None] * len(self.tags)
        for e in range(1, len(self.tags)):
            gone[e] = gone[self.parents[e]] or self.skip[e]
            self.inside[e] = self.inside[self.parents[e]] or self.tags[e] in ("article", "main")
        self.gone = gone

    def beside(self) -> dict[int, bytes]:
        """What may be furniture beside the spine, each element with the hash of its place and of its structure.

        A structure has tags, classes, ids and roles, but no text and no digits, and equal neighbours count
        once; so a menu of other entries or a footer with another sentence has the same one. Only elements that
        are mostly links, are short boxes with a class or id, or that tag, role, class or id name as furniture,
        may go by their structure: paragraphs, headings, longer boxes and articles are a page's own however often
        their structure recurs.
        """
        spine, found = set(self.spine), {}
        below = {e for e in range(1, len(self.tags)) if self.parents[e] in spine and e not in spine and self.parents[e] != self.spine[0] and self.hashes[e] and self.tags[e] not in OWN}
        if below:
            likely = self.likely()
            below = {e for e in below if e in likely or skipped(self.tags[e], self.attributes[e])}
        if not below:
            return found
        top = [0] * len(self.tags)
        for e in range(1, len(top)):
            top[e] = e if e in below else top[self.parents[e]]
        inner: dict[int, list[str]] = {}
        for e in range(len(top) - 1, 0, -1):
            if not top[e] or not self.hashes[e]:
                continue
            marks = " ".join(f"{m[1].lower()}={DIGITS.sub('', m[2] or m[3] or m[4] or '')}" for m in ATTRIBUTE.finditer(self.attributes[e])) if self.attributes[e] else ""
            shape = f"{self.tags[e]} {marks}({','.join(inner.pop(e, ()))})"
            if e in below:
                place = [self.tags[self.parents[e]]]
                found[e] = blake2b(f"{place}{shape}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
                continue
            near = inner.setdefault(self.parents[e], [])
            if not near or near[-1] != shape:
                near.append(shape)
        return found

    def likely(self) -> set[int]:
        """The elements that can be furniture by their text, without those that hold an article.

        At least LINKED of it is in links and controls; or it is SHORT, has no paragraph or heading, and its
        element has a class or id.
        """
        inside, text, links, holds, own = ([kind] * len(self.tags) for kind in (False, 0, 0, False, False))
        for e in range(1, len(inside)):
            inside[e] = inside[self.parents[e]] or self.tags[e] in LINKS
        for e, said in self.pieces:
            n = len("".join(said.split())) if said else 0
            text[e] += n
            links[e] += n * inside[e]
        for e in range(len(inside) - 1, 0, -1):
            holds[e], own[e] = holds[e] or self.tags[e] in ("article", "main"), own[e] or self.tags[e] in OWN
            up = self.parents[e]
            text[up], links[up], holds[up], own[up] = text[up] + text[e], links[up] + links[e], holds[up] or holds[e], own[up] or own[e]
        named = lambda e: any(m[1].lower() in ("class", "id") for m in ATTRIBUTE.finditer(self.attributes[e]))
        return {e for e in range(1, len(inside)) if text[e] and not holds[e] and (links[e] >= LINKED * text[e] or text[e] <= SHORT and not own[e] and named(e))}

    def subtrees(self) -> set[tuple[bytes, bytes]]:
        """(hash, where it stands) of all subtrees with text but those that hold the article, whatever rules say of them.

        A subtree stands in its parent, with all of that one's text; a structure beside the spine in its page.
        """
        keep, page = ("html", "body", "main", "article"), self.identity()
        exact = {(self.hashes[e], self.hashes[self.parents[e]]) for e in range(1, len(self.tags)) if self.hashes[e] and e not in self.around and self.tags[e] not in keep}
        return exact | {(h, page) for h in self.beside().values()}

    def identity(self) -> bytes:
        """A hash of the page's main elements, or of the end of its spine where there is none; copies of an article have the same."""
        if self.inside[0]:
            return self.hashes[self.spine[0]]
        main = [self.hashes[e] for e in range(1, len(self.tags)) if self.inside[e] and not self.inside[self.parents[e]] and not self.gone[e]]
        return blake2b(b",".join(main), digest_size=8).digest()

    def text(self, templates: frozenset[bytes] = frozenset()) -> str:
        """The blocks of main text, joined by spaces, without `templates`."""
        gone = list(self.gone)
        if templates:
            beside = self.beside()
            for e in range(1, len(gone)):
                gone[e] = gone[e] or gone[self.parents[e]] or e not in self.around and (self.hashes[e] in templates or beside.get(e) in templates)
        blocks: list[list[str]] = [[]]
        for e, text in self.pieces:
            if text is None:
                blocks.append([])
            elif self.inside[e] and not gone[e]:
                blocks[-1].append(text)
        return " ".join(" ".join(x) for x in ("".join(b).split() for b in blocks) if x)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def subtree_batches(rules: bool):
    """A mapInArrow function over (url, html) that gives (host, subtree, place, page) and, for the page itself, nulls and page."""

    def find(batches):
        for batch in batches:
            hosts, subtrees, places, identities = [], [], [], []
            for url, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source or "", rules)
                found = [(None, None), *page.subtrees()]
                hosts += [host_of(url)] * len(found)
                subtrees += [x for x, _ in found]
                places += [x for _, x in found]
                identities += [page.identity()] * len(found)
            columns = [pa.array(hosts, pa.string()), *(pa.array(x, pa.binary()) for x in (subtrees, places, identities))]
            yield pa.RecordBatch.from_arrays(columns, ["host", "subtree", "place", "page"])

    return find


def host_batches(batches):
    for batch in batches:
        hosts = [host_of(u) for u in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, pa.string())], [*batch.schema.names, "host"])


def text_batches(rules: bool):
    """A mapInArrow function over (KEY, html, templates, others) that gives (KEY, text, others)."""

    def extract(batches):
        for batch in batches:
            texts = [Page(h, rules).text(frozenset(t or ())) if h else "" for h, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[3:]], [KEY, "text", *names[3:]])

    return extract


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = LEAST_PLACES, share: float = LEAST_SHARE, rules: bool = True) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur over a host's pages.

    Counted are whole subtrees of the page with their text, and, beside the spine of elements that hold the
    main text, structures without it. A whole subtree's places are the different subtrees it stands in, so
    the paragraphs of an article that was copied whole count once; a structure's are its pages. Pages with
    the same main elements count as one page, both of those a subtree is on and of the host's. A host has
    at most subtrees / share templates, so its list is bounded by the size of its pages.
    """
    rows = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(subtree_batches(rules), "host string, subtree binary, place binary, page binary")
    counted = rows.groupBy("host", "subtree").agg(F.count_distinct("place").alias("places"), F.count_distinct("page").alias("on"))
    counted = durable(counted.filter(F.col("subtree").isNull() | (F.col("places") >= least)))
    sizes = counted.filter("subtree is null").select("host", F.col("on").alias("pages"))
    places = counted.filter("subtree is not null")
    return places.join(sizes, "host").filter(F.col("on") >= share * F.col("pages")).groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(
    pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = LEAST_PLACES, share: float = LEAST_SHARE, keep: tuple[str, ...] = (), rules: bool = True
) -> DataFrame:
    """(KEY, text, and the columns `keep`) of `pages` (with KEY).

    Removed are the templates of the page's host, which are looked for in the whole page: menus, headers,
    sidebars and footers recur in their structure on hosts with at least `least` different pages. For what
    does not recur, as on small hosts and inside articles, `rules` supplement them: kept is what stands in
    `article` and `main` elements, or in the body where there is none, without navigation, headers,
    footers, asides, forms, scripts and the like by tag, role, class or id. Null and empty pages have an
    empty text; a null or broken url is a host of its own name, the empty one.
    """
    found = durable(site_templates(pages, url_col, html_col, least, share, rules))
    size = found.agg(F.coalesce(F.sum(F.size("templates") * 8 + F.length("host")), F.lit(0))).first()[0]
    kept = [F.col(c).alias(f"{KEY}_{i}") for i, c in enumerate(keep)]
    others = "".join(f", {KEY}_{i} {dict(pages.dtypes)[c]}" for i, c in enumerate(keep))
    hosted = pages.select(KEY, F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), *kept)
    hosted = hosted.mapInArrow(host_batches, f"{KEY} long, url string, html string{others}, host string")
    joined = hosted.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")
    names = [f"{KEY}_{i}" for i in range(len(keep))]
    texts = joined.select(KEY, "html", "templates", *names).mapInArrow(text_batches(rules), f"{KEY} long, text string{others}")
    return texts.select(KEY, "text", *[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)])


def op2_html_extraction(spark, sf_dir):
    """The main text of every page."""
    pages = with_key(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    texts = main_text(pages, keep=("page_id", "url"))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
