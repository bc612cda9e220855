"""Main text of web pages by consensus paths per host.

Each page votes for its article: the innermost container that holds nearly all of its text
outside of noise and links, or a container further out, as long as it adds such text
(below the body; the body itself for headings and paragraphs of its own). A container is
named by its generalised path: tags and classes from the root, digits made equal. Votes
are counted per host in Spark, with the pages on which each path occurs. A path wins on its host,
for one of the host's layouts, if two pages or more vote for it and no less than half of those
that have it. Then every page is extracted again by a winning path: its own, if that wins; if other
pages have its own path and most vote otherwise, the winning path on the page with most votes; if no
other page votes as it does, the first of these that holds nine tenths of its article.
A page without such a path uses its own article.

Defined cases: null and empty html give an empty text. A page whose containers
hold no text gives an empty text. Ties go to the first path by name. A url
without host counts for the host ''. Repeated rows vote each and are extracted
each. Columns of the input pass through `extracted` under any name but the two new ones.
Unclosed and crossed tags are closed where their parents end.

Forms, and elements that a class, id or role names as noise, are rejected however long they are. Looked
into are those, advertisements, comments and links to other articles apart, that hold the only article
or main element of a page; on a page without such, those that hold its only first-level heading and more text
than what is outside of them all; and, where nothing else would be left, the largest one.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import append_columns
from barloom.sources.scratch import cut

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Content that is no text up to the matching end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "math", "object", "canvas", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that are never part of an article; those of the first set break a block.
OUTSIDE_BLOCK = {"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu", "head"}
#: Of these, those that some pages wrap around everything.
AROUND = {"form", "fieldset"}
OUTSIDE = OUTSIDE_BLOCK | {"button", "select", "option", "label"} | RAW
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3",
         "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | OUTSIDE_BLOCK
CONTAINER = {"body", "div", "article", "main", "section", "td", "center", "html"}
#: An opening tag ends an open element of these, as long as no element of the second set lies between.
CLOSES = {"p": ({"p"}, {"table", "td", "div", "article", "section", "blockquote", "li"}), "li": ({"li"}, {"ul", "ol", "menu"}),
          "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()), "option": ({"option"}, {"select"})}
#: Words of class, id or role that name what is around an article.
NOISE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation",
         "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "notice", "popup", "modal", "newsletter",
         "subscribe", "subscription", "comment", "comments", "commentlist", "disqus", "reply", "respond", "share", "sharing", "social", "related", "recommended",
         "widget", "pagination", "pager", "toolbar", "skip", "search", "login", "signup", "copyright", "disclaimer", "gdpr", "alert"}
#: Texts of others, which may well be longer than the article.
OTHERS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adbox", "sponsor", "sponsored", "comment", "comments", "commentlist", "disqus", "reply", "respond", "related", "recommended"}
#: Never noise by name.
KEPT = {"body", "html", "main", "article", "h1", "h2", "b", "i", "em", "strong"}
#: What follows one of these in a name says what else is on the page.
ABOUT = {"has", "with", "no", "without", "is", "not"}
SPLIT = re.compile(r"[^a-z0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
DIGITS = re.compile(r"\d+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Hundredths of the text that are nearly all, and containers that hold whatever is on a page.
NEARLY_ALL = 95
TOP = {"", "html", "body"}
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
#: These reach to the end of the page if no end tag follows, as their content is no text.
TO_THE_END = {"script", "style"}


class Element:
    __slots__ = ("tag", "path", "noise", "named", "link", "place", "parent", "total")

    def __init__(self, tag: str, path: str, noise: bool, link: bool, place: int, parent: Element | None, named: int = 0):
        self.tag, self.path, self.noise, self.link, self.place, self.parent = tag, path, noise, link, place, parent
        #: 1: rejected unless it stands around the article, 2: rejected.
        self.named = named
        self.total = 0


def _attributes(text: str) -> tuple[str, int]:
    """Generalised classes, and whether class, id or role name noise (1) or texts of others (2)."""
    if not text or "=" not in text:
        return "", 0
    classes, noise = "", 0
    for m in ATTRIBUTE.finditer(text):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if name == "class":
            classes = "".join("." + DIGITS.sub("0", c) for c in sorted(value.lower().split()))
        if name in ("class", "id", "role"):
            for token in HUMP.sub("-", value).lower().split():
                words = SPLIT.split(token)
                words = words[:next((k for k, w in enumerate(words) if w in ABOUT), None)]
                if not NOISE.isdisjoint(words):
                    noise = max(noise, 1 if OTHERS.isdisjoint(words) else 2)
    return classes, noise


def _ends(tag: str, page: str) -> dict[int, int]:
    """Where the elements of a tag end, by where they begin; without those that have no end tag."""
    found, opened = {}, []
    for m in re.finditer(rf"""<(/?){re.escape(tag)}(?![^\s/>])((?:[^<>"']|"[^"]*"|'[^']*')*)>""", page, re.I):
        if not m[1]:
            if not SELF_CLOSED.search(m[2]):
                opened.append(m.start())
        elif opened:
            found[opened.pop()] = m.end()
    return found


def _chain(node: Element | None) -> list[Element]:
    """An element and all around it, from the inside."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _sound(blocks: list[tuple[Element, str, int]]) -> list[tuple[Element, str, int]]:
    """Blocks without those in elements that their name or form rejects."""
    plain = any(w for _, _, w in blocks)
    chains = [_chain(owner) for owner, _, _ in blocks]
    gains = [w if plain else len(text) for _, text, w in blocks]
    if not any(e.named for chain in chains for e in chain):
        return blocks
    #: Elements that reject a block, from the inside; and those outside of its outermost article or main element.
    rejecting = [[e for e in chain if e.named] for chain in chains]
    outside = []
    for chain in chains:
        k = max((k for k, e in enumerate(chain) if e.tag in ("article", "main")), default=None)
        outside.append(None if k is None else [e for e in chain[k:] if e.named])
    exempt: set[int] = set()
    if not any(around == [] and gain for around, gain in zip(outside, gains)):
        for around, own in zip(outside, rejecting):
            if around and all(e.named == 1 for e in own):
                exempt.update(e.place for e in around)
        if not exempt:
            exempt = _around_heading(blocks, rejecting, gains)
    while True:
        kept = [i for i, own in enumerate(rejecting) if all(e.place in exempt for e in own)]
        if any(gains[i] for i in kept):
            break
        totals: dict[int, int] = {}
        for own, gain in zip(rejecting, gains):
            outer = next((e for e in reversed(own) if e.place not in exempt), None)
            if outer is not None and outer.named == 1:
                totals[outer.place] = totals.get(outer.place, 0) + gain
        if not totals:
            break
        exempt.add(max(totals, key=lambda place: (totals[place], -place)))
    return [blocks[i] for i in kept]


def _around_heading(blocks: list, rejecting: list[list[Element]], gains: list[int]) -> set[int]:
    """Named elements around the only first-level heading, if the text outside of all named elements is less than theirs."""
    free, total, heads = 0, {}, []
    for (owner, _, _), own, gain in zip(blocks, rejecting, gains):
        head = owner.tag == "h1"
        if not own:
            free += gain
            if head:
                return set()
        for e in own:
            total[e.place] = total.get(e.place, 0) + gain
        if head and all(e.named == 1 for e in own):
            heads.append(own)
    return {e.place for own in heads[:1] if len(heads) == 1 for e in own if total[e.place] > free}


def walk(page: str | None) -> list[tuple[Element, str, int]]:
    """(element, text, characters that are not in links) for every block of text outside of noise, in page order.

    The tree is never built: open elements form a stack, and a block ends where a
    block element begins or ends.
    """
    page = page or ""
    stack = [Element("", "", False, False, 0, None)]
    blocks: list[tuple[Element, str, int]] = []
    parts: list[str] = []
    ends_of: dict[str, dict[int, int]] = {}
    place, at, linked, raw = 0, 0, 0, 0

    def add(text: str) -> None:
        nonlocal linked, raw
        parts.append(text)
        raw += len(text)
        if stack[-1].link:
            linked += len(text)

    def flush() -> None:
        nonlocal linked, raw
        if parts:
            share = 1 - linked / raw if raw else 1
            linked = raw = 0
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                owner = stack[-1]
                while owner.parent is not None and owner.tag not in BLOCK:
                    owner = owner.parent
                blocks.append((owner, text, len(text) if owner.tag in HEADINGS else round(len(text) * share)))

    def close(k: int) -> None:
        """Pop down to k open elements."""
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        del stack[k:]

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at and not stack[-1].noise:
            add(page[at:m.start()])
        at = m.end()
        if m[1] is not None and not stack[-1].noise:
            add(entities.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK and tag not in CLOSES:
            ends, stops = CLOSES["p"]
        else:
            ends, stops = CLOSES.get(tag, ((), ()))
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in ends:
                close(k)
                break
            if stack[k].tag in stops:
                break
        if tag in RAW:
            if tag in TO_THE_END:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            else:
                if tag not in ends_of:
                    ends_of[tag] = _ends(tag, page)
                at = ends_of[tag].get(m.start(), at)
            continue
        if tag in BLOCK:
            flush()
        classes, named = _attributes(m[4])
        parent = stack[-1]
        place += 1
        noise = parent.noise or (tag in OUTSIDE and tag not in AROUND)
        named = max(named if tag not in KEPT else 0, 1 if tag in AROUND else 0)
        path = f"{parent.path}/{tag}{classes}" if tag in CONTAINER else parent.path
        stack.append(Element(tag, path, noise, parent.link or tag == "a", place, parent, named))
    if at < len(page) and not stack[-1].noise:
        add(page[at:])
    flush()
    return _sound(blocks)


def _containers(blocks: list[tuple[Element, str, int]]) -> dict[int, Element]:
    found: dict[int, Element] = {}
    for owner, _, _ in blocks:
        node = owner
        while node is not None:
            if node.tag in CONTAINER or node.parent is None:
                found[node.place] = node
            node = node.parent
    return found


def article(blocks: list[tuple[Element, str, int]]) -> Element:
    """The container that a page votes for."""
    plain = any(w for _, _, w in blocks)
    total: dict[int, int] = {}
    loose: set[int] = set()
    inner: dict[int, set[int]] = {}
    found = _containers(blocks)
    for owner, text, w in blocks:
        node, below = owner, None
        while node is not None:
            if node.place in found:
                total[node.place] = total.get(node.place, 0) + (w if plain else len(text))
                if below is not None:
                    inner.setdefault(node.place, set()).add(below)
                elif node is not owner and (w or not plain):
                    loose.add(node.place)
                below = node.place
            node = node.parent
    at = min(found)
    whole = total[at]
    while True:
        full = [k for k in inner.get(at, ()) if 100 * total[k] >= NEARLY_ALL * whole]
        if not full:
            break
        at = min(full)
    best = node = found[at]
    while node is not None:
        if node.place in found and (node.place in loose if node.tag in TOP else total[node.place] > total[best.place]):
            best = node
        node = node.parent
    return best


def proposals(page: str | None) -> tuple[str | None, list[str]]:
    """The path that a page votes for, and the paths of all its containers."""
    blocks = walk(page)
    if not blocks:
        return None, []
    return article(blocks).path, sorted({c.path for c in _containers(blocks).values()})


def _under(blocks: list, found: dict[int, Element], path: str) -> list[tuple[Element, str, int]]:
    chosen = {k for k, c in found.items() if c.path == path}
    return [block for block in blocks if any(e.place in chosen for e in _chain(block[0]))]


def extract(page: str | None, winners: list[str] | None = None, contested: bool = False) -> tuple[str, str]:
    """Text of the page and the path it was taken from.

    winners: paths to try instead of the page's own article, best first. They must hold
    nine tenths of that article, unless it is contested.
    """
    blocks = walk(page)
    if not blocks:
        return "", ""
    found = _containers(blocks)
    path = article(blocks).path
    paths = {c.path for c in found.values()}
    own = _under(blocks, found, path)
    plain = any(w for _, _, w in blocks)
    whole, mine = 0, set()
    for owner, text, w in own:
        whole += w if plain else len(text)
        mine.add(id(text))
    for winner in winners or ():
        if winner not in paths:
            continue
        part = _under(blocks, found, winner)
        if contested or 10 * sum(w if plain else len(text) for _, text, w in part if id(text) in mine) >= 9 * whole:
            path, own = winner, part
            break
    if plain and path.rsplit("/", 1)[-1].split(".")[0] in TOP:
        # Menus beside the article: list items that are links only.
        own = [block for block in own if block[2] or block[0].tag != "li"]
    return "\n\n".join(text for _, text, _ in own), path


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def main_text(page: str | None, winners: list[str] | None = None, contested: bool = False) -> str:
    return extract(page, winners, contested)[0]


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, key (hash of the html), own (the path voted for), paths: one row per page, written to the shared folder."""
    fields = [T.StructField("own", T.StringType()), T.StructField("paths", T.ArrayType(T.StringType()))]
    slim = pages.select(host_of(F.col(url)).alias("host"), F.sha2(F.col(html).cast("binary"), 256).alias("key"), F.col(html).alias("html_"))
    found = append_columns(slim, lambda texts: [list(x) for x in zip(*map(proposals, texts))], "html_", fields)
    return cut(found.drop("html_").where(F.col("own").isNotNull()), "page-votes")


def host_paths(voted: DataFrame) -> DataFrame:
    """host, path, pages, score, wins: the paths voted for, the pages that have them, their votes.

    Votes are added up before they move, so a host with a third of all pages costs no more than any other.
    """
    found = voted.select("host", "own", F.explode("paths").alias("path")).groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("own") == F.col("path")).alias("score"))
    return found.where("score > 0").withColumn("wins", (F.col("score") > 1) & (2 * F.col("score") >= F.col("pages")))


def _choices(voted: DataFrame, paths: DataFrame) -> DataFrame:
    """host, key, winners, contested for the pages whose own path does not win: the winning paths on them, best first.

    Joined by path, so that no host's paths ever meet in one row; a row has the paths of one page at most.
    """
    own = paths.where("not wins").select("host", F.col("path").alias("own"), (2 * F.col("score") < F.col("pages")).alias("contested"))
    lost = voted.join(own, ["host", "own"]).select("host", "key", "contested", "paths").dropDuplicates(["host", "key"])
    there = lost.select("host", "key", "contested", F.explode("paths").alias("path")).join(paths.where("wins").select("host", "path", "score"), ["host", "path"])
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "path")))
    return there.groupBy("host", "key").agg(F.transform(best, lambda v: v["path"]).alias("winners"), F.first("contested").alias("contested"))


def extracted(pages: DataFrame, url: str = "url", html: str = "html", text: str = "text_", path: str | None = None) -> DataFrame:
    """pages with the main text and, if `path` names a column for it, the path that it was taken from.

    Votes, paths and choices are written first: Spark then knows the size of these tables and
    broadcasts them only if they are small; beyond that, pages are joined by host and hash of
    the page, and a hot page is split.
    """
    voted = votes(pages, url, html)
    paths = cut(host_paths(voted), "host-paths")
    chosen = cut(_choices(voted, paths), "page-paths")
    new = [F.col("text").alias(text), *([F.col("path").alias(path)] if path else [])]
    if {n.lower() for n in (text, path) if n} & {c.lower() for c in pages.columns}:
        raise ValueError("a new column has the name of one that exists")
    whole = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), host_of(F.col(url)).alias("host"),
                         F.sha2(F.col(html).cast("binary"), 256).alias("key"), F.col(html).alias("html"))
    joined = whole.join(chosen, ["host", "key"], "left")
    # One array per page: html, 1 if its own path is contested, winning paths.
    args = joined.select("page", F.concat(F.array("html", F.when(F.col("contested"), F.lit("1"))), F.coalesce("winners", F.array().cast("array<string>"))).alias("args"))
    fields = [T.StructField("text", T.StringType()), T.StructField("path", T.StringType())]
    out = append_columns(args, lambda rows: [list(x) for x in zip(*[extract(h, w, c is not None) for h, c, *w in rows])], "args", fields)
    return out.select("page.*", *new)
