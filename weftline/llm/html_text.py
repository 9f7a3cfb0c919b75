"""Main text of web pages by composite text density (operator 8).

A page is parsed into a tree (unclosed and wrongly nested tags included).
Scripts, styles, forms and what its tag, role, class or id names as page
furniture (menus, headers, footers, sidebars, notices, adverts, reader
comments) are left out. A class or id names furniture as a whole token, but for
words of place and part around it; in an ``article`` or ``main``, words that
articles write about too (related, share, notices) do so only with a word of
part, and a heading's id never does. Every other node gets its composite density: characters
per tag, adjusted by the share of link characters and link tags. A node's score
is the sum of its children's densities; the node of the greatest score is the
core. The lowest density on the path from the body to the core is the
threshold: siblings of the core at or above it belong to the text too. Where the
core lies in an ``article`` or ``main``, the text is that whole element, since a
headline or a short paragraph in it may be less dense than the threshold; where
one in the core holds half of its characters or more, the text is that element.

Defined results: null or empty html, or a page without text, gives ''; a text
outside any tag counts as the body's; rows repeat as they do in the input;
among equal scores the first node in page order wins; columns other than id,
url and html are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe object svg canvas head title select textarea input dialog menu audio video annotation annotation-xml".split())
#: Start tags that end an open element of the named kinds.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
LISTS = frozenset("table ul ol dl select".split())
SCOPE = frozenset("table ul ol dl body html article section div blockquote td th".split())
#: Words of classes and ids that name furniture wherever they stand, and those that do so outside articles only.
PLAIN = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense breadcrumb breadcrumbs byline-share commentlist comments cookie-banner cookie-notice disqus gdpr nav navbar navigation newsletter pagination pager "
    "popup respond sidebar side-nav sidenav skip-link skiplink sponsored subscribe toolbar topbar".split()
)
WIDE = frozenset(
    "banner comment consent cookie cookies disclaimer discuss discussion footer header masthead menu menus modal notice notices promo promos promotion recommended recommendations related replies share sharing social sponsor sponsors "
    "subscription widget widgets".split()
)
#: Those of WIDE that name furniture inside articles too, where a word of part follows.
PAIRED = frozenset("comment consent cookie cookies footer menu promo recommended related share sharing social sponsor widget widgets".split())
PLACES = frozenset("site page global main top bottom left right primary secondary mobile desktop sticky fixed wp js c l o td".split())
PARTS = frozenset("area articles bar block buttons container form icons inner items left links list nav posts right section stories thread toggle widget wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Elements whose content is not markup; all but the first end with the page at the latest.
RAW = frozenset("script style noscript template iframe textarea title svg object".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: An attribute's name and value. A quote opens a value only right after the equals sign; in names and bare values it is a character like others.
NAME = r"(?:=?+[^\s/>=]++|=)"
VALUE = r"(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)"
ATTRIBUTE = re.compile(rf"({NAME})(?:\s*+=\s*+({VALUE}?+))?+")
#: All attributes of a tag, the slash of one that closes itself, and its end.
REST = re.compile(rf"(?:[\s/]*+{NAME}(?:\s*+=\s*+{VALUE}?+)?+)*+([\s/]*+)>")
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


def tokens(page: str) -> Iterator[tuple[int, int, str, bool, str, bool]]:
    """(start, end, name, whether it closes, attributes, whether it ends in a slash) of every tag; names are '' for comments, declarations and elements left out whole.

    One pass: a tag whose quotes do not close ends at the first '>', and from then on quotes are not looked at, so no
    part is read again and again. What opens a tag that never ends is text.
    """
    at, quoted, last = page.find("<"), True, page.rfind(">")
    ends: dict[str, re.Pattern] = {}
    while 0 <= at:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, "", False, "", False
        elif at > last:
            return
        elif m := TAG.match(page, at):
            rest = REST.match(page, m.end()) if quoted else None
            if rest is None:
                quoted = False
                end = page.index(">", m.end()) + 1 if m.end() <= last else 0
                if not end:
                    return
                slash = page[end - 2] == "/"
            else:
                end, slash = rest.end(), "/" in rest[1]
            name = m[2].lower()
            if name in RAW and not m[1]:
                stop = ends.setdefault(name, re.compile(rf"</{name}\s*>", re.I)).search(page, end)
                end = stop.end() if stop else len(page)
                yield at, end, "", False, "", False
            else:
                yield at, end, name, bool(m[1]), page[m.end() : end - 1], slash
        elif page[at + 1 : at + 2] in ("!", "?"):
            end = page.index(">", at) + 1
            yield at, end, "", False, "", False
        else:
            end = at + 1
        at = page.find("<", end)


class Tree:
    """Nodes in page order: parent, tag, whether left out, and the pieces of text."""

    def __init__(self) -> None:
        self.parent, self.tag, self.out = [-1], ["body"], [False]
        self.pieces: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0


@lru_cache(1 << 16)
def names_furniture(token: str, inside_article: bool) -> bool:
    """Whether one class or id, without its words of place and part, is a word for furniture."""
    words = [x for x in token.replace("_", "-").split("-") if x and not x[0].isdigit()]
    last = len(words)
    for first in range(len(words)):
        for end in range(last, first, -1):
            word = "-".join(words[first:end])
            if word in PLAIN or word in WIDE and (not inside_article or word in PAIRED and end < last):
                return True
            if words[end - 1] not in PARTS:
                break
        if words[first] not in PLACES:
            break
    return False


def furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in DROPPED:
        return True
    if tag == "header" and not inside_article:
        return True
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in FURNITURE_ROLES:
            return True
        if name == "id" and tag in HEADINGS or tag in ("article", "main", "body", "html"):
            continue
        if name in ("class", "id") and any(names_furniture(x, inside_article) for x in value.split()):
            return True
    return False


def parse(page: str) -> Tree:
    t = Tree()
    open_nodes, at = [0], 0
    # Where the open elements of each name stand among all open ones, and those that closing tags and list items do not reach beyond.
    places: defaultdict[str, list[int]] = defaultdict(list)
    scopes, lists = [0], [0]
    parent, tags, out, pieces = t.parent, t.tag, t.out, t.pieces
    within = [False]  # whether a node is an article or main, or inside one

    def say(text: str) -> None:
        if text:
            pieces.append((open_nodes[-1], t.block, html.unescape(text) if "&" in text else text))

    def shut(i: int) -> None:
        for k in open_nodes[i:]:
            places[tags[k]].pop()
        del open_nodes[i:]
        for held in (scopes, lists):
            while held[-1] >= max(i, 1):
                held.pop()

    def last_of(names: Iterable[str]) -> int:
        return max((places[x][-1] for x in names if places[x]), default=0)

    for start, end, name, closes, attributes, slash in tokens(page):
        if start > at:
            say(page[at:start])
        at = end
        if not name:
            continue
        if closes:
            if name in BLOCK:
                t.block += 1
            i = last_of((name,))
            if i and (name in BLOCK or i > scopes[-1]):
                shut(i)
            continue
        if name == "html" or name == "body":
            if name == "body" and places["head"]:
                shut(places["head"][0])
            continue
        if name in BLOCK:
            t.block += 1
            if (i := last_of(("p",))) > scopes[-1]:  # a block ends an open paragraph
                shut(i)
        if name in ENDS:
            while (i := last_of(ENDS[name])) > lists[-1]:
                shut(i)
                if name not in ("tr", "tbody"):
                    break
        above = open_nodes[-1]
        parent.append(above)
        tags.append(name)
        out.append(out[above] or furniture(name, attributes, within[above]))
        within.append(within[above] or name in ("article", "main"))
        if name in VOID:
            if name in ("br", "hr", "img"):
                pieces.append((above, t.block, " "))
        elif not slash or name in BLOCK:
            for held, kind in ((places[name], True), (scopes, name in SCOPE), (lists, name in LISTS)):
                if kind:
                    held.append(len(open_nodes))
            open_nodes.append(len(parent) - 1)
    say(page[at:])
    return t


def density(c: int, t: int, lc: int, lt: int, ratio: float) -> float:
    """Composite text density of a subtree with c characters, t tags, lc link characters and lt link tags."""
    if not c:
        return 0.0
    t = max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
    return c / t * (math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / math.log(max(base, 1.0000001)) if base > 1 else 1.0)


def scored(t: Tree) -> tuple[list[int], list[int], list[float], list[float]]:
    """Of each node: characters, link characters, density, and the sum of its children's densities."""
    n = len(t.parent)
    chars, links, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    is_link = [False] * n
    for i in range(1, n):
        p = t.parent[i]
        is_link[i] = is_link[p] or t.tag[i] == "a"
    for node, _, text in t.pieces:
        if not t.out[node]:
            k = len(SPACE.sub("", text))
            chars[node] += k
            if is_link[node]:
                links[node] += k
    for i in range(n - 1, 0, -1):
        if not t.out[i]:
            p = t.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (t.tag[i] == "a")
    ratio = links[0] / max(chars[0], 1)
    dense = [0.0 if t.out[i] else density(chars[i], tags[i], links[i], link_tags[i], ratio) for i in range(n)]
    score = [0.0] * n
    score[0] = dense[0] * 1e-9  # a body without elements is its own core
    for i in range(1, n):
        score[t.parent[i]] += dense[i]
    return chars, links, dense, score


def main_text(page: str | None) -> str:
    if not page:
        return ""
    t = parse(page)
    n = len(t.parent)
    chars, links, dense, score = scored(t)
    if not chars[0]:
        return ""
    core = max((i for i in range(n) if not t.out[i]), key=lambda i: (score[i], -i))
    path = [core]
    while path[-1]:
        path.append(t.parent[path[-1]])
    threshold = min(dense[i] for i in path)
    chosen = {core}
    for whole in ("article", "main"):
        if found := [i for i in path if t.tag[i] == whole]:
            chosen = {found[-1]}
            break
    else:
        below = [False] * n
        for i in range(core, n):
            below[i] = i == core or t.parent[i] >= core and below[t.parent[i]]
        if found := [i for i in range(core, n) if below[i] and not t.out[i] and t.tag[i] in ("article", "main") and chars[i] * 2 >= chars[core]]:
            chosen = {found[0]}
        elif core:
            chosen |= {i for i in range(1, n) if t.parent[i] == t.parent[core] and not t.out[i] and dense[i] >= threshold and links[i] * 2 < max(chars[i], 1)}
    inside = [False] * n
    for i in range(n):
        inside[i] = not t.out[i] and (i in chosen or (i > 0 and inside[t.parent[i]]))
    blocks: dict[int, list[str]] = {}
    for node, block, text in t.pieces:
        if inside[node]:
            blocks.setdefault(block, []).append(text)
    lines = (SPACE.sub(" ", "".join(x)).strip(" ") for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = [main_text(x) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
