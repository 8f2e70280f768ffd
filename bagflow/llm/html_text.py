"""Main text of web pages with a site style tree.

The pages of a host are merged into one style tree: a node is a path of block elements with their classes, over the host's
different pages (branches of articles and main elements count once for each different main text, so that copies of a page
don't pass for boilerplate). With m pages that have the node, its presentation importance is the entropy of its forms (the
sequence of its child elements) over log m, its content importance is 1 minus the mean of log n over log m, where n is the
number of pages on which a text block below it stands in the same place. Its importance is 1 - (1 - presentation) *
(1 - content): a branch matters if its forms or its texts vary. From each page, branches go that are on at least
`least_pages` pages and whose importance is below `least_importance` (headings, which repeat over different texts, go with
their container only), or, for containers outside articles, below `against_siblings` of their most important sibling's.

Branches that HTML itself or their class names mark as menus, headers, footers, sidebars, notices, adverts, forms or
reader comments go too, whatever the tree says of them: hosts with few pages have nothing else to go by. A class name
counts if all its words do (`site-footer`), or if it begins or ends with a word that seldom means anything else
(`related-posts`, `blog-sidebar`, `commentList`) and has no word of a state (`has-sidebar`). Neither names nor forms mark a
main element, an article (but for names of comments) or a branch with most of a page's text (outside an article: unless
the page has its articles elsewhere). A button inside a paragraph is part of its text.
If a page has a main element, or articles with at least half of the text that is left, its text is the text in there;
else what is left of the body. A rule that would leave a page without any text isn't applied to it.

Only hashes of texts, forms and pages are shuffled for the tree, with their path, each once a task; pages are joined with
their host's list of low-importance paths, broadcast if it is small enough. A path has at most 32 elements: what lies
deeper belongs to the node there, so that a page of any depth is read in linear time.

Defined results: null or empty html gives an empty text; pages without a host take part in no tree; repeated rows give
equal texts; an empty table gives an empty result; pages of any length are read whole, and broken markup (unclosed or
stray tags, a cut end) is read as browsers do as far as block elements go.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small, written

_TAG = re.compile(r"""<(?:(!--)|(!|\?)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>)""")
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements by their part in a page.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object "
    "math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template iframe svg xmp noembed noframes select annotation annotation-xml canvas video audio".split())
NOISE_TAGS = set("nav footer aside button dialog menu fieldset head".split())
MAIN = set("article main".split())
#: Elements that end an open paragraph, and those that end an open element of the same kind.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = set("ul ol dl table menu".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog discussion disqus dropdown "
    "footer gdpr hidden legal login menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion reactions "
    "recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split()
)
#: Words of noise that count at the beginning or end of a name, and words of a state, with which they don't.
EDGE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu nav navbar navigation newsletter "
    "pager pagination paywall popup promo promotion recommended related share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
STATES = set("active are closed collapsed disabled enabled free has have is less no non none not off on open opened show shown toggled visible with without".split())
COMMENT_WORDS = set("comment comments disqus reactions replies reply respond".split())
#: Words that say where something is, beside a word of noise in one name.
PLACES = set("area bar block bottom box column container desktop fixed global group inner item items left lower links list main mobile outer page panel primary region right secondary section site sticky top upper wrap wrapper".split())
#: Marked as noise only outside an article.
HEADER_WORDS = set("header masthead hero branding logo".split())
#: Elements that hold others, and how deep a style tree goes.
CONTAINERS = set("aside center details dialog div dl fieldset footer form header hgroup menu nav ol search section table ul".split())
DEPTH = 32
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())


class Block:
    """A run of text with its path of block elements, whether it is in an article (1) or main element (2), whether elements
    call it noise, and the branches around it that names or forms mark as noise: their number and whether they are in an article."""

    __slots__ = ("path", "text", "inside", "noise", "marks")

    def __init__(self, path: tuple, text: str, inside: int, noise: bool, marks: tuple):
        self.path, self.text, self.inside, self.noise, self.marks = path, text, inside, noise, marks


def _attributes(rest: str) -> tuple[str, bool, set]:
    """The class as written, whether the element is hidden, and the names in class, id and role."""
    kind, hidden, names = "", False, set()
    for name, value in _NAME.findall(rest):
        name, written_value = name.lower(), html.unescape(value.strip("\"'"))
        value = written_value.lower()
        if name == "class":
            kind = ".".join(value.replace(">", "").split())
        if name in ("class", "id"):
            names.update(written_value.split())
        elif name == "role":
            names.update("role:" + r for r in value.split())
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return kind, hidden, names


def _named(names: set, words: set, edges: set = frozenset()) -> bool:
    """Whether a name consists of some of these words, and words of place at most; or begins or ends with one of `edges`
    and has no word of a state."""
    for name in names:
        parts = [p.lower() for p in _WORD.findall(name)]
        if not words.isdisjoint(parts) and all(p in words or p in PLACES for p in parts):
            return True
        if parts and (parts[0] in edges or parts[-1] in edges) and STATES.isdisjoint(parts):
            return True
    return False


def blocks(page: str, forms: dict | None = None) -> list[Block]:
    """The blocks of a page in order. `forms` receives the child elements of every path, in order."""
    out: list[Block] = []
    # open block elements: (tag, path, inside an article or main element, noise, marks)
    stack: list[tuple] = [("", (), 0, False, ())]
    opened: Counter = Counter()
    marked = 0
    held: list[str] = []
    last_close: dict[str, int] = {}  # where the last closing tag of a kind stands
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                _, path, inside, noise, marks = stack[-1]
                out.append(Block(path, text, inside, noise, marks))

    def close(tags: set, within: int = 0) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, within, -1):
            if stack[i][0] in tags:
                flush()
                opened.subtract(x[0] for x in stack[i:])
                del stack[i:]
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            held.append(page[at:])
            break
        if lt > at:
            held.append(page[at:lt])
        m = _TAG.match(page, lt)
        if not m:
            if lt + 1 < end and (page[lt + 1].isalpha() or page[lt + 1] == "/" and page[lt + 2 : lt + 3].isalpha()):
                break  # the page ends in a tag
            held.append("<")
            at = lt + 1
            continue
        if m[1] or m[2]:
            stop = page.find("-->" if m[1] else ">", m.end() if m[1] else lt)
            at = end if stop < 0 else stop + (3 if m[1] else 1)
            continue
        at = m.end()
        tag, rest = m[4].lower(), m[5]
        if tag in INLINE:
            if m[3] or not rest:
                continue
            if _attributes(rest)[1]:
                closing = re.compile(f"</{tag}\\s*>", re.I)
                if tag not in last_close:  # looked up once, so that many unclosed elements don't each read to the end
                    last_close[tag] = max((c.start() for c in closing.finditer(page, at)), default=-1)
                if at <= last_close[tag]:
                    at = closing.search(page, at).end()
            continue
        if tag == "button" and opened["p"]:
            continue
        if m[3]:
            if tag == "br":
                held.append(" ")
            elif tag not in VOID:
                close({tag})
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            held.append(" ")
            continue
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, at)
            past = page.find(">", stop.start()) if stop else -1
            at = end if past < 0 else past + 1
            continue
        if tag in ("html", "body"):
            close({"head"})
            continue
        if tag in ENDS_P:
            close({"p"})
        if tag in ENDS_SAME:
            close(ENDS_SAME[tag], next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in LISTS), 0) if any(opened[t] for t in LISTS) else 0)
        flush()
        kind, hidden, names = _attributes(rest) if rest else ("", False, set())
        _, path, inside, noise, marks = stack[-1]
        main = 2 if tag == "main" or "role:main" in names else int(tag in MAIN)
        noise |= tag in NOISE_TAGS or hidden or any(w[5:] in NOISE_ROLES for w in names if w.startswith("role:"))
        noise |= tag == "header" and not inside and not main
        names = {w for w in names if not w.startswith("role:")}
        noisy = tag == "form" or _named(names, NOISE_WORDS, EDGE_WORDS) or not inside and _named(names, HEADER_WORDS)
        if not main and noisy or tag == "article" and _named(names, COMMENT_WORDS, COMMENT_WORDS):
            marked += 1
            marks = (*marks, (marked, inside)) if len(marks) < DEPTH else marks
        step = f"{tag}.{kind}" if kind else tag
        if forms is not None and len(path) <= DEPTH:
            forms.setdefault(path, []).append(step)
        stack.append((tag, (*path, step) if len(path) < DEPTH else path, max(inside, main), noise, marks))
        opened[tag] += 1
    flush()
    return out


def _hash(texts: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(texts)) - (1 << 63)


def node_rows(page: str) -> set[tuple[str, bool, int, int]]:
    """What a page adds to its host's tree: (path, whether of its form, hash of text or form, hash of page or main text)."""
    forms: dict[tuple, list[str]] = {}
    found = blocks(page, forms)
    outside, inside = set(), set()
    for b in found:
        (inside if b.inside else outside).add(b.path)
    whole, main = _hash([page]), _hash([b.text for b in without_noise(found) if b.inside])
    out = {(">".join(b.path), False, _hash([b.text]), main if b.inside else whole) for b in found}
    of = {}
    for paths, key in ((inside, main), (outside, whole)):  # a branch with texts of both counts for the whole page
        for path in paths:
            for k in range(1, len(path) + 1):
                of[path[:k]] = key
    out.update((">".join(path), True, _hash(forms.get(path, [])), key) for path, key in of.items())
    return out


def _size(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def without_noise(found: list[Block]) -> list[Block]:
    """The blocks that markup doesn't call noise. A branch with most of the text isn't noise for its name, unless articles
    or a main element are elsewhere."""
    shown = [b for b in found if not b.noise] or found
    below, main = Counter(), Counter()
    for b in shown:
        for m in b.marks:
            below[m] += len(b.text)
            main[m] += len(b.text) if b.inside else 0
    half, whole = _size(shown) / 2, _size([b for b in shown if b.inside])
    spared = {m for m, n in below.items() if n > half and (m[1] or main[m] == whole)}
    return [b for b in shown if spared.issuperset(b.marks)] or shown


def _low(b: Block, low: set) -> bool:
    return any(">".join(b.path[:k]) in low for k in range(1, len(b.path) + 1))


def main_blocks(found: list[Block], low: set) -> list[Block]:
    """The main text's blocks, given the page's host's paths of low importance."""
    kept = without_noise(found)

    def rest(kept: list[Block]) -> list[Block]:
        return [b for b in kept if not _low(b, low)] if low else kept

    inside = [b for b in kept if b.inside]
    if any(b.inside == 2 for b in inside) or inside and 2 * _size(rest(inside)) >= _size(rest(kept) or kept):
        kept = inside
    return rest(kept) or kept


def main_text(found: list[Block], low: set) -> str:
    return "\n\n".join(b.text for b in main_blocks(found, low))


def _with_host(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))


def style_tree(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path, pages, presentation, content, importance) of every node of every host's style tree; pages counts different ones."""
    df = _with_host(pages, id_col, url_col, html_col).filter("host <> ''").select("host", "html")

    def rows(batches):
        def batch(seen: set):
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen), kinds)], names=["host", "path", "form", "what", "page"])

        seen: set = set()
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((host, *r) for r in node_rows(page))
                if len(seen) > 100_000:
                    yield batch(seen)
                    seen = set()
        if seen:
            yield batch(seen)

    found = df.mapInArrow(rows, "host string, path string, form boolean, what long, page long").distinct()
    counts = found.groupBy("host", "path", "form", "what").agg(F.count("*").alias("n"))
    logs = F.sum(F.col("n") * F.log2("n")).alias("s")
    paths = written(counts.groupBy("host", "path", "form").agg(F.sum("n").alias("n"), logs), "style-nodes")
    forms = paths.filter("form").select("host", "path", F.col("n").alias("pages"), "s")
    # a text counts for every node above it
    steps = F.split("path", ">")
    above = paths.filter("not form").select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), ">"))).alias("path"), F.col("n").alias("texts"), F.col("s").alias("of_texts"))
    above = above.groupBy("host", "path").agg(F.sum("texts").alias("texts"), F.sum("of_texts").alias("of_texts"))
    nodes = forms.join(above, ["host", "path"])
    some = F.col("pages") > 1
    presentation = F.when(some, 1 - F.col("s") / F.col("pages") / F.log2("pages")).otherwise(1.0)
    content = F.when(some, F.greatest(F.lit(0.0), 1 - F.col("of_texts") / F.col("texts") / F.log2("pages"))).otherwise(1.0)
    nodes = nodes.withColumn("presentation", presentation).withColumn("content", content)
    return nodes.select("host", "path", "pages", "presentation", "content", (1 - (1 - F.col("presentation")) * (1 - F.col("content"))).alias("importance"))


def low_paths(tree: DataFrame, *, least_pages: int = 5, least_importance: float = 0.2, against_siblings: float = 0.8) -> DataFrame:
    """(host, low): the paths of each host's branches of low importance."""
    above = F.regexp_replace("path", r"(^|>)[^>]*$", "")
    last = F.regexp_extract("path", r"([^>.]*)(?:\.[^>]*)?$", 1)
    tree = tree.filter(F.col("pages") >= least_pages).withColumn("above", above)
    best = tree.groupBy("host", "above").agg(F.max("importance").alias("best"))
    held = last.isin(*sorted(CONTAINERS)) & ~F.col("path").rlike(r"(^|>)(article|main)\b")
    heading = last.rlike("^h[1-6]$")
    low = tree.join(best, ["host", "above"]).filter((F.col("importance") < least_importance) & ~heading | held & (F.col("importance") < against_siblings * F.col("best")))
    return low.groupBy("host").agg(F.collect_set("path").alias("low"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """page_id, url, text, n_chars, and how many blocks the style tree alone would remove, for every page. Options: see low_paths."""
    low = small(written(low_paths(style_tree(pages, id_col=id_col, url_col=url_col, html_col=html_col), **options), "style-tree"), 50_000)
    df = _with_host(pages, id_col, url_col, html_col)
    kind = df.schema["page_id"].dataType.simpleString()
    df = df.join(low, "host", "left").select("page_id", "url", "html", "low")

    def rows(batches):
        for b in batches:
            texts, removed = [], []
            for page, paths in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                found, low = blocks(page), set(paths or ())
                texts.append(main_text(found, low))
                removed.append(sum(_low(x, low) for x in found) if low else 0)
            cols = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["page_id", "url", "text", "n_chars", "low_blocks"])

    return df.mapInArrow(rows, f"page_id {kind}, url string, text string, n_chars long, low_blocks long")
