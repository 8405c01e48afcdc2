"""Main text of HTML pages by the maximum-scoring subsequence of words and tags."""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled pages (pages that mark their article) that the weights are fitted on, at most, and their length at most.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 50_000
#: A token that the labelled pages have so often counts half by its log odds, half by the default.
ENOUGH = 20
#: Bounds of the fitted weights: few sites' habits shouldn't cut others' articles.
WORD_BOUNDS, LINK_BOUNDS, TAG_BOUNDS, PART_BOUNDS = (0.3, 1.0), (-0.5, 0.5), (-3.0, -0.1), (-1.0, 1.0)

#: HTML element names by role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript template iframe xmp noembed noframes".split())
#: Elements whose text no reader of the page reads as such, and elements that are parts of a page beside its article.
MUTE = frozenset("head title script style textarea noscript template iframe svg math object canvas audio video select button xmp noembed noframes".split())
PARTS = frozenset("nav aside footer form dialog menu".split())
CONTAINERS = frozenset(("article", "main"))
#: Words that mark an element as no part of the article when they stand in its class, id or role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc footer masthead sidebar aside complementary rail "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay toast paywall "
    "comment comments commentlist reply replies disqus discussion respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login search searchform form widget contentinfo".split()
)
#: Words that name no topic beside a mark ("share-buttons", not "share-price").
FRAMES = frozenset("area articles bar block bottom box button buttons column container content form frame group header holder icon icons inner item items left link links list news outer panel post posts right row section slot stories title top unit wrap wrapper".split())
#: Words of a page's top, and words that say a top is an article's.
PAGE_TOP = frozenset(("header", "topbar"))
OF_ARTICLE = frozenset("article entry post story content main body text".split())
#: Words that make of a class a state or a topic of the element ("has-sidebar", "share-enabled", "tag-advertising"), not its role.
STATES = frozenset("has with without no not is enabled disabled open opened closed active inactive on off free layout category tag type format status".split())
#: Elements whose ids are anchors and whose text runs on in the article.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements whose start ends a paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: Elements that hold a whole page keep their content even if a mark stands in their class.
WHOLE = frozenset(("html", "body", "main", "article"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']++|"[^"<]*"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
MARK_WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Kind (text, link, open, close), value (text, or element name), name of the part of a page that holds it or '', number of that part, and open article or main elements.
Item = tuple[str, str, str, int, int]


@dataclass(frozen=True)
class PageWeights:
    """Log odds of article against the rest: of a word, of a word in a link, of tags by name, and of words and tags in parts of a page by the part's name."""

    word: float = 1.0
    link_word: float = 0.1
    tags: dict[str, float] = field(default_factory=dict)
    part_words: dict[str, float] = field(default_factory=dict)
    part_tags: dict[str, float] = field(default_factory=dict)
    other_tag: float = -0.1
    other_part_word: float = -0.5
    other_part_tag: float = -0.5

    def of(self, item: Item) -> float:
        kind, value, part, _, _ = item
        if kind in ("text", "link"):
            weight = self.part_words.get(part, self.other_part_word) if part else self.word if kind == "text" else self.link_word
            return weight * len(value.split())
        return self.part_tags.get(part, self.other_part_tag) if part else self.tags.get(f"{kind} {value}", self.other_tag)


def _names(value: str) -> list[list[str]]:
    """Words of each name in a class, id or role, but for names of a state."""
    names = (MARK_WORD.findall(CAMEL.sub(" ", name).lower()) for name in value.split())
    return [words for words in names if words and STATES.isdisjoint(words)]


def _mark(name: str, attributes: str, inside: bool, in_article: bool) -> str:
    """The word by which class, id or role say that the element is a part beside the article, ``hidden`` for hidden ones, or ''. A header is the page's unless it is ``inside`` an article or named after one.

    A mark is the first or last word of a name; ``inside`` an article or main element all words of the name have to be marks or words of FRAMES. Ids
    of headings and inline elements are anchors and mark nothing; nor do, ``inside``, their classes and the ids of sections, nor, ``in_article``, any id.
    """
    flowing = name in HEADINGS or name in INLINE
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and "display:none" in value.lower().replace(" ", "")):
            return "" if name in WHOLE else "hidden"
        if key in ("aria-hidden", "style"):
            continue
        if flowing and (inside or key == "id") or key == "id" and (in_article or inside and name == "section"):
            continue
        for words in _names(value):
            found = [w for w in (words[0], words[-1]) if w in MARKS]
            if not found or inside and not all(w in MARKS or w in FRAMES for w in words):
                continue
            if name not in WHOLE or (name == "article" and found[0] in ("comment", "comments", "ad", "related", "promo", "sponsored", "advert", "reply")):
                return found[0]
        roles = {w for words in _names(value) for w in (words[0], words[-1])}
        if roles & PAGE_TOP and not inside and name not in WHOLE and OF_ARTICLE.isdisjoint(MARK_WORD.findall(CAMEL.sub(" ", value).lower())):
            return "header"
    return ""


def page_items(page: str, parts: frozenset[str] = PARTS) -> list[Item]:
    """The page as a list of items in page order, references in texts decoded.

    Text of mute elements is left out. The outermost element that is a part of the page beside its article, by
    element name or by a mark, names the part that all in it belongs to. End tags close down to their element; ones that match nothing are dropped. A paragraph whose
    end tag is left out ends where a block begins. The start of an article or main element ends parts that an unclosed element began, unless it is one itself.
    """
    out: list[Item] = []
    stack: list[tuple[str, bool, bool]] = []  # name, whether it began a part, whether it is mute
    opened: Counter[str] = Counter()
    depth = mute = links = inside = number = 0
    part = ""
    at, end = 0, len(page)
    last = page.rfind(">")

    def put(kind: str, value: str) -> None:
        out.append((kind, value, part, number if part else 0, inside))

    def pop() -> None:
        nonlocal depth, mute, links, inside, part
        name, began, silent = stack.pop()
        opened[name] -= 1
        mute -= silent
        if not mute:
            put("close", name)
        depth -= began
        part = part if depth else ""
        links -= name == "a"
        inside -= name in CONTAINERS

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if stop > at and not mute:
            put("link" if links else "text", html_lib.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA[") and not mute:
                put("text", m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        attributes = m[3] or m[6] or ""
        mark = _mark(name, attributes, inside > 0, opened["article"] > 0) or (name if name in parts or (name == "header" and not inside) else "")
        if name in CONTAINERS and (depth or mute) and not mark and not opened["article"]:
            stack[:] = [(n, False, False) for n, _, _ in stack]
            depth = mute = 0
            part = ""
        if name in ENDS_P and opened["p"]:
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            while k < len(stack) and stack[k][0] == "p":
                pop()
        elif name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
            pop()  # their end tags may be left out
        silent = name in MUTE
        if mark and not depth:
            part, number = mark, number + 1
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            if not mute:
                put("open", name)
            part = part if depth else ""
            continue
        if not mute and not silent:
            put("open", name)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            part = part if depth else ""
            continue
        stack.append((name, bool(mark), silent))
        opened[name] += 1
        depth += bool(mark)
        mute += silent
        links += name == "a"
        inside += name in CONTAINERS
    return out


def fit_weights(pages: list[str]) -> PageWeights:
    """Weights from pages that mark their article: what stands in it is content, the rest, its own tags included, is not.

    Each weight is the log of a token's share among content tokens by its share among the others, add-one
    smoothed, drawn towards the default where the token is rare, and within the documented bounds.
    """
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for page in pages:
        for kind, value, part, _, inside in page_items(page):
            to = counts[inside > 0 and not (kind in ("open", "close") and value in CONTAINERS)]
            if kind in ("text", "link"):
                to["word in", part] += bool(part) * len(value.split())
                to[kind, ""] += (not part) * len(value.split())
            elif part:
                to["tag in", part] += 1
            else:
                to["tag", f"{kind} {value}"] += 1
    if not all(sum(c.values()) for c in counts):
        return PageWeights()
    totals = [sum(c.values()) + len(c) for c in counts]

    def weight(key: tuple[str, str], bounds: tuple[float, float], default: float) -> float:
        log_odds = math.log((counts[1][key] + 1) / totals[1] / ((counts[0][key] + 1) / totals[0]))
        n = counts[0][key] + counts[1][key]
        return max(bounds[0], min(bounds[1], default + (log_odds - default) * n / (n + ENOUGH)))

    w = PageWeights()
    seen = {k for c in counts for k, n in c.items() if n}
    by_name = lambda kind, bounds, default: {name: weight((k, name), bounds, default) for k, name in seen if k == kind}
    word, link = weight(("text", ""), WORD_BOUNDS, w.word), weight(("link", ""), LINK_BOUNDS, w.link_word)
    return PageWeights(word, link, by_name("tag", TAG_BOUNDS, w.other_tag), by_name("word in", PART_BOUNDS, w.other_part_word), by_name("tag in", TAG_BOUNDS, w.other_part_tag))


def without_parts(items: list[Item], weights: PageWeights) -> list[Item]:
    """The items without the parts beside the article whose own score, of all their words and tags, isn't above zero; each leaves a gap, which counts as a tag."""
    score: Counter[int] = Counter()
    for item in items:
        if item[2]:
            score[item[3]] += weights.of(item)
    out: list[Item] = []
    gap = 0
    for item in items:
        if not item[2] or score[item[3]] > 0:
            out.append(item)
        elif item[3] != gap:
            gap = item[3]
            out.append(("open", "hr", "", 0, item[4]))
    return out


def best_region(items: list[Item], weights: PageWeights) -> tuple[int, int]:
    """First and last place (end exclusive) of the contiguous run with the highest score, by one linear scan; the first of equals."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, item in enumerate(items):
        total += weights.of(item)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def _flows(item: Item) -> bool:
    return item[0] in ("text", "link") or item[1] not in BLOCKS


def whole_blocks(items: list[Item], a: int, b: int) -> tuple[int, int]:
    """The region with the rest of the blocks that it begins and ends in: a linked last word is part of its sentence."""
    if a == b:
        return a, b
    while a > 0 and _flows(items[a - 1]) and _flows(items[a]):
        a -= 1
    while b < len(items) and _flows(items[b]) and _flows(items[b - 1]):
        b += 1
    return a, b


def region_text(items: list[Item]) -> str:
    """Blocks joined by a blank line each; white space within a block is one blank."""
    blocks, now = [], []
    for kind, value, *_ in items:
        if kind in ("text", "link"):
            now.append(value)
        elif value == "br":
            now.append(" ")
        elif value in BLOCKS:
            blocks.append(now)
            now = []
    blocks.append(now)
    return "\n\n".join(t for b in blocks if (t := " ".join("".join(b).split())))


def main_text(page: str | None, weights: PageWeights) -> str:
    """Main text of a page; empty if it has none."""
    for parts in (PARTS, PARTS - {"form"}):  # some pages stand in one form as a whole
        items = without_parts(page_items(page or "", parts), weights)
        a, b = whole_blocks(items, *best_region(items, weights))
        if text := region_text(items[a:b]):
            return text
    return ""


def sample_weights(pages: DataFrame, html_col: str = "html", sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> PageWeights:
    """Fit on a bounded sample: the ``sample_pages`` first in hash order among distinct pages with an article element and at most ``sample_chars`` code points."""
    marked = pages.select(F.col(html_col).cast("string").alias("_h")).where((F.length("_h") <= sample_chars) & F.contains(F.col("_h"), F.lit("<article")))
    # The first pages in hash order lie below this share of all hashes, so no task sorts or sends more than a few times the sample; copies meet after map-side aggregation.
    share = (2 * sample_pages + 100) / max(1, marked.count())
    if share < 1:
        marked = marked.where(F.xxhash64("_h") < int(share * 2**64) - 2**63)
    rows = marked.distinct().orderBy(F.xxhash64("_h"), "_h").limit(sample_pages).collect()
    return fit_weights([r["_h"] for r in rows])


def extract_main_text(pages: DataFrame, weights: PageWeights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page from its whole html.

    Words and tags score as ``weights`` say. Those in menus, headers, footers, sidebars, notices, adverts, forms and reader comments, parts
    known by element name or by words of class, id or role, have weights by the part's name; a part whose score isn't positive is left out. Among
    the rest one linear scan finds the best contiguous region, which is completed to whole blocks. Scripts, styles and other mute elements give no text.

    Nulls: a null page counts as empty and gives an empty text; null ids and urls stay null. Repeated rows are treated
    each. An empty table gives an empty result. Other columns are ignored. Rows stay where they are: no shuffle.

    Returns page_id, url, text.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": [main_text(p, weights) for p in b["html"]]})

    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = extract_main_text(pages, sample_weights(pages))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
