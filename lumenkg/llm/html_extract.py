"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  Blocks inside menus, forms, scripts and
the like, or inside elements whose class, id or role is the name of such a part and of
nothing else (comment-list, site-footer), are dropped, articles nested in them too.  A name that only holds such a word
(share-of-market) is a feature: its blocks are judged as if no article were marked around them.
First pass: stop-word density, length and link density label every other block good,
near, short or bad; that the page marks a block as part of its article is one more
feature: it allows more links, and makes a long block of low density near, not bad, while
text outside a marked article is bad.  On a page whose blocks hardly hold any listed stop
word, in a language that the list does not know, density says nothing and length decides.  Second pass: near blocks are good unless bad ones
stand on both sides; then short ones take the label of the nearest decided block in the
same part of the page.

Cases: null and empty pages give an empty text; a page cut off in the middle is read as
far as it goes; repeated rows are each extracted; a page with nothing good gives an empty
text, not null; where names of elements would drop all of a page, they are not looked at;
pages of any length and tags that never end are read in time in proportion to the length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkg.llm.common import prepare, table

# Frequent function words of English, German, French and Spanish; element
# names by role; words that name parts other than the article in class, id or role.
STOP_WORDS = frozenset(
    """a all an and are as at be been but by can for from had has have he her his i if in is it its not of on or our she so
    that the their them there they this to was we were what when which who will with would you your
    als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für haben hat
    hier ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von war was wie wir zu zum zur
    à au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour que
    qui sa se ses son sur un une vous
    al como con de del el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por que se si sin
    sobre son su sus también te un una y ya yo""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead
    title tr ul""".split()
)
DROPPED_TAGS = frozenset("aside button canvas dialog datalist footer form head iframe menu nav noscript object option select svg template textarea title".split())
RAW_TAGS = frozenset("script style noscript textarea title template iframe noembed noframes xmp svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE_TAGS = frozenset(("article", "main"))
DROPPED_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments consent
    contentinfo cookie cookies copyright disqus footer gdpr header hidden login masthead menu modal nav navbar navigation
    newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related reply
    replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar
    widget complementary""".split()
)
#: An open element of the first kind ends where one of the second kind begins.
IMPLIED_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^'">]|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>""", re.S)
CUT_OFF = re.compile(r"<(?:!|\?|/?[A-Za-z])")  # a tag or comment that does not end
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PARTS = re.compile(r"[A-Za-z]+")
# Parts of a name that tell of a layout around other parts, or of a part of the article.
LAYOUT_PARTS = frozenset("layout has with without no grid col columns template theme".split())
ARTICLE_PARTS = frozenset("article content entry post story".split())
#: Parts of a name that say where or in what shape a part stands, not what it is.
SHAPE_PARTS = frozenset(
    """area bar block body bottom box button buttons card center column container desktop feed first float footer global group head heading holder
    icon icons inline inner item items js label last layer left line link links list main mobile module nav outer overlay page pages
    panel posts primary rail region right row secondary section site slot small space stack sticky strip tab tabs text thread title
    top tree ui unit view wrap wrapper zone""".split()
)
#: Dropped elements that pages leave open by mistake: an article inside ends them.
LEFT_OPEN = frozenset("head header button option select".split())
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class BlockRules:
    max_link_density: float = 0.2
    max_article_link_density: float = 0.5
    short_chars: int = 70
    long_chars: int = 200
    stop_low: float = 0.30
    stop_high: float = 0.32
    #: A page whose long blocks have less than this share of stop words is in a language that the list does not know.
    stop_known: float = 0.12


@dataclass
class Block:
    text: str
    link_chars: int
    in_article: bool
    suspect: bool = False
    label: str = ""


def _named(attributes: str, of_article: bool = False) -> str:
    """`drop` where a name in class, id or role is that of a dropped part, alone or with words of shape (ad-slot); `suspect` where it holds such a word beside others; else nothing.

    Layouts (has-sidebar), the article's own header, and articles that name themselves as such too, are neither.
    """
    found = ""
    names = [set(NAME_PARTS.findall(n)) for m in NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()]
    if of_article and any(parts & ARTICLE_PARTS for parts in names):
        return ""
    for parts in names:
        named = parts & DROPPED_NAMES
        if named and not parts & LAYOUT_PARTS and not (named == {"header"} and parts & ARTICLE_PARTS):
            if parts <= DROPPED_NAMES | SHAPE_PARTS | ARTICLE_PARTS:
                return "drop"
            found = "suspect"
    return found


def blocks(page: str, by_name: bool = True) -> list[Block]:
    """Blocks of a page outside dropped elements, white space joined, in page order; without by_name only tags drop."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, str]] = []  # name, dropped, in article, suspect, why it drops ("" where it does so by its parent)
    text: list[str] = []
    links: list[str] = []
    anchors, at, end = 0, 0, len(page)
    last = page.rfind(">")  # behind it no tag ends
    opened: Counter[str] = Counter()  # names on the stack

    def flush() -> None:
        joined = " ".join("".join(text).split())
        if joined:
            out.append(Block(joined, len(" ".join("".join(links).split())), bool(stack) and stack[-1][2], bool(stack) and stack[-1][3]))
        text.clear()
        links.clear()

    def add(raw: str) -> None:
        if raw and not (stack and stack[-1][1]):
            decoded = html.unescape(raw)
            text.append(decoded)
            if anchors:
                links.append(decoded)

    def close() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while at < end:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            add(CUT_OFF.split(page[at:], maxsplit=1)[0])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "a":
            anchors = 0 if closing else 1
        if name == "br" and not (stack and stack[-1][1]):
            text.append(" ")
        if name in BLOCK_TAGS or name in DROPPED_TAGS:
            flush()
        if closing:
            while opened[name] and close() != name:
                pass
            continue
        if name in RAW_TAGS:
            over = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = over.end() if over else end
            continue
        if name in VOID_TAGS or attributes.endswith("/"):
            continue
        if name in ARTICLE_TAGS and stack and stack[-1][1] and {why for *_, why in stack if why} <= LEFT_OPEN:
            while stack and stack[-1][1]:
                close()
        ends = IMPLIED_ENDS.get(name)
        if name in BLOCK_TAGS and stack and stack[-1][0] == "p":
            close()
        if ends and stack and stack[-1][0] in ends:
            close()
        _, up_dropped, up_article, suspect, _ = stack[-1] if stack else ("", False, False, False, "")
        why = "" if up_dropped else name if name in DROPPED_TAGS or (name == "header" and not up_article) else ""
        if by_name and not up_dropped and not why and name not in ("html", "body") and "=" in attributes:
            said = _named(attributes, name in ARTICLE_TAGS)
            why, suspect = said if said == "drop" else "", suspect or said == "suspect"
        dropped = up_dropped or bool(why)
        if name in BLOCK_TAGS or dropped or name in ("span", "section"):
            stack.append((name, dropped, up_article or name in ARTICLE_TAGS, suspect, why))
            opened[name] += 1
    flush()
    return out


def _density(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def _first_pass(block: Block, has_article: bool, known: bool, rules: BlockRules) -> str:
    n, lenient = len(block.text), block.in_article and not block.suspect
    links = block.link_chars / n
    if has_article and not block.in_article or links > (rules.max_article_link_density if lenient else rules.max_link_density):
        return "bad"
    if not lenient and block.text.startswith(("©", "(c)")):
        return "bad"
    if n < rules.short_chars:
        return "bad" if links and not lenient else "short"
    if not known:
        return "good" if n > rules.long_chars else "near"
    density = _density(block.text)
    if density >= rules.stop_high and n > rules.long_chars:
        return "good"
    return "near" if density >= rules.stop_low or lenient else "bad"


def main_text(page: str | None, rules: BlockRules = BlockRules()) -> str:
    if not page:
        return ""
    found = blocks(page) or blocks(page, by_name=False)
    has_article = any(b.in_article for b in found)
    long = " ".join(b.text for b in found if len(b.text) >= rules.short_chars and b.in_article == has_article)
    known = not long or _density(long) >= rules.stop_known
    for b in found:
        b.label = _first_pass(b, has_article, known, rules)
    open_ = [None if b.in_article != has_article else b.label for b in found]  # other parts of the page decide nothing
    for kind in ("near", "short"):
        around = _neighbours(found, open_)
        for i, b in enumerate(found):
            if b.label != kind:
                continue
            near = [x for x in around[i] if x]
            if kind == "near":
                good = len(near) < 2 or any(label == "good" for label, _ in near)
            elif has_article:
                good = not near or any(label == "good" for label, _ in near)
            else:
                good = bool(near) and min(near, key=lambda x: (x[1], x[0] == "bad"))[0] == "good"
            b.label = "good" if good else "bad"
        open_ = [None if b.in_article != has_article else b.label for b in found]
    return "\n".join(b.text for b in found if b.label == "good")


def _neighbours(found: list[Block], labels: list[str | None]) -> list[list[tuple[str, int] | None]]:
    """For each block the nearest decided block before and after it: its label, and the characters in between."""
    around: list[list[tuple[str, int] | None]] = [[None, None] for _ in found]
    for side, order in ((0, range(len(found))), (1, range(len(found) - 1, -1, -1))):
        last = None
        for i in order:
            around[i][side] = last
            if labels[i] in ("good", "bad"):
                last = (labels[i], 0)
            elif last:
                last = (last[0], last[1] + len(found[i].text))
    return around


def extract_main_text(spark: SparkSession, pages: DataFrame, rules: BlockRules = BlockRules(), source: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns keep and text, per page."""
    prepare(spark)
    picked = pages.select(*keep, F.col(source).cast("string").alias("_html"))
    schema = picked.select(*keep).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py(), rules) for p in batch.column(len(keep))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], [*keep, "text"])

    return picked.mapInArrow(run, schema)


def op6_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_main_text(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
