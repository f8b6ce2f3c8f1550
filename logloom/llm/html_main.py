"""Main text of web pages: two passes of block rules.

A page is cut at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms, reader comments,
scripts and styles are out by their markup. The others are classified in two passes:

1. By themselves: a high link density is bad; a short block is bad with links in it and open without; of the longer ones the density
   of stop words with the length decides between good, nearly good and bad. Text in a script the stop words are not written in
   is judged by length and links alone, a wide character counting twice.
2. By their neighbours: first the nearly good blocks, then the open ones take the label of the nearest decided blocks before and
   after. Where these differ, a nearly good block, a heading before a good block, or an open block of an article is good.

An article (or main) element is a prior only: what is long in it but poor in stop words (a table, a listing) is in doubt, not
bad, and good where a nearest decided block is; a short block rich in stop words is nearly good; its blocks have their neighbours
within it; and its short blocks are good where nothing in it could be decided. Where a page has an article, a nearly good block outside needs a good neighbour and no bad one.

The page's good blocks are joined by line ends, in page order. Nothing is cut or capped. Null or empty html gives an empty
text. Tags are read as browsers do: a quote opens a value only after ``=``, an end tag closes what is open inside its element, an
element never closed ends with its parent (a menu or the like also where an article, section or other part begins). Pages are
read as far as they go; a tag cut off at the page's end is dropped. Other columns are ignored; repeated rows get equal results;
an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns_checked

#: Elements that break blocks, hold no text of the page, are no content, or have no end tag.
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td "
                  "tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas head".split())
OUT = frozenset("nav footer aside form menu dialog button select fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, the elements an end tag does not reach across, the parts that end an unclosed menu or the like.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "option": ("option",)}
CELLS = frozenset("table caption td th".split())
SCOPE = {"li": CELLS | {"ul", "ol", "menu"}, "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]),
         "tbody": frozenset(["table"]), "thead": frozenset(["table"]), "tfoot": frozenset(["table"]), "table": frozenset(),
         "p": BLOCK - {"p"}, "body": frozenset(), "html": frozenset()}
PARTS = frozenset("article main section nav aside header footer".split())
OUT_END = re.compile(r"</(nav|footer|aside|form|menu|dialog|button|select|fieldset|header)(?=[\s/>])", re.I)
#: Words in class, id and role that mark a part of the page as no content.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|"
    r"subscri\w+|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|disqus|respond|replies|share|"
    r"sharing|social|related|recommended|widget|login|signup|search|pagination|pager|toolbar|skip|copyright|complementary|"
    r"contentinfo|dialog)(?:$|[\s_-])", re.I)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:site-?header|page-?header|top-?bar|header)(?:$|[\s_-])", re.I)
ARTICLE_MARK = re.compile(r"(?:^|[\s_-])(?:article-?body|post-?content|entry-?content|article-?content|main-?content)(?:$|[\s_-])", re.I)
#: Frequent words of nine languages.
STOP_WORDS = frozenset((
    "a an and are as at be but by for from had has have he in is it not of on or that the this to was were what which who will with you "
    "als auch auf aus bei das dem den der des die ein eine er es für hat im in ist mit nicht sich sie sind und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il la le les leur mais ne on ou par pas plus pour qui que sa se son sur un une "
    "al ante con como de del el ella en era es esta fue ha la las lo los más no o para pero por que se sin su un una y "
    "che di del della il gli le non per più sono nel da dal um uma os as do da dos na não em ao mais foi het een van dat niet op te zijn "
    "aan och att det som på är av för inte till i w z na się nie do jest od przez jak").split())

MAX_LINKS, SHORT, LONG = 0.33, 70, 200
STOP_LOW, STOP_HIGH = 0.08, 0.16

#: A comment, declaration or tag. A value is quoted only right after the equals sign; a quote elsewhere is a character like others.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)"""
                 r"""((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)>""", re.S)
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
OPENS = re.compile(r"</?[A-Za-z]")
#: Letters of scripts the stop words are not written in, and those of them that stand for a syllable or a word.
OTHER_SCRIPT = re.compile(r"[\u0370-\u1dff\u2c00-\ua6ff\ua8e0-\ud7ff\uf900-\ufaff\uff66-\uffdc\U00010000-\U0001cfff\U00020000-\U0003ffff]")
WIDE = re.compile(r"[\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")
WORD = re.compile(r"[^\W\d_]+")
ATTRIBUTE = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Block:
    __slots__ = ("text", "links", "article", "heading", "label")

    def __init__(self, text: str, links: int, article: bool, heading: bool):
        self.text, self.links, self.article, self.heading = text, links, article, heading
        self.label = ""


def no_content(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part that is no content, by its name or its marks."""
    if tag in OUT or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("article", "main", "body", "html"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and (MARKS.search(value) or not in_article and PAGE_HEADER.search(value)):
            return True
    return False


def tags(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, match) of the tags, comments and declarations of a page, in one pass; a last one without a match ends the page.

    Where quotes leave a tag without an end, that tag and those after it end at the next ``>``.
    """
    pattern, last, at = TAG, page.rfind(">"), 0
    while (i := page.find("<", at)) >= 0:
        m = (TAG if page[i + 1:i + 2] in ("!", "?") else pattern).match(page, i)
        if m is None:
            if not OPENS.match(page, i):
                at = i + 1
                continue
            if last < i:
                yield i, len(page), None
                return
            pattern = LOOSE
            m = LOOSE.match(page, i)
        at = m.end()
        skip_to = yield i, at, m
        if skip_to is not None:
            at = skip_to
            yield i, at, None


def self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not the end of a value without quotes."""
    if not attributes.rstrip().endswith("/"):
        return False
    value = attributes[attributes.rfind("=") + 1:].strip() if "=" in attributes else ""
    return not value or value == "/" or bool(re.search(r"[\s\"']", value))


class Open:
    """The open elements: (name, ruled out, in an article, never closed), and how many there are of each name."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool, bool]] = []
        self.names: Counter[str] = Counter()
        self.unclosed = 0

    def push(self, tag: str, out: bool, article: bool, unclosed: bool) -> None:
        self.stack.append((tag, out, article, unclosed))
        self.names[tag] += 1
        self.unclosed += unclosed

    def cut(self, i: int) -> None:
        for tag, _, _, unclosed in self.stack[i:]:
            self.names[tag] -= 1
            self.unclosed -= unclosed
        del self.stack[i:]

    def close(self, tag: str) -> None:
        """Close the innermost element of this name with all in it, unless an element that its end tag does not reach across is in between."""
        if not self.names[tag]:
            return
        stop = SCOPE.get(tag, CELLS) if tag in BLOCK else BLOCK
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.cut(i)
                return
            if self.stack[i][0] in stop:
                return

    def end_unclosed(self) -> None:
        """Close the innermost part that has no end tag, with all in it."""
        if self.unclosed:
            self.cut(max(i for i, x in enumerate(self.stack) if x[3]))

    @property
    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:3] if self.stack else (False, False)


def cut(page: str) -> list[Block]:
    """The blocks of a page that are not ruled out by their markup."""
    blocks: list[Block] = []
    words: list[str] = []
    linked: list[str] = []
    opened = Open()
    out = in_article = heading = link = False
    ends = {m[1].lower(): m.start() for m in OUT_END.finditer(page)}  # where the last end tag of each name stands
    endless: set[str] = set()  # raw elements that have no end tag any more

    def flush() -> None:
        text = " ".join(html_module.unescape("".join(words)).split())
        if text:
            blocks.append(Block(text, len(" ".join(html_module.unescape("".join(linked)).split())), in_article, heading))
        words.clear()
        linked.clear()

    def settle() -> None:
        """Take over the state of the element that is now innermost."""
        nonlocal out, in_article
        now = opened.state
        if now != (out, in_article):
            flush()
            out, in_article = now

    def read(stop: int) -> None:
        if stop > at and not out:
            words.append(page[at:stop])
            if link:
                linked.append(page[at:stop])

    at, end = 0, len(page)
    found = tags(page)
    for start, stop, m in found:
        read(start)
        at = stop
        if m is None:
            break
        tag = (m[2] or "").lower()
        if not tag:
            if not out and m[0].startswith("<![CDATA["):
                words.append(page[start + 9:stop].removesuffix("]]>"))
            continue
        if m[1]:  # an end tag
            if tag in BLOCK:
                flush()
                heading = False
            if tag == "a":
                link = False
            opened.close(tag)
            settle()
            continue
        void = tag in VOID or self_closed(m[3])
        if tag in RAW and not void:
            close = None
            if tag not in endless:
                # the head holds no text of the page; a body ends it too
                close = re.compile(r"</head\s*>|(?=<body[\s>])" if tag == "head" else rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, stop)
            if close is None:
                endless.add(tag)
                if tag not in ("script", "style", "textarea", "iframe"):
                    continue
            at = close.end() if close else end
            found.send(at)
            continue
        if tag in BLOCK:
            flush()
            heading = tag in HEADINGS
            link = False
            if tag != "br":
                opened.close("p")
            for other in CLOSES.get(tag, ()):
                opened.close(other)
            if tag in PARTS:
                opened.end_unclosed()
            settle()
        if void:
            continue
        if tag == "a":
            link = True
        drop = out or no_content(tag, m[3], in_article)
        article = in_article or not drop and (tag in ("article", "main") or tag in ("div", "section") and bool(ARTICLE_MARK.search(m[3])))
        opened.push(tag, drop, article, drop and not out and (tag in OUT or tag == "header") and ends.get(tag, -1) < stop)
        settle()
    else:
        read(end)
    flush()
    return blocks


def stop_density(b: Block) -> float:
    words = WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def by_density(b: Block) -> str:
    """good, bad, near or open, from the text of the block alone."""
    if b.links / max(1, len(b.text)) > MAX_LINKS:
        return "bad"
    size = len(b.text) + len(WIDE.findall(b.text))
    if size < SHORT:
        return "bad" if b.links else "open"
    if 2 * len(OTHER_SCRIPT.findall(b.text)) > sum(map(str.isalpha, b.text)):
        return "good" if size > LONG else "near"
    stops = stop_density(b)
    if stops >= STOP_HIGH:
        return "good" if size > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def first_pass(b: Block) -> str:
    """As ``by_density``; inside an article a short block rich in stop words is near, and a long one poor in them without many links in doubt."""
    label = by_density(b)
    if label == "open" and b.article and stop_density(b) >= STOP_HIGH:
        return "near"
    return "doubt" if label == "bad" and b.article and b.links <= MAX_LINKS * len(b.text) and len(b.text) >= SHORT else label


def nearest(blocks: list[Block]) -> list[tuple[str, str]]:
    """For each block the nearest decided labels before and after it; a block of an article looks no farther than the article."""
    def one_way(some: list[Block]) -> list[str]:
        seen, last, inside = [], {True: "", False: ""}, False
        for b in some:
            if b.article and not inside:
                last[True] = ""
            inside = b.article
            seen.append(last[b.article])
            if b.label in ("good", "bad"):
                last[False] = b.label
                if b.article:
                    last[True] = b.label
        return seen

    return list(zip(one_way(blocks), reversed(one_way(blocks[::-1]))))


def classify(blocks: list[Block]) -> list[Block]:
    """Label all blocks; afterwards each is good or bad."""
    for b in blocks:
        b.label = first_pass(b)
    has_article = any(b.article for b in blocks)
    for b, around in zip(blocks, nearest(blocks)):
        if b.label == "near":
            outside = has_article and not b.article
            b.label = "good" if ("good" in around and "bad" not in around if outside else around != ("bad", "bad")) else "bad"
    for b, around in zip(blocks, nearest(blocks)):
        if b.label == "open":
            same = around[0] == around[1] and around[0]
            if same:
                b.label = same
            elif b.heading and around[1]:
                b.label = around[1]
            else:
                b.label = "good" if b.article and ("good" in around or not any(around)) else "bad"
        elif b.label == "doubt":
            b.label = "good" if "good" in around else "bad"
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(cut(page or "")) if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    with_columns_checked(pages, id_col, url_col, html_col)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col), F.col(url_col), F.col(html_col)).mapInArrow(
        run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
