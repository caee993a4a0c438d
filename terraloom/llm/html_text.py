"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser is fed a page piece by piece.  Its events cut the page into blocks (the lines of the
method), each with its characters, its tags, its share of link text and the elements that enclose it.  The ratio of
characters to tags per block is smoothed with a Gaussian, which does not reach across the border of a marked element;
blocks at or above the threshold (the standard deviation of the smoothed ratios) are the content clusters.

The clusters decide.  An element's mass is the sum of the smoothed ratios of the clustered blocks in it.  From the page
downwards the element with the most mass is entered as long as it holds SHARE of the mass around it: the last is the
core, whatever it is called.  The main region is the core with the unmarked text that lies beside it in its parents, and
every block of the region is kept, short ones too.

Elements and names only veto, or break ties:

* what no reader sees or what is no prose (_NEVER) and what readers wrote (_REMARKS: its ratios are those of prose) never counts;
* nav, header, footer and aside, and names of _MARKS, are marked: they are no part of a core that they lie in.  Where no
  element holds SHARE of the mass, a marked element goes only if its mean ratio is below that of the unmarked text; with fewer than
  FEW unmarked characters on the page the ratios say too little, and the mark decides;
* an article or main element that holds the core, or is its only one, ends the widening of the region; blocks of mostly link text outside
  the core's own element are menus.

Per page and in bounded memory: no shuffle, one page is held at a time, and every step is linear in the page.

Defined cases: null, empty or text-free html gives the empty text; markup that is cut off or badly nested is read as far
as it goes; of elements with equal mass the first is entered; repeated rows and null ids are kept as they are; other
columns of the input are not returned.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: Elements whose text is never part of the article.
_NEVER = frozenset("head title script style noscript template form fieldset button select option textarea input iframe object svg math canvas audio video dialog menu datalist map".split())
#: Elements that are marked whatever they are named.
_FRAME = frozenset("nav header footer aside".split())
_CONTAINER = frozenset("html body div section article main table tbody tr td center blockquote ul ol dl".split())
_MAIN = frozenset(("article", "main"))
#: The page as a whole, and parts of a list or table: neither is a container of its own.
_PAGE = frozenset(("", "html", "body"))
_PARTS = frozenset("td tr tbody table ul ol dl blockquote".split())
#: Words of class, id and role that mark what surrounds an article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice "
    "notices alert sidebar sidebars sidenav nav navbar navigation menu menus breadcrumb breadcrumbs masthead header footer copyright comment "
    "comments disqus respond reply replies share sharing social related recommended recirculation newsletter subscribe subscription signup login "
    "paywall popup modal dialog overlay tooltip toolbar pagination pager widget widgets complementary contentinfo search tags".split()
)
#: Beginnings of such words where they are run together with others.
_STEMS = ("advert", "adslot", "adsense", "adsby", "adunit", "adbox", "sponsor", "breadcrumb", "commentlist", "commentsection", "commentbox", "commentform", "commentthread", "cookie", "newsletter", "sidebar", "subscri", "disqus", "navmenu", "sitenav", "sitefooter", "siteheader")
#: Marks that name what a reader wrote: however much text is in it, it is not the page's own.
_REMARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: A class that starts with one of these tells of the page's layout.
_LAYOUT = frozenset("has with no without is js".split())
#: What follows one of these in a class is what the page has, not what the element is.
_HAVING = re.compile(r"(?<![a-z])(?:has|with|no|without)(?![a-z]).*")
_WORDS = re.compile(r"[a-z]+")
_GAP = re.compile(r"\s+")
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BARRIER = frozenset("table td th ul ol dl div section article main body nav aside form header footer blockquote".split())
SIGMA = 1.0
#: An element is entered while it holds this share of the mass around it.
SHARE = 0.8
#: With fewer unmarked characters than this, marks decide instead of ratios.
FEW = 400
_PIECE = 1 << 16


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[tuple[str, int]] = [("", -1)]  # tag and parent of each container or marked element
        self.marked: set[int] = set()  # by class, id or role
        self.remarks: set[int] = set()  # those of them that hold what readers wrote
        self.hard: set[int] = set()  # by tag
        self.stack: list[tuple[str, int]] = []  # open elements with the node each is in
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack by tag
        self.barriers: list[int] = [-1]  # places of elements that a closing tag inside does not reach beyond
        self.blocks: list[tuple[str, int, int, int]] = []  # text, tags, link characters, node
        self.parts: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.node = 0

    def flush(self) -> None:
        text = _GAP.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append((text, max(self.tags, 1), self.links, self.node))
            self.tags = 0
        self.parts, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK:
            self.flush()
            shut = _CLOSES.get(tag) or (() if tag in ("br", "hr") else ("p",))
            k = max((self.where[t][-1] for t in shut if self.where[t]), default=-1)
            if k >= self.barriers[-1] and k >= 0:
                self.pop_to(k)
        self.tags += 1
        if tag in _VOID:
            return
        hidden = marks = remarks = False
        role = ""
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.lower().split():
                    words = _WORDS.findall(_HAVING.sub("", one))
                    remarks = remarks or not _REMARKS.isdisjoint(words) or any(w.startswith("comment") for w in words)
                    marks = marks or bool(words) and words[0] not in _LAYOUT and (not _MARKS.isdisjoint(words) or any(w.startswith(_STEMS) for w in words))
                role = value.strip().lower() if name == "role" else role
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                hidden = True
        kind = "main" if role == "main" else "article" if role == "article" else tag
        own = self.node
        marks = marks or tag in _FRAME
        if kind in _CONTAINER or tag in _NEVER or hidden or marks or kind in _MAIN:
            self.nodes.append((kind, self.node))
            own = len(self.nodes) - 1
            if tag in _NEVER or hidden:
                self.hard.add(own)
            elif marks and tag not in ("html", "body"):
                self.marked.add(own)
                if remarks:
                    self.remarks.add(own)
        self.where[tag].append(len(self.stack))
        if tag in _BARRIER:
            self.barriers.append(len(self.stack))
        self.stack.append((tag, self.node))
        self.node = own
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCK:
            self.flush()
        self.tags += 1
        k = self.where[tag][-1] if self.where[tag] else -1
        if k >= 0 and (tag in _BLOCK or k >= self.barriers[-1]):
            self.pop_to(k)

    def pop_to(self, k: int) -> None:
        self.node = self.stack[k][1]
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.where[tag].pop()
            if tag in _BARRIER:
                self.barriers.pop()
            self.in_link -= tag == "a"

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.in_link:
            self.links += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the kernel's weights renormalised at both ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def _read(html: str) -> _Blocks:
    page = _Blocks()
    for k in range(0, len(html), _PIECE):
        page.feed(html[k : k + _PIECE])
    page.close()
    page.flush()
    return page


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text of one page."""
    if not html:
        return ""
    html = _CUT_OFF.sub("", html)
    try:
        page = _read(html)
    except AssertionError:  # the parser's answer to some broken declarations
        page = _read(html.replace("<![", "&lt;!["))
    nodes = page.nodes
    # A mark on an element around an unmarked article is on the page's frame.
    frames = set()
    for k in range(1, len(nodes)):
        tag, up = nodes[k]
        if tag in _MAIN and k not in page.marked and k not in page.hard:
            while up > 0 and up not in frames and nodes[up][0] not in _MAIN:
                frames.add(up)
                up = nodes[up][1]
    off = _inside(nodes, page.hard | page.remarks - frames)
    blocks = [b for b in page.blocks if not off[b[3]]]
    if not blocks:
        return ""
    # The outermost marked element around each node; 0 for none.
    mark = [0] * len(nodes)
    for k in range(1, len(nodes)):
        mark[k] = mark[nodes[k][1]] or (k if k in page.marked and k not in frames else 0)
    ratio = np.concatenate([smoothed(np.array([len(t) / n for t, n, _, _ in run]), sigma) for run in _runs(blocks, mark)])
    chosen = ratio >= ratio.std()
    size: Counter[int] = Counter()
    for t, _, _, node in blocks:
        size[mark[node]] += len(t)
    weak = {k for k, n in size.items() if k and n < FEW and size[0] < FEW}
    core = _core(nodes, [(float(r), b[3]) for r, b, high in zip(ratio, blocks, chosen, strict=True) if high and mark[b[3]] not in weak])
    path = {core}
    k = core
    while k > 0:
        k = nodes[k][1]
        path.add(k)
    # Marked elements go, but those that the core lies in, and those that the ratios speak for.
    veto = page.marked - frames - path
    if nodes[core][0] in _PAGE and size[0] >= FEW:
        spoken = defaultdict(list)
        for (t, _, _, node), r in zip(blocks, ratio, strict=True):
            spoken[mark[node]].append((len(t), r))
        veto -= {k for k, said in spoken.items() if k and _mean(said) >= _mean(spoken[0])}
    off = _inside(nodes, page.hard | page.remarks - frames | veto)
    blocks = [b for b in blocks if not off[b[3]]]
    region = _region(nodes, core, [(len(t), node) for t, _, links, node in blocks if 2 * links <= len(t)], off)
    within = _inside(nodes, {region})
    own = _inside(nodes, {k for k in range(1, len(nodes)) if nodes[k][0] in _MAIN or k == core and nodes[k][0] not in _PAGE})
    return "\n".join(t for t, _, links, node in blocks if within[node] and (own[node] or 2 * links <= len(t)))


def _runs(blocks: list, mark: list[int]) -> Iterator[list]:
    """The blocks in runs that no border of a marked element cuts."""
    return (list(run) for _, run in groupby(blocks, key=lambda b: mark[b[3]]))


def _mean(said: list[tuple[int, float]]) -> float:
    """Mean of values by weight."""
    return sum(size * value for size, value in said) / sum(size for size, _ in said)


def _inside(nodes: list, roots: set[int]) -> list[bool]:
    """Whether each node lies in one of ``roots``; a node's parent comes before it."""
    out = [0 in roots] * len(nodes)
    for k in range(1, len(nodes)):
        out[k] = k in roots or out[nodes[k][1]]
    return out


def _core(nodes: list, masses: list[tuple[float, int]]) -> int:
    """The innermost element that SHARE of the mass leads to."""
    mass = _sums(nodes, masses)
    best = [0] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        up = nodes[k][1]
        if mass[k] > 0 and (not best[up] or mass[k] >= mass[best[up]]):
            best[up] = k
    at = 0
    while best[at] and mass[best[at]] >= SHARE * mass[at] and (nodes[at][0] in _PAGE or nodes[best[at]][0] not in _PARTS):
        at = best[at]
    return at


def _region(nodes: list, core: int, plain: list[tuple[int, int]], off: list[bool]) -> int:
    """The core, or the outermost element around it that holds unmarked text beside it, up to an article or main element."""
    size = _sums(nodes, plain)
    mains = [k for k in range(1, len(nodes)) if nodes[k][0] in _MAIN and not off[k] and size[k]]
    region = at = core
    while at > 0 and nodes[at][0] not in _MAIN:
        at = nodes[at][1]
        if size[at] > size[region]:
            region = at
    if at > 0 and nodes[at][0] == "article" and len(mains) > 1:
        # More than one article: all that stand in one main element, or on the page.
        up = at
        while nodes[up][1] > 0 and nodes[up][0] != "main":
            up = nodes[up][1]
        region = up
    return region


def _sums(nodes: list, values: list) -> list:
    """For each node the sum of the (value, node) inside it; a node's parent comes before it."""
    out = [0] * len(nodes)
    for value, node in values:
        out[node] += value
    for k in range(len(nodes) - 1, 0, -1):
        out[nodes[k][1]] += out[k]
    return out


def extract(pages: DataFrame, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keys`` of every row with its main text and the text's length in code points."""
    rows = pages.select(*keys, F.col(html).cast("string").alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            texts = [main_text(column[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")


def op1_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_html_text": op1_html_text}
ORACLES: dict = {}
