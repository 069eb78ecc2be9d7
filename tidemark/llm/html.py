"""Main text of web pages by tag-path ratios."""

import html as entities
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_START = re.compile(r"<(?:!--|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements and landmark roles that by their definition hold no article's text.
_ASIDE = frozenset("head nav aside footer form button select option input fieldset menu dialog object applet canvas audio video map datalist".split()) | _RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class and id names that hint at menus, notices, adverts and comments: a weak prior.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist "
    "consent cookie cookies copyright disclaimer disqus dropdown footer footnav gdpr hidden login masthead menu menus modal nav "
    "navbar navigation newsletter notice notices notification outbrain overlay pagination pager popup promo promoted promotion "
    "related recommended recommendations replies reply respond rss search share sharing sidebar sidenav signup skip social sponsor "
    "sponsored subscribe subscription syndication taboola tags toc toolbar topbar tweet warning widget widgets".split()
)
#: Elements that end an open paragraph.
_CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
_SIBLINGS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a text: what holds them is its container.
_PARTS = _HEADINGS | frozenset("p li ul ol dl dt dd td th tr tbody thead table blockquote pre".split())
_PUNCTUATION = frozenset(string.punctuation + "…‚„“”‘’«»–—¿¡。，、！？：；")
#: How much a hint, an article around it or a telling name, weighs against the ratios.
HINT = 16.0
#: Share of the best path's ratio from which a path is content.
PASS = 0.5


def _attributes(raw: str) -> dict:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}


def _words(attributes: dict) -> list:
    """Words of class and id names."""
    value = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()) if len(value) > 1 else []


def _hidden(attributes: dict) -> bool:
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or attributes.get("role", "").strip().lower() in _ROLES:
        return True
    return bool(re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")))


class Page:
    """Blocks of a page in page order, outside what can't be an article's text, and its elements.

    Elements are numbered in page order: parent[n], last[n] (the last number inside n), tag[n],
    and path[n], the number of the steps (tag and class words) from the root. Each block has its
    element, text, and how many of its characters are in links. Every character is looked at a
    bounded number of times: inline elements aren't kept, and an end tag without a start is told
    by a count of what is open."""

    def __init__(self, page: str):
        self.parent, self.last, self.tag, self.path = [-1], [0], [""], [0]
        self.paths, self.steps = {}, [(-1, "", False, False)]  # of a path: parent, tag, hint, inside an article
        self.node, self.text, self.linked = [], [], []
        stack, open_, chunks, link = [(0, False)], {}, [], False  # of the stack: element, left out or not
        at, size, gone = 0, len(page), set()  # gone: quotes and ends that don't come again

        def flush():
            nonlocal chunks
            if chunks:
                words = " ".join(entities.unescape("".join(c for c, _ in chunks)).split())
                if words:
                    self.node.append(stack[-1][0])
                    self.text.append(words)
                    self.linked.append(min(len(words), sum(len(c) for c, a in chunks if a)))
                chunks = []

        def close(tag: str):
            """Closes the innermost open element of this name and all in it."""
            while len(stack) > 1:
                n, _ = stack.pop()
                self.last[n] = len(self.tag) - 1
                open_[self.tag[n]] -= 1
                if self.tag[n] == tag:
                    return

        def end_of(i: int) -> int:
            """Where the tag ends whose attributes begin at i; -1 if it never does."""
            while ">" not in gone:
                m = _QUOTE.search(page, i)
                if not m:
                    gone.add(">")
                elif not m[1]:
                    return m.start()
                elif m[1] in gone or (j := page.find(m[1], m.end())) < 0:
                    gone.add(m[1])
                    j = page.find(">", m.end())
                    if j >= 0:
                        return j
                    gone.add(">")
                else:
                    i = j + 1
            return -1

        while at < size:
            m = _START.search(page, at)
            begin = m.start() if m else size
            if begin > at and not stack[-1][1]:
                chunks.append((page[at:begin], link))
            if not m:
                break
            if page.startswith("<!--", begin):
                at = page.find("-->", begin + 4) + 3
                if at < 3:
                    break
                continue
            ending = page[begin + 1] == "/"
            name = _NAME.match(page, begin + 1 + ending)
            stop = end_of(name.end()) if name else page.find(">", begin)
            if stop < 0:  # no tag: the rest is text
                if not stack[-1][1]:
                    chunks.append((page[begin:], link))
                break
            at = stop + 1
            if not name:
                continue
            tag = name[0].lower()
            if tag in _INLINE and not (stack[-1][1] and self.tag[stack[-1][0]] == tag):
                if tag == "a":
                    link = not ending
                elif tag == "br" and not stack[-1][1]:
                    chunks.append((" ", False))
                if ending or tag in _VOID or stack[-1][1] or not _hidden(_attributes(page[name.end() : stop])):
                    continue
                flush()
                self._open(tag, [], stack, True, open_)
                continue
            if not ending and tag in _INLINE:  # the same name inside a hidden inline element
                self._open(tag, [], stack, True, open_)
                continue
            flush()
            link = False
            if ending:
                if open_.get(tag):
                    close(tag)
                continue
            if tag in _CLOSES_P and self.tag[stack[-1][0]] == "p":
                close("p")
            if tag in _SIBLINGS:
                same, bounds = _SIBLINGS[tag]
                if any(open_.get(t) for t in same):
                    for n, _ in reversed(stack):
                        if self.tag[n] in bounds:
                            break
                        if self.tag[n] in same:
                            close(self.tag[n])
                            break
            raw = page[name.end() : stop]
            if tag in _VOID or raw.endswith("/") and tag not in _CLOSES_P:
                continue
            if tag in _RAW:
                done = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                if not done:
                    break
                at = page.find(">", done.end() - 1) + 1 or size
                continue
            attributes = _attributes(raw)
            inside = self.steps[self.path[stack[-1][0]]][3]
            out = stack[-1][1] or tag in _ASIDE or tag == "header" and not inside or tag not in ("html", "body", "article", "main") and _hidden(attributes)
            self._open(tag, _words(attributes), stack, out, open_)
        flush()
        while len(stack) > 1:
            self.last[stack.pop()[0]] = len(self.tag) - 1
        self.last[0] = len(self.tag) - 1

    def _open(self, tag: str, words: list, stack: list, out: bool, open_: dict) -> None:
        above = self.path[stack[-1][0]]
        step = (above, tag, *words)
        if step not in self.paths:
            self.paths[step] = len(self.steps)
            _, _, hint, inside = self.steps[above]
            hint = hint or tag not in ("html", "body", "article", "main") and not _NAMES.isdisjoint(words)
            self.steps.append((above, tag, hint, inside or tag in ("article", "main")))
        stack.append((len(self.tag), out))
        self.parent.append(stack[-2][0])
        self.tag.append(tag)
        self.last.append(-1)
        self.path.append(self.paths[step])
        open_[tag] = open_.get(tag, 0) + 1


def smooth(values: np.ndarray, radius: int = 1) -> np.ndarray:
    """Gaussian-weighted means over neighbours."""
    w = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2.0 * max(1, radius) ** 2))
    pad = np.pad(values, radius, mode="edge")
    return np.convolve(pad, w / w.sum(), mode="valid")


def ratios(page: Page):
    """The fused ratio of each block's path, and whether most of the path's text is in links.

    Of each path from the root, over all blocks that have it: text outside links and punctuation
    per block, as the root of their product. Ratios are smoothed along the page, averaged over the
    path's blocks, and fused with the path's own by a geometric mean. An article around the path
    raises the ratio by HINT, a telling class name lowers it by as much."""
    of = np.unique([page.path[n] for n in page.node], return_inverse=True)[1]
    size = np.array([len(t) for t in page.text], np.float64)
    linked = np.array(page.linked, np.float64)
    marks = np.array([sum(c in _PUNCTUATION for c in t) for t in page.text], np.float64)
    many = np.bincount(of)
    plain = np.bincount(of, size - linked) / many
    own = np.sqrt(plain * (1 + np.bincount(of, marks) / many))
    fused = np.sqrt(own * np.bincount(of, smooth(own[of])) / many)
    steps = [page.steps[page.path[n]] for n in page.node]
    hints = np.array([HINT ** (int(inside) - int(hint)) for _, _, hint, inside in steps])
    return fused[of] * hints, (2 * np.bincount(of, linked) > np.bincount(of, size))[of]


def extract(html: str, ratio=ratios) -> str:
    """The article of a page.

    Paths whose fused ratio is PASS of the best one's or more are content; the smallest element
    that holds all their blocks is the container, or the article or main element around it. All of
    the container is the text, short blocks such as headings included, but for blocks whose path
    fails and that are lists of links or under a name that tells comments, notices and the like
    within the container. A main heading directly before the container belongs to it."""
    page = Page(html)
    if not page.text:
        return ""
    score, links = ratio(page)
    passed = score >= PASS * score.max()
    nodes = np.array(page.node)
    root, last = int(nodes[passed].min()), int(nodes[passed].max())
    while page.last[root] < last:
        root = page.parent[root]
    up = root
    while up > 0 and page.tag[up] not in ("article", "main"):
        up = page.parent[up]
    if up > 0:
        root = up
    while page.tag[root] in _PARTS:
        root = page.parent[root]
    hinted = page.steps[page.path[root]][2]
    chosen = []
    for i, n in enumerate(page.node):
        if not root <= n <= page.last[root]:
            if not chosen and page.tag[n] == "h1" and i + 1 < len(nodes) and root <= nodes[i + 1] <= page.last[root] and not page.steps[page.path[n]][2]:
                chosen.append(i)
            continue
        told = page.steps[page.path[n]][2] and not hinted or links[i] and page.tag[n] not in _HEADINGS and page.tag[n] != "p"
        if passed[i] or not told:
            chosen.append(i)
    return "\n".join(page.text[i] for i in chosen)


def _extracted(batches):
    for batch in batches:
        texts = [extract(h or "") for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and text (the article; empty if there is none), one row per page.

    Each page is worked on alone, as a whole, in time proportional to its length however deep or
    broken its markup is. Character references are decoded, white space inside a block is one
    space, and blocks are joined by a line feed. Null and empty pages have empty texts; pages
    without tags are one block. Repeated rows give repeated rows; other columns are left out."""
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").cast("string").alias("html"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(_extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string")


def op10_html_extract(spark, sf_dir: str) -> DataFrame:
    out = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
