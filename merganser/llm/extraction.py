"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of tags and of runs of words. Words score positive (less inside links), tags negative, and an
element that is never article (navigation, footers, sidebars, forms, adverts, notices, reader comments, scripts, styles, hidden elements) is one negative token.
The weights come from labelled pages: how often a tag or a word stands outside the article. One linear
scan finds the contiguous region of the highest sum; of equal sums the first. A region that lies within an article or main element takes all of it, and
what is never article is left out inside the region, too.

Blocks are the runs of text between block-level tags (`br` is white space). Character references are decoded, white space is turned into one
space, empty blocks go, the others are joined by a line feed.

A null or empty page gives the empty text, as does one without words outside of such elements. Tags may be unclosed, cut off or nested wrongly: an end tag closes all that was opened
since its start tag, one without a start tag is passed over, and the page's end closes the rest. If all words stand within an element that isn't closed, it is taken not to be one.
Every row gives one row, repeated and null ids included; pages are read whole.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merganser.llm.shared import map_batches, per_batch

#: Labelled pages that are learned from: those with one article element, of the smallest hash of the address.
PAGES = 400
#: Names of HTML elements.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("script style noscript template head nav footer aside form button select option textarea svg math iframe object embed canvas audio video map dialog menu xmp noembed noframes title label input".split())
CONTAINERS = frozenset({"article", "main"})
#: Elements that a start tag of the same kind ends, if they are open.
ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Words in class names, ids and roles of elements that aren't article.
NOT_ARTICLE = frozenset(
    """ad ads adsense advert adverts advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo
    cookie cookies copyright dialog disqus footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted
    promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets alert""".split()
)

#: Last words of names that speak for article, even where another part of the name speaks against it.
ARTICLE = frozenset("article articles text body content contents story post entry main copy prose".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
#: One attribute: its name, and its value in any of three notations. Values are taken whole, so nothing inside them is a name.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s\"'>]+)))?")
PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def attributes_of(text: str) -> dict[str, str]:
    """Attributes by name in lower case; of repeated names the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def excluded(name: str, attributes: str, in_container: bool) -> int:
    """2 if an element is never article, 1 if only part of a name says so and its last word says article, else 0."""
    if name in NEVER:
        return 2
    if name == "header":
        return 0 if in_container else 2
    if not attributes or name in ("html", "body", "article", "main"):
        return 0
    of = attributes_of(attributes)
    if "hidden" in of or of.get("aria-hidden", "").lower() == "true" or HIDDEN.search(of.get("style", "")):
        return 2
    out = 0
    for value in (of.get("class"), of.get("id"), of.get("role")):
        for one in (value or "").split():
            parts = [p.lower() for p in PARTS.findall(one)]
            if any(p in NOT_ARTICLE for p in parts):
                out = max(out, 1 if parts[-1] in ARTICLE else 2)
    return out


class Page:
    """A page as parallel lists: kinds ('word', 'link', 'out' for a whole element that is never article, or a tag), how many words or 1, texts, and the numbers of the containers around."""

    def __init__(self, page: str, forgiven: bool = False, doubtful: bool = True):
        self.kinds: list[str] = []
        self.counts: list[int] = []
        self.texts: list[str] = []
        self.containers: list[tuple[int, ...]] = []
        stack: list[tuple[str, int, bool, int]] = []
        out = links = 0
        within: list[int] = []
        at, number, self.unclosed_out = 0, 0, False
        in_doubt, self.doubted = 0, 0

        def add(kind: str, count: int, text: str) -> None:
            if out:  # what is never article stands as one token, where it begins
                self.doubted += count * (kind in ("word", "link") and out == in_doubt)
                return
            self.kinds.append(kind)
            self.counts.append(count)
            self.texts.append(text)
            self.containers.append(tuple(within))

        def text_to(end: int) -> None:
            if end > at:
                raw = page[at:end]
                text = entities.unescape(raw) if "&" in raw else raw
                add("link" if links else "word", len(text.split()), text)

        def close(k: int) -> None:
            nonlocal out, links, in_doubt
            while len(stack) > k:
                name, was_out, was_link, container = stack.pop()
                out -= was_out > 0
                in_doubt -= was_out == 1
                links -= was_link
                if container:
                    within.remove(container)

        while m := TOKEN.search(page, at):
            text_to(m.start())
            at = m.end()
            if not m[2]:
                continue
            name, end = m[2].lower(), bool(m[1])
            if end:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if k is not None:
                    add("/" + name, 1, "")
                    close(k)
                continue
            for other in ENDS.get(name, ()):
                if stack and stack[-1][0] == other:
                    close(len(stack) - 1)
            if name in VOID or m[3].endswith("/"):
                add(name, 1, "")
                continue
            if name in RAW:
                add("out", 1, "")
                found = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                at = found.start() if found else len(page)
                stack.append((name, 2, False, 0))
                out += 1
                continue
            number += 1
            is_out = 2 * (name in NEVER) if forgiven else excluded(name, m[3], bool(within))
            is_out *= is_out == 2 or doubtful
            container = number if name in CONTAINERS else 0
            if container:
                within.append(container)
            add("out" if is_out else name, 1, "")
            stack.append((name, is_out, name == "a", container))
            out += is_out > 0
            in_doubt += is_out == 1
            links += name == "a"
        text_to(len(page))
        self.unclosed_out = out > 0

    def region(self, weights: dict[str, float]) -> tuple[int, int]:
        """First and one past the last token of the highest-scoring region, by one scan."""
        best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
        floor = weights.get("tag", -2.0)
        for i, (kind, n) in enumerate(zip(self.kinds, self.counts)):
            if total <= 0:
                total, start = 0.0, i
            total += n * weights[kind] if kind in ("word", "link", "out") else weights.get(kind.lstrip("/"), floor)
            if total > best:
                best, begin, end = total, start, i + 1
        return begin, end

    def extended(self, begin: int, end: int) -> tuple[int, int]:
        """The whole of the outermost article or main element that holds nearly all of the region's words."""
        held: Counter = Counter()
        for i in range(begin, end):
            if self.kinds[i] == "word":
                for c in self.containers[i]:
                    held[c] += self.counts[i]
        total = sum(n for k, n in zip(self.kinds[begin:end], self.counts[begin:end]) if k == "word")
        full = [c for c, n in held.items() if n >= 0.9 * total]
        if full:
            c = min(full)
            inside = [i for i, cs in enumerate(self.containers) if c in cs]
            begin, end = (min(begin, inside[0]), max(end, inside[-1] + 1)) if held[c] < total else (inside[0], inside[-1] + 1)
        return begin, end

    def text(self, begin: int, end: int) -> str:
        out, run = [], []
        for kind, text in zip(self.kinds[begin:end], self.texts[begin:end]):
            if kind in ("word", "link"):
                run.append(text)
            elif kind == "br":
                run.append(" ")
            elif kind == "out" or kind.lstrip("/") in BLOCKS:
                out.append(" ".join("".join(run).split()))
                run = []
        out.append(" ".join("".join(run).split()))
        return "\n".join(x for x in out if x)


#: Weights where no page is labelled.
DEFAULT = {"word": 1.0, "link": 0.2, "out": -1.5, "tag": -0.8, "a": -0.6} | dict.fromkeys("p br b i em strong span u sub sup code h1 h2 h3 h4 blockquote cite q small mark abbr time".split(), -0.2)


def learned(pages: list[str]) -> dict[str, float]:
    """Weights by kind from pages with one article element: the share of a kind that stands outside makes it cost more; words earn what the shares of both sides differ by."""
    inside, every = Counter(), Counter()
    for html in pages:
        page = Page(html)
        for kind, n, c in zip(page.kinds, page.counts, page.containers):
            name = kind.lstrip("/") if kind not in ("word", "link", "out") else kind
            every[name] += n
            inside[name] += n * bool(c)
    if not inside["word"]:
        return DEFAULT
    share = lambda k: (every[k] - inside[k] + 1) / (every[k] + 2)
    weights = {k: -0.2 - 4.0 * share(k) for k in every if k not in ("word", "link", "out")}
    odds = math.log((inside["word"] + 1) / (every["word"] - inside["word"] + 1))
    return DEFAULT | weights | {"word": min(1.0, max(0.3, odds))}


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The text of the region. Elements in doubt are left out unless they hold more words than what is found without them."""
    if not html:
        return ""
    page = Page(html)
    begin, end = page.extended(*page.region(weights))
    text = page.text(begin, end)
    if page.doubted > len(text.split()):
        page = Page(html, doubtful=False)
        text = page.text(*page.extended(*page.region(weights)))
    if not text and page.unclosed_out:
        page = Page(html, forgiven=True)
        text = page.text(*page.extended(*page.region(weights)))
    return text


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample: int = PAGES) -> DataFrame:
    """One row for each row: the id, the address, text, n_chars (code points)."""
    marked = pages.select(F.col(url_col).cast("string").alias("u"), F.col(html_col).cast("string").alias("h")).filter(F.regexp_count("h", F.lit("(?i)<article[ >]")) == 1)
    chosen = marked.select(F.xxhash64("u", "h").alias("k")).distinct().orderBy("k").limit(sample)
    labelled = marked.withColumn("k", F.xxhash64("u", "h")).join(F.broadcast(chosen), "k", "left_semi").dropDuplicates(["k"]).orderBy("k")
    weights = learned([r.h for r in labelled.select("h", "k").toLocalIterator()])

    def make():
        def work(batch: pa.RecordBatch):
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), url_col: batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

        return work

    few = pages.select(pages[id_col], pages[url_col].cast("string").alias("_url"), pages[html_col].cast("string").alias("_html"))
    return map_batches(few, per_batch(make), f"{id_col} {few.dtypes[0][1]}, {url_col} string, text string, n_chars long")
