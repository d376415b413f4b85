"""Operator 8: main text of web pages by the maximum-scoring subsequence of tokens.

A page becomes a sequence of words and tags. Each token has a weight: a word that of the innermost container around
it of which something is known, a tag its own, which is negative. Containers are told by their names: the
element's, if it is one that divides a page, and the words of its class, id and role. The weights are log odds of
lying inside the main text and are counted on labelled pages; for names that these do not show, fixed prior
weights stand in. One linear scan (Kadane's) finds the contiguous region of the largest sum. Inside that region
the text of containers of negative weight is left out, and the rest is written block by block.

A container of positive weight outweighs what tags mean elsewhere: its tags cost next to nothing. A
container of negative weight inside one counts nothing, so that an advert does not cut an article.

Labelled pages are those that mark their own main text with an ``article`` or ``main`` element, among
at most ``sample`` pages chosen by a hash of the html. Main text in them is what stands in such an element and not
in one that holds none by its prior weight. Where a table has no such pages, the prior weights alone decide.
Extraction uses every page whole.

Defined results: null html counts as empty and gives an empty text; markup cut off at the end of a
page is read as far as it goes; end tags that HTML lets out are supplied. Repeated pages are extracted each. Other
columns are not read, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import hash_sample

#: Fixed values of HTML: elements without end tags, elements whose content is no text, block elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that an open paragraph cannot hold: their start tags end it.
ENDS_P = BLOCK - frozenset("body caption head html legend optgroup option tbody td tfoot th thead tr".split())
#: Start tags that end an open element of these names, unless one of the others is nearer.
IMPLIED = {
    **dict.fromkeys(["li"], (frozenset(["li"]), frozenset("ul ol menu dir".split()))),
    **dict.fromkeys(["dt", "dd"], (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(["td", "th"], (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
    **dict.fromkeys(["tr"], (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"]))),
    **dict.fromkeys(["tbody", "thead", "tfoot"], (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"]))),
    **dict.fromkeys(["option"], (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"]))),
    **dict.fromkeys(["optgroup"], (frozenset(["optgroup"]), frozenset(["select"]))),
    **dict.fromkeys(["body"], (frozenset(["head"]), frozenset())),
}
#: Elements that an end tag of another name does not reach beyond.
WALLS = frozenset("td th table caption button".split())
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SEMANTIC = ("article", "main")
#: Elements that divide a page: their names count as names of containers.
DIVIDING = frozenset("article main nav header footer aside form menu dialog button select head".split())
#: Prior weights: elements, and whole words of class, id or role, that hold no main text.
ASIDE = DIVIDING - frozenset(SEMANTIC)
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar footer "
    "header masthead site-header site-footer page-header page-footer site-nav cookie cookies cookie-banner cookie-notice consent gdpr notice notices popup modal newsletter subscribe signup "
    "login share sharing share-buttons social social-links comment comments comment-list comments-area disqus disqus_thread replies respond related related-posts recommended recommendations toolbar "
    "pagination pager widget complementary contentinfo dialog alert ad-slot ad-container".split()
)
PRIOR = 3.0
#: Least number of words of labelled pages below a name for these to weigh it.
SEEN = 20
MOST = 4.0
#: Weight of a word that no container speaks for, and of a tag that the labelled pages do not show.
PLAIN_WORD, PLAIN_TAG = 1.0, -0.05
#: Weight of tags in containers of positive weight.
INNER_TAG = -0.01
TOKEN = re.compile(r"<!--(.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")

Weights = dict[tuple[str, str], float]


class Node:
    """An open element: its name, the names of its innermost container, the weight there, whether a main element is around it."""

    __slots__ = ("name", "names", "weight", "inner", "main")

    def __init__(self, name: str, names: tuple[str, ...], weight: float | None, inner: bool, main: bool):
        self.name, self.names, self.weight, self.inner, self.main = name, names, weight, inner, main


def names_of(element: str, attributes: str) -> tuple[str, ...]:
    """Names by which an element can be known as a container."""
    found = [x for _, a, b, c in ATTRIBUTE.findall(attributes) for x in (a or b or c).lower().split()] if attributes else []
    if element in DIVIDING:
        found.append(f"<{element}>")
    return tuple(dict.fromkeys(found))


def prior(element: str, names: tuple[str, ...], main: bool) -> float | None:
    """Weight before any labelled page is seen; a header inside a main element is a part of it."""
    if element in SEMANTIC:
        return PRIOR
    if element in ASIDE and not (element == "header" and main):
        return -PRIOR
    if element not in HEADINGS and element not in ("html", "body", "header") and not ASIDE_NAMES.isdisjoint(names):
        return -PRIOR
    return None


def weigh(element: str, names: tuple[str, ...], main: bool, weight: Weights) -> float | None:
    """Weight of a container: that of its most telling name that labelled pages show, else the prior one."""
    if element in SEMANTIC or (element == "header" and main):
        return prior(element, names, main)
    known = [weight["name", n] for n in names if ("name", n) in weight] if element not in ("html", "body") else []
    return max(known, key=abs) if known else prior(element, names, main)


def tokens(page: str, weight: Weights) -> Iterator[tuple[str, str, Node]]:
    """(kind, value, where): kind is "text" or "tag"; the value is the raw text, or the name with a slash for end tags."""
    stack = [Node("", (), None, False, False)]
    at = 0
    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            yield "text", page[at:start], stack[-1]
        if not m:
            return
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if m[2]:
            yield "tag", "/" + name, stack[-1]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if (stack[i].name in WALLS and name not in TABLE_PARTS) or (stack[i].name in LISTS and name == "li"):
                    break
            continue
        if name in IMPLIED:
            _end(stack, *IMPLIED[name])
        if name in ENDS_P:
            _end(stack, frozenset(["p"]), BLOCK)
        top = stack[-1]
        names = names_of(name, m[4])
        main = top.main or name in SEMANTIC
        own = weigh(name, names, top.main, weight) if names else None
        node = Node(name, names or top.names, top.weight, top.inner, main)
        if own is not None and not (top.weight is not None and top.weight < 0 and (top.inner or own > 0 and name not in SEMANTIC)):
            node.weight, node.inner = own, own < 0 and (top.weight or 0) > 0
        yield "tag", name, node
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            if name == "title":
                yield "tag", "/title", top
        elif name not in VOID and not (m[4] or "").rstrip().endswith("/"):
            stack.append(node)


def _end(stack: list[Node], ended: frozenset[str], walls: frozenset[str]) -> None:
    """Close the innermost open element of the names ``ended``, unless one of ``walls`` is nearer."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in ended:
            del stack[i:]
            return
        if stack[i].name in walls:
            return


def count_tokens(page: str) -> Counter:
    """(kind, value, inside main) of one labelled page; empty where it marks no main text."""
    found, marked = Counter(), False
    for kind, value, where in tokens(page, {}):
        inside = where.main and not where.inner and (where.weight or 0) > 0
        if kind == "tag":
            marked = marked or value in SEMANTIC
            found["tag", value, inside] += 1
        elif n := len(value.split()):
            for name in where.names:
                found["name", name, inside] += n
    return found if marked else Counter()


def weights(counts: Counter) -> Weights:
    """Log odds of lying inside, for names with enough words; tags at most ``INNER_TAG``."""
    out = {}
    for kind, value in {(k, v) for k, v, _ in counts}:
        inside, outside = counts[kind, value, True], counts[kind, value, False]
        odds = max(-MOST, min(MOST, math.log((inside + 0.5) / (outside + 0.5))))
        if kind == "tag":
            out[kind, value] = min(INNER_TAG, odds)
        elif inside + outside >= SEEN:
            out[kind, value] = odds
    return out


def score(kind: str, value: str, where: Node, weight: Weights) -> float:
    """Score of one token."""
    if where.inner:
        return 0.0
    known = where.weight
    if kind == "tag":
        return INNER_TAG if known is not None and known > 0 else weight.get((kind, value), PLAIN_TAG)
    return len(value.split()) * (PLAIN_WORD if known is None else known)


def extract(page: str, weight: Weights) -> str:
    """Main text of one page."""
    best = total = 0.0
    start, region = 0, (0, 0)
    seen = list(tokens(page, weight))
    for i, token in enumerate(seen):
        total += score(*token, weight)
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    blocks, current = [], []
    for kind, value, where in seen[slice(*region)]:
        if kind == "text":
            if where.weight is None or where.weight > 0:
                current.append(value)
        elif value.lstrip("/") in BLOCK:
            blocks.append("".join(current))
            current = []
        elif value == "br":
            current.append(" ")
    blocks.append("".join(current))
    made = (SPACE.sub(" ", entities.unescape(b)).strip() for b in blocks)
    return "\n".join(b for b in made if b)


def fit(df: DataFrame, html: str = "html", sample: int = 2000) -> Weights:
    """Weights from at most ``sample`` pages that mark their main text."""
    chosen = hash_sample(df.select(F.col(html)), sample, html).where(F.col(html).rlike(r"(?i)<(article|main)[\s>]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                found += count_tokens(page)
        rows = [(k, v, inside, n) for (k, v, inside), n in found.items()]
        kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "value", "inside", "n"])

    counted = chosen.mapInArrow(run, "kind string, value string, inside boolean, n bigint").groupBy("kind", "value", "inside").agg(F.sum("n").alias("n"))
    # bounded by the element and container names of the sample
    return weights(Counter({(r["kind"], r["value"], r["inside"]): r["n"] for r in counted.toLocalIterator()}))


def main_text(df: DataFrame, html: str = "html", sample: int = 2000) -> DataFrame:
    """(page_id, url, text): the main text of every page."""
    weight = fit(df, html, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                made = pa.array([extract(p or "", weight) for p in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), made], names=["page_id", "url", "text"])

    return df.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html)).mapInArrow(run, "page_id bigint, url string, text string")
