"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text, each with the element around it.  A classifier, a logistic
regression fitted on blocks whose elements say what they are, gives each block a cost
for being called content and one for being called boilerplate; together with what the elements
say, these are the capacities to the two terminals of a graph.  Edges of smoothness join
neighbours on the page, the weaker the further apart they are in the tree of elements, and
blocks of the same element.  A maximum flow separates the two: content is what the source
still reaches.  Short blocks in an article have next to no cost of their own, so the cut decides.

Each page is labelled on its own row, so there is no shuffle.  The scanner is linear in the page,
and the flow in its blocks, for costs are whole multiples of QUANTUM.

Defined cases: a null or empty page gives an empty text; unclosed and stray tags
are closed as browsers do, roughly; a page without markup is one block; where the cut leaves
nothing of an article, all of it stays; extra columns pass through; repeated rows give equal texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import unused

# Elements that stay within a block, that have no end, whose content is no text, and that hold no article.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form menu dialog fieldset".split())
WITHIN = frozenset("article main".split())
# Words in class, id and role that speak against and for an article.
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar aside footer cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended comment comments disqus respond reply replies breadcrumb breadcrumbs pagination pager newsletter subscribe subscription login signin search widget copyright toolbar legal disclaimer contentinfo complementary dialog".split()
)
FOR = frozenset("article content main post entry story prose".split())

NEGATED = frozenset("no not has with without".split())
# Words for what readers wrote; no article begins inside.
READERS = frozenset("comment comments disqus respond reply replies".split())
# The bias of elements that hold no article, of readers' and hidden ones, of a hint, of one inside an article, and of an article.
APART, CLOSED, HIDDEN, HINTED, DOUBTED, INSIDE = -6.0, -6.5, -7.0, -4.0, -3.5, 1.2
#: Costs are multiples of this.
QUANTUM = 1 / 64
#: Edges: between neighbours on the page that are siblings (halved for each step further), between blocks of one element, of one grandparent.
ADJACENT, KIN, COUSINS = 0.4, 0.8, 0.4
#: Pages that the classifier is fitted on, roughly.
SAMPLE = 2_000
# The weights that a fit starts at and is drawn to, those of the pages of sf0.1.
WEIGHTS = (2.697, 3.667, -10.9, -3.537, -0.49, -1.82)

# A tag's quoted values are passed over as such up to 256 of them; beyond that, and where a quote is never
# closed, the next > ends it.  Nothing is tried twice, so all this is linear.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|noscript|template|textarea|svg|iframe|select|button|object|math)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>"']*+(?:"[^"]*+"|'[^']*+')){0,256}+[^>"']*+)>"""
    r"|<[!?/a-zA-Z][^>]*+>",
    re.S | re.I,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tag", "bias", "parent", "grandparent", "linked", "steps")

    def __init__(self, text: str, tag: str, bias: float, parent: int, grandparent: int, linked: int, steps: int):
        self.text, self.tag, self.bias, self.parent, self.grandparent, self.linked, self.steps = text, tag, bias, parent, grandparent, linked, steps


def _hints(attributes: str) -> tuple[set[str], set[str]]:
    """Words against and for an article, name by name: sidebar-content is against, no-sidebar says nothing."""
    against: set[str] = set()
    good: set[str] = set()
    for m in _HINT.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _PART.findall(name)
            if len(words) > 1 and (words[0] in NEGATED or words[-1] == "free"):
                continue
            found = AGAINST.union(("header",)).intersection(words)
            against |= found
            if not found:
                good |= FOR.intersection(words)
    return against, good


def _bias(tag: str, attributes: str, outer: float) -> float:
    """What an element says about the text in it: below zero for boilerplate, above for an article.

    An article, main or word for it ends what hints further out said, but for readers' comments and hidden elements.
    """
    if outer <= CLOSED or tag in ("html", "body"):
        return outer
    if attributes and _HIDDEN.search(attributes):
        return HIDDEN
    against, good = _hints(attributes) if attributes else ((), ())
    if against and READERS.intersection(against):
        return CLOSED
    if tag in WITHIN:
        return INSIDE
    if tag in OUTSIDE or outer == APART or (tag == "header" and outer <= 0):
        return APART
    if against and (against != {"header"} or outer <= 0):
        return DOUBTED if outer in (INSIDE, DOUBTED) else HINTED
    return max(outer, INSIDE) if good else outer


def blocks(html: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, float, int]] = [("", 0.0, 0)]  # element, bias, number
    open_ = Counter()
    text: list[str] = []
    number = linked = 0
    in_link = False
    was = low = 1  # depth of the latest block's element, and the least depth since

    def end() -> None:
        nonlocal linked, was, low
        words = " ".join(unescape("".join(text)).split()) if text else ""
        if words:
            (tag, bias, _), depth = stack[-1], len(stack)
            out.append(Block(words, tag, bias, stack[-2][2] if depth > 1 else 0, stack[-3][2] if depth > 2 else -1, linked, was + depth - 2 * min(low, depth)))
            was = low = depth
        text.clear()
        linked = 0

    # After the last > there is no tag, but there may be a comment.
    stop = html.rfind(">") + 1
    tail = html[stop:]
    if "<!--" in tail:
        tail = tail[: tail.index("<!--")]
    at = 0
    for m in _TOKEN.finditer(html, 0, stop):
        if m.start() > at:
            text.append(html[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if at == stop and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not m[0].rstrip("> \t\r\n\f").lower().endswith("</" + m[1].lower())):
                tail = ""  # never closed
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = not m[2]
            continue
        if tag == "br":
            text.append(" ")
            continue
        end()
        in_link = False
        if m[2]:
            if open_[tag]:
                while True:
                    name = stack.pop()[0]
                    open_[name] -= 1
                    if name == tag:
                        break
                low = min(low, len(stack))
            continue
        if tag in EMPTY:
            continue
        if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack[-1][0] == tag):
            open_[stack.pop()[0]] -= 1  # these end where the next block begins
            low = min(low, len(stack))
        number += 1
        open_[tag] += 1
        stack.append((tag, _bias(tag, m[4], stack[-1][1]), number))
    if at < stop:
        text.append(html[at:stop])
    text.append(tail)
    end()
    return out


# ------------------------------------------------------------ the classifier


def features(b: Block) -> tuple[float, ...]:
    """What the words alone say: length, share in links, marks of sentences at the end and inside, share of other signs."""
    n = len(b.text)
    signs = sum(not (c.isalnum() or c in " .,;:!?'\"()-") for c in b.text)
    return 1.0, min(np.log2(1 + n) / 8, 1.5), min(1.0, b.linked / n), float(b.text[-1] in ".!?:;\"'”»…)"), float(". " in b.text or ", " in b.text), min(1.0, 10 * signs / n)


def known(b: Block) -> int | None:
    """1 or 0 where the elements around a block say what it is."""
    return 1 if b.bias >= INSIDE else 0 if CLOSED <= b.bias <= HINTED else None


def fit(pages: DataFrame, html: str = "html", key: str = "page_id", sample: int = SAMPLE, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of the logistic regression from the blocks of about `sample` pages, drawn by hash, by Newton steps on sums.

    The ridge draws them to WEIGHTS, as a few blocks would, so without labelled blocks these come back, and with many they
    don't count.  Pages are drawn by key and html, so one key may have many.
    """
    every = max(1, pages.count() // sample)
    source = pages.filter(F.pmod(F.xxhash64(key, html), F.lit(every)) == 0).select(F.coalesce(F.col(html), F.lit("")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for page in batch.column(0):
                for b in blocks(page.as_py()):
                    if (label := known(b)) is not None:
                        rows[(*(round(x, 2) for x in features(b)), label)] += 1
            columns = list(zip(*rows)) or [()] * (len(WEIGHTS) + 1)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in columns), pa.array(list(rows.values()), pa.float64())], names=[*(f"x{i}" for i in range(len(WEIGHTS))), "y", "n"])

    names = [*(f"x{i}" for i in range(len(WEIGHTS))), "y"]
    table = source.mapInArrow(count, ", ".join(f"{c} double" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n")).toPandas()  # features are rounded and the pages a sample
    x, y, n = table[names[:-1]].to_numpy(), table["y"].to_numpy(), table["n"].to_numpy()
    prior = np.array(WEIGHTS)
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (y - p)) - ridge * (w - prior))
    return tuple(np.round(w, 3).tolist())


def worth(b: Block, weights: tuple[float, ...] = WEIGHTS, article: bool = False) -> float:
    """What a block gains by being called content.  article: the page has one."""
    x = features(b)
    z = sum(u * v for u, v in zip(weights, x))
    if x[2] > 0.5:
        out = b.bias + max(-4.0, min(z, 0.0)) - 2.0
    else:
        out = b.bias + max(-1.25, min(z, 2.0))
        if b.bias > 0:
            out = max(out, -QUANTUM)
        if b.bias == HINTED and not article:  # long text without links outweighs a hint
            out += min(max(0, len(b.text) - b.linked - 160) / 150.0, 3.0)
        if b.bias == DOUBTED:  # the cut weighs it: an article may have a section on law, or a dialogue
            out += min(max(0, len(b.text) - b.linked - 100) / 100.0, 3.0)
    return round(out / QUANTUM) * QUANTUM


# ------------------------------------------------------------ the cut


def minimum_cut(worths: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node called against its worth costs its size, an edge between unlike nodes its weight.

    Maximum flow by blocking flows over levels, from nodes of positive worth to nodes of negative worth.
    """
    n = len(worths)
    near: list[list[int]] = [[] for _ in range(n)]  # numbers of edges; an edge and its reverse differ in the lowest bit
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        near[a].append(len(to)), to.append(b), room.append(w)
        near[b].append(len(to)), to.append(a), room.append(w)
    supply = [max(0.0, w) for w in worths]
    demand = [max(0.0, -w) for w in worths]
    tiny = 1e-9
    while True:
        level = [-1] * n
        reached = [i for i in range(n) if supply[i] > tiny]
        for i in reached:
            level[i] = 0
        for a in reached:  # grows as it is read
            for e in near[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    reached.append(to[e])
        if not any(demand[i] > tiny for i in reached):
            return [x >= 0 for x in level]
        used = [0] * n
        for start in range(n):
            while supply[start] > tiny:
                path, a = [], start
                while demand[a] <= tiny:
                    while used[a] < len(near[a]):
                        e = near[a][used[a]]
                        if room[e] > tiny and level[to[e]] == level[a] + 1:
                            break
                        used[a] += 1
                    else:
                        if not path:
                            break
                        level[a] = -2  # leads nowhere
                        a = to[path.pop() ^ 1]
                        continue
                    path.append(e)
                    a = to[e]
                if demand[a] <= tiny:
                    break
                flow = min([supply[start], demand[a], *(room[e] for e in path)])
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                supply[start] -= flow
                demand[a] -= flow


def labelled(html: str, weights: tuple[float, ...] = WEIGHTS) -> tuple[list[Block], list[float], list[bool]]:
    """The blocks of a page, their worths and which the cut calls content."""
    found = blocks(html)
    article = any(b.bias > 0 for b in found)
    worths = [worth(b, weights, article) for b in found]
    edges = []
    latest: dict[tuple[str, int], int] = {}
    for i, b in enumerate(found):
        if i and (near := round(ADJACENT * 0.5 ** min(60, max(0, b.steps - 2)) / QUANTUM) * QUANTUM):
            edges.append((i - 1, i, near))
        for key, weight in ((("p", b.parent), KIN), (("g", b.grandparent), COUSINS)):
            if key in latest and found[latest[key]].bias >= HINTED and b.bias >= HINTED:
                edges.append((latest[key], i, round(weight / QUANTUM) * QUANTUM))
            latest[key] = i
        latest["g", b.parent] = i
    kept = minimum_cut(worths, edges)
    if article and not any(kept):
        kept = [b.bias > 0 for b in found]
    return found, worths, kept


def main_text(html: str, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The blocks that the cut leaves as content, in page order."""
    found, _, kept = labelled(html, weights)
    return "\n\n".join([b.text for b, k in zip(found, kept) if k])


def extract(pages: DataFrame, html: str = "html", output: str = "text", weights: tuple[float, ...] = WEIGHTS, counts: bool = False) -> DataFrame:
    """pages without its html column, with the main text (a column of that name is replaced).

    counts: also n_blocks, and n_moved, the blocks that the cut calls other than their own worth does.
    """
    more = ["n_blocks", "n_moved"] if counts else []
    names = [f.name for f in pages.schema.fields if f.name not in (html, output, *more)]
    given = unused("__html", names)
    schema = T.StructType([*(pages.schema[n] for n in names), T.StructField(output, T.StringType()), *(T.StructField(c, T.LongType()) for c in more)])
    source = pages.select(*[F.col(f"`{n}`") for n in names], F.coalesce(F.col(html), F.lit("")).alias(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts, sizes, moved = [], [], []
                for x in part.column(len(names)):
                    found, worths, kept = labelled(x.as_py(), weights)
                    texts.append("\n\n".join([b.text for b, k in zip(found, kept) if k]))
                    sizes.append(len(found))
                    moved.append(sum(k != (w > 0) for w, k in zip(worths, kept)))
                columns = [pa.array(sizes, pa.int64()), pa.array(moved, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    out = extract(pages, weights=fit(pages), counts=True).withColumn("n_chars", F.length("text").cast("long"))
    return out.select("page_id", "url", "text", "n_chars", "n_blocks", "n_moved")
