"""Main text of web pages as the maximum-scoring run of their words and tags.

A page is read as a sequence of words and tags. Words score by the block they stand in and
its landmark, tags score negative, and one linear scan finds the contiguous run of the
highest sum: the content region. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, hidden parts and reader comments (by element, role, class or id) score
nothing and are left out of the region's text, so they neither end the region nor enter it.

An element whose class or id names such a part is kept if it encloses the landmark or, on a page
without one, most of the words and over three times those that would be left.

Weights are log odds of lying in the content, learned from labelled pages: pages whose author
marked the content with an ``article`` or ``main`` element that is shown, and neither a comment
nor a teaser (see ``_landmark``). At most
``labelled`` different ones are used, those with the least hashes of their html. Words of such a page score by block
and by whether the landmark encloses them, and those of a block that no label showed there as all words on that side of
a landmark do, so that no part of a marked article is lost for its kind; on pages without a landmark, by block alone.

Text is cut into blocks at block elements; character references are decoded, white space in a
block becomes one space, blocks without text vanish, the rest are joined by line breaks.

A null or empty page, or one without content, has the text "". Malformed markup never fails:
a tag that is not closed ends with its parent, a comment or script with the page. Time and memory are linear in a
page's length. Repeated and null ids pass through row by row, and other columns stay as they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plotmark.llm.common import texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|object)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|</?[a-zA-Z!?][^>]*(?:>|\Z)|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ATTRIBUTE_NAME = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot"
    " th thead title tr ul".split()
)
# An open one of these ends where another block begins.
_ENDS_AT_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("head title nav footer aside form menu dialog button select header".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar"
    " navigation menu header masthead footer sidebar aside widget related recommended recommendations cookie cookies"
    " consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share sharing comment"
    " comments commentlist disqus respond replies breadcrumb breadcrumbs pagination pager toolbar login skip hidden".split()
)
LANDMARKS = ("article", "main")
# Elements whose class says nothing about being left out.
_NEVER_BY_NAME = frozenset(("html", "body", "main"))
_COMMENT_NAMES = frozenset(("comment", "comments", "commentlist", "respond", "replies"))
_TEASER_NAMES = frozenset("teaser teasers related recommended recommendations promo promoted sponsored".split())
# A class that starts with one of these tells of the page, not of the element.
_MODIFIERS = frozenset(("has", "no", "with", "without"))
CLIP, TAG_LEAST, TAG_DEFAULT, WORD_DEFAULT, LINK_DEFAULT = 4.0, -0.05, -0.25, 1.0, -1.0


def _dropped_names(name: str, attrs: str) -> set[str]:
    """The parts of class and id that name a left-out element; has-, no- and with- only modify."""
    if not attrs or name in _NEVER_BY_NAME:
        return set()
    parts = set()
    for key, *values in _ATTRIBUTE.findall(attrs):
        if key.lower() in ("class", "id"):
            for token in "".join(values).split():
                own = [p.lower() for p in _NAME_PART.findall(token)]
                if own and own[0] not in _MODIFIERS:
                    parts.update(own)
    return parts & (_COMMENT_NAMES | _TEASER_NAMES if name == "article" else DROPPED_NAMES)


def _is_hidden(name: str, attrs: str) -> bool:
    """Whether an element is left out by its own name, role or attributes."""
    if name in DROPPED and name != "header":
        return True
    if not attrs or name in _NEVER_BY_NAME:
        return False
    for key, *values in _ATTRIBUTE.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in DROPPED_ROLES:
            return True
        elif key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return "hidden" in attrs.lower() and any(m[1].lower() == "hidden" for m in _ATTRIBUTE_NAME.finditer(attrs))


def _parse(page: str) -> tuple[list[tuple], list[tuple]]:
    """(elements, items). An element is (parent, name, hidden, dropped names), parents first; an
    item is (element, feature, size, text)."""
    elements: list[tuple] = [(-1, "body", False, set())]
    items: list[tuple] = []
    # Open elements: name, element, block, in a link.
    stack = [("body", 0, "body", False)]

    def text(raw: str) -> None:
        if raw:
            _, element, block, link = stack[-1]
            decoded = html.unescape(raw)
            items.append((element, f"{block}/a" if link else block, len(decoded.split()), decoded))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            element = stack[-1][1]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    element = stack[k][1]
                    del stack[k:]
                    break
            items.append((element, f"<{name}", int(name in BLOCK), None))
            continue
        if name in BLOCK:
            # A paragraph ends at the next block, with all that is open in it.
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _ENDS_AT_BLOCK:
                    del stack[k:]
                    break
                if stack[k][0] in BLOCK:
                    break
            if name == "li":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "li":
                        del stack[k:]
                        break
                    if stack[k][0] in ("ul", "ol", "menu"):
                        break
        _, element, block, link = stack[-1]
        elements.append((element, name, _is_hidden(name, m["attrs"]), _dropped_names(name, m["attrs"])))
        element = len(elements) - 1
        items.append((element, f"<{name}", int(name in BLOCK), None))
        if name not in VOID and not m["attrs"].endswith("/"):
            own = name if name in BLOCK else block
            stack.append((name, element, own, name == "a" or link and name not in BLOCK))
    text(page[at:])
    return elements, items


def _words_within(elements: list[tuple], items: list[tuple], out: list[bool]) -> list[int]:
    """Each element's words outside left-out elements."""
    words = [0] * len(elements)
    for element, _, size, text in items:
        if text is not None and not out[element]:
            words[element] += size
    for k in range(len(elements) - 1, 0, -1):
        words[elements[k][0]] += words[k]
    return words


def _landmark(elements: list[tuple], items: list[tuple]) -> tuple[str | None, set[int], set[int]]:
    """The page's landmark, its elements, and the elements not to be dropped by name.

    It is the article with most words, or all articles if none has half of their words; ``main``
    if no article has half of its words. Hidden articles, comments and teasers are none. One in an
    element named for dropping counts if it is ``main`` or has over half of the page's words.
    """
    hidden, dropped, comment = [], [], []
    for parent, _, is_hidden, names in elements:
        up = parent >= 0
        hidden.append(is_hidden or up and hidden[parent])
        dropped.append(bool(is_hidden or names) or up and dropped[parent])
        comment.append(bool(names & _COMMENT_NAMES) or up and comment[parent])
    kept, shown = (_words_within(elements, items, out) for out in (dropped, hidden))
    size: dict[int, int] = {}
    for k, (_, name, _, names) in enumerate(elements):
        if name not in LANDMARKS or hidden[k] or comment[k] or names:
            continue
        if not dropped[k]:
            size[k] = kept[k]
        elif name == "main" or 2 * shown[k] > shown[0]:
            size[k] = shown[k]
    size = {k: n for k, n in size.items() if n}
    mains = [k for k in size if elements[k][1] == "main"]
    articles = [k for k in size if elements[k][1] == "article"]
    landmark, chosen = None, set()
    if articles:
        best = max(articles, key=lambda k: (size[k], -k))
        landmark, chosen = "article", {best}
        if 2 * size[best] < sum(size[k] for k in articles):
            chosen = set(articles)
        if any(2 * size[best] < size[k] for k in mains):
            landmark, chosen = "main", set(mains)
    elif mains:
        landmark, chosen = "main", set(mains)
    whole = set()
    for k in chosen:
        while k > 0:
            whole.add(k)
            k = elements[k][0]
    if landmark is None:
        # Without a landmark, what has most of the words, and by far more than would be left, is no side matter.
        most = max(shown[0] // 2, 3 * kept[0])
        whole = {k for k, e in enumerate(elements) if e[3] and not e[3] & _COMMENT_NAMES and shown[k] > most}
    return landmark, chosen, whole


def read_page(page: str) -> tuple[list[tuple], str | None]:
    """The page's items, and its landmark if it has one.

    An item is (feature, size, text, inside). For a tag: "<name", 1 if it separates blocks,
    None. For text: "block" or, in a link, "block/a", its number of words, the decoded text.
    The feature is None where the text is left out; ``inside`` tells whether a landmark
    encloses the item.
    """
    elements, items = _parse(page)
    landmark, chosen, whole = _landmark(elements, items)
    out, inside = [], []
    for k, (parent, name, is_hidden, names) in enumerate(elements):
        up = parent >= 0
        within = up and inside[parent]
        # Headers of the content itself stay.
        names = names - {"header"} if within else names
        side = is_hidden or name == "header" and not within or names and k not in whole
        out.append(bool(side) or up and out[parent])
        inside.append(within or k in chosen)
    return [(None if out[e] else feature, size, text, inside[e]) for e, feature, size, text in items], landmark


def default_weight(feature: str) -> float:
    if feature[0] == "<":
        return TAG_DEFAULT
    return LINK_DEFAULT if feature.endswith("/a") else WORD_DEFAULT


def _key(feature: str, landmark: str | None, inside: bool) -> str:
    """The weight's name: with the landmark's side where the page has one."""
    return feature if landmark is None else f"{feature}|{'in' if inside else 'out'}"


def _side(feature: str, inside: bool) -> str:
    """The weight's name of all words, or all tags, on a side of a landmark."""
    return f"{'<' if feature[0] == '<' else ''}|{'in' if inside else 'out'}"


def weight_of(feature: str, landmark: str | None, inside: bool, weights: dict[str, float]) -> float:
    """A feature's weight; on pages with a landmark backed off to its side, never to the default of links."""
    weight = weights.get(_key(feature, landmark, inside))
    if weight is None and landmark is not None:
        weight = weights.get(_side(feature, inside))
        if weight is None and inside:
            return TAG_LEAST if feature[0] == "<" else WORD_DEFAULT
    return default_weight(feature) if weight is None else weight


def learn_weights(df: DataFrame, html_col: str, labelled: int) -> dict[str, float]:
    """Log odds of content for each feature, from at most ``labelled`` labelled pages.

    Words are clipped to plus or minus ``CLIP``. Tags are never positive, so a run of tags
    without words cannot extend the region.
    """
    low = F.lower("text")
    marked = df.select(F.col(html_col).alias("text")).filter(low.contains("<article") | low.contains("<main"))
    hashed = marked.withColumn("hash", F.xxhash64("text"))

    @F.arrow_udf("boolean")
    def has_landmark(column: pa.Array) -> pa.Array:
        return pa.array([read_page(page or "")[1] is not None for page in column.to_pylist()], pa.bool_())

    # Only hashes are ordered in one task; pages are then picked by the last of them.
    least = hashed.filter(has_landmark("text")).select("hash").distinct().orderBy("hash").limit(labelled)
    last = least.agg(F.max("hash").alias("last")).first()["last"]
    sample = hashed.filter(F.col("hash") <= (F.lit(0) if last is None else F.lit(last))).dropDuplicates(["hash"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = defaultdict(lambda: [0, 0])
        for _, rows in texts(batches, "text"):
            for page in rows:
                items, landmark = read_page(page)
                for feature, size, _, inside in items:
                    if feature is not None and landmark is not None:
                        for key in (feature, _key(feature, landmark, inside), _side(feature, inside)):
                            seen[key][not inside] += size
        # Only tags that separate blocks are counted, so names stay few.
        seen = {k: v for k, v in seen.items() if any(v)}
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(seen)),
                    pa.array([v[0] for v in seen.values()], pa.int64()),
                    pa.array([v[1] for v in seen.values()], pa.int64()),
                ],
                ["feature", "inside", "outside"],
            )

    counts = sample.mapInArrow(count, "feature string, inside long, outside long").groupBy("feature")
    out = {}
    # Features are names of block elements with few suffixes, so these rows are bounded.
    for r in counts.agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).collect():
        odds = max(-CLIP, min(CLIP, math.log((r.a + 0.5) / (r.b + 0.5))))
        out[r.feature] = min(TAG_LEAST, odds) if r.feature[0] == "<" else odds
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the greatest positive sum, the first of equals."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def extract(page: str, weights: dict[str, float]) -> str:
    """The main text of a page."""
    items, landmark = read_page(page)
    scores = []
    for feature, size, text, inside in items:
        if feature is None:
            scores.append(0.0)
            continue
        weight = weight_of(feature, landmark, inside, weights)
        scores.append(weight if text is None else weight * size)
    low, high = best_run(scores)
    blocks: list[list[str]] = [[]]
    for feature, size, text, _ in items[low:high]:
        if text is None:
            if size:
                blocks.append([])
            elif feature == "<br":
                blocks[-1].append(" ")
        elif feature is not None:
            blocks[-1].append(text)
    return "\n".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def main_text(df: DataFrame, html_col: str = "html", out_col: str = "text", labelled: int = 500) -> DataFrame:
    """The table with the main text of each page as ``out_col``, which replaces any such column."""
    weights = df.sparkSession.sparkContext.broadcast(learn_weights(df, html_col, labelled))

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([extract(page or "", weights.value) for page in column.to_pylist()], pa.string())

    return df.withColumn(out_col, run(F.col(html_col)))
