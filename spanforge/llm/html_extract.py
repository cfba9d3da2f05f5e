"""Main text of web pages by line-block distribution.

The markup is stripped into blocks ("lines"), one for each run of text between block-level tags. Every line has a weight: its characters that no link holds, or none where it
stands in a part of the page that is known not to be the article (menus, headers, footers, sidebars, forms, scripts, reader comments, adverts, notices), or outside the
article or main element of a page where that holds most of the other text. A form, or an element that only a class or id marks, is no such part
where it holds most of the article elements' text or of the page's.

The weights are summed over sliding windows of lines. A surge point is where the sum rises to the threshold, a dive point where it falls below it again; the text between the
first surge and the last dive is kept, lines of links among it too, but for the parts that are known to be others. What stands before or after is cut: menus and lists of
links that nothing else tells from the article. The threshold is a share of the page's own largest sum, ``SURGE`` at most; where the page marks its article, any text that is no link makes a surge.
A page whose text is links only is taken as if they were none.

Null or empty html gives an empty text, an empty table an empty result. Repeated rows each give a row; other columns of the input are ignored, whatever their names. Pages are
worked on one by one, each whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import slices, table

WINDOW, SURGE, SHARE = 3, 80, 0.1

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>",
    re.S | re.I,
)
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav header footer aside form button dialog menu head select fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that mark other parts than the article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget\w*|comments?|commentlist|disqus|replies|reply|respond"
    r"|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|toolbar|pagination|pager|tags|legal|copyright|skip)(?:$|[\s_-])",
    re.I,
)
#: Those of them that are others' words wherever they stand, and so never wrap the article.
FOREIGN = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|adbox|adsense|sponsor\w*|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|related|recommend\w*)(?:$|[_-])", re.I)
#: Classes that tell what an element has or lacks, not what it is.
STATE = re.compile(r"(?:^|[_-])(?:has|no|with|without)[_-]", re.I)
ATTR = re.compile(r"""([a-zA-Z:_-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def _excluded(tag: str, attrs: str) -> int:
    """2 for a part that is known not to be the article, 1 for one that may yet wrap it, else 0."""
    if tag in ASIDE and tag != "form":
        return 2
    found = int(tag == "form")
    if attrs and tag not in ("body", "html"):
        for name, a, b, c in ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return 2
            if name in ("class", "id"):
                marks = [x for x in value.split() if MARKS.search(x) and not STATE.search(x)]
                if any(FOREIGN.search(x) for x in marks):
                    return 2
                found = max(found, int(bool(marks)))
        if re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
            return 2
    return found


Line = tuple[str, bool, bool, int]


def lines(page: str) -> list[Line]:
    """The text blocks of a page in order: (text, in an excluded part, in an article or main element, characters outside links)."""
    out: list[Line] = []
    open_tags: list[tuple[str, int, bool, int]] = []  # (tag, excluded, article, first line)
    wraps: list[tuple[int, int]] = []  # lines of the parts that may wrap the article
    parts: list[str] = []
    links: list[str] = []
    excluded = article = linked = 0
    at = 0

    def end() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        other = sum(len(x) for x in entities.unescape("".join(links)).split())
        parts.clear()
        links.clear()
        if text:
            out.append((text, excluded > 0, article > 0, max(0, sum(len(x) for x in text.split(" ")) - other)))

    def add(text: str) -> None:
        parts.append(text)
        if linked:
            links.append(text)

    def leave() -> str:
        nonlocal excluded, article
        t, e, a, first = open_tags.pop()
        excluded -= e == 2
        article -= a
        if e == 1 and first < len(out):
            wraps.append((first, len(out)))
        return t

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            linked = int(not m["close"])
        if tag in INLINE and not (tag not in VOID and not m["close"] and _excluded(tag, m["attrs"])):
            if tag == "br":
                parts.append(" ")
            if not m["close"] or not any(x[0] == tag for x in open_tags[-8:]):
                continue
        if m["close"]:
            end()
            if tag == "p" or any(x[0] == tag for x in open_tags):
                while open_tags:
                    if tag == "p" and open_tags[-1][0] != "p":
                        break
                    if leave() == tag:
                        break
        else:
            end()
            while open_tags and (open_tags[-1][0] == "p" and tag not in INLINE or tag == "li" and open_tags[-1][0] == "li"):
                leave()
            if tag not in VOID and not m["attrs"].rstrip().endswith("/"):
                e, a = _excluded(tag, m["attrs"]), tag in ("article", "main") or 'itemprop="articleBody"' in m["attrs"]
                open_tags.append((tag, e, a, len(out)))
                excluded += e == 2
                article += a
    add(page[at:])
    end()
    while open_tags:
        leave()
    return _without_wraps(out, wraps)


def _without_wraps(found: list[Line], wraps: list[tuple[int, int]]) -> list[Line]:
    """The lines, with those of ``wraps`` excluded unless a wrap holds most of the text, or of the article elements' text, that isn't excluded yet."""
    text = [0, *accumulate(0 if other else len(t) for t, other, _, _ in found)]
    article = [0, *accumulate(len(t) if inside and not other else 0 for t, other, inside, _ in found)]
    depth = [0] * (len(found) + 1)
    for a, b in wraps:
        if all(2 * (sums[b] - sums[a]) <= sums[-1] for sums in (text, article)):
            depth[a] += 1
            depth[b] -= 1
    return [(t, other or d > 0, inside, free) for (t, other, inside, free), d in zip(found, accumulate(depth[:-1]), strict=True)]


def block_sums(weights: list[int], window: int = WINDOW) -> list[int]:
    """The sum of the weights of each line and the ``window`` - 1 after it."""
    upto = [0, *accumulate(weights)]
    return [upto[min(len(weights), i + window)] - upto[i] for i in range(len(weights))]


def stretches(sums: list[int], least: float) -> list[tuple[int, int]]:
    """(surge, dive) points: from the window whose sum reaches ``least`` to the first one after it whose sum doesn't."""
    out, surge = [], None
    for i, x in enumerate([*sums, -1]):
        if x >= least and surge is None:
            surge = i
        elif x < least and surge is not None:
            out.append((surge, i))
            surge = None
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between the first surge and the last dive point of the page's lines, joined by a newline."""
    blocks = lines(page or "")
    free = sum(len(text) for text, other, _, _ in blocks if not other)
    marked = 2 * sum(len(text) for text, other, inside, _ in blocks if inside and not other) > free
    own = [(text, n) for text, other, inside, n in blocks if not other and (inside or not marked)]  # the other lines weigh nothing, and don't part the windows
    weights = [n for _, n in own]
    if not any(weights):
        weights = [len(text) for text, _ in own]
    sums = block_sums(weights, window)
    found = stretches(sums, 1 if marked else max(1, min(surge, SHARE * max(sums, default=0))))
    if not found:
        return ""
    first, last = found[0][0], found[-1][1] - 1  # the windows of the first surge and before the last dive
    while not weights[first]:  # a window rises by the lines at its end, and falls by those at its begin
        first += 1
    last = max(i for i in range(last, min(len(weights), last + window)) if weights[i])
    return "\n".join(text for text, _ in own[first : last + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")


QUERIES = {"op3_html_extract": lambda spark, sf_dir: extract(table(spark, sf_dir, "pages"))}
ORACLE: dict[str, str] = {}
