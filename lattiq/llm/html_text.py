"""Main text of web pages by line-block distribution.

Markup is stripped so that every block of a page becomes a line. Lines inside menus, forms and the like (by element, role,
class or id) weigh nothing;
others weigh their characters outside of links, white space apart. Weights are summed over sliding windows of lines; a
surge is where the sum rises from nothing, a dive where it falls to nothing again. A stretch between a surge and a dive is
judged by itself: it stays, whatever its length, if at least ``DENSITY`` of its characters are outside of links; the
heaviest one always stays. Blocks without weight between the first and the last with weight of a stretch stay. Elements
that mark an article (article, main) only add to that: where a kept stretch has weight in one, all of its blocks stay,
the first and last ones too.

No shuffle; a page is read whole, however long it is. Defined results: a null or empty page gives an empty text; a page
without any weight gives an empty text; a tag that the page breaks off in is markup; repeated rows are extracted each; an
empty table gives an empty result. Columns other than page_id, url and html are not read, whatever their names are.
"""

from __future__ import annotations

import html
import re
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, pieces, texts_of, tidy

#: Lines to a window, and the share of a stretch's own characters outside of links from which it stays.
WINDOW, DENSITY = 3, 1 / 3

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|select|textarea|iframe|object|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^<>"']+|"[^"]*"|'[^']*')*+)/?>|<[!?/a-zA-Z][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split())
#: Elements whose nesting is followed.
_NEST = frozenset("article aside body button details dialog div dl fieldset figure footer form head header main menu nav ol section span table td ul".split())
_APART = frozenset("aside button dialog footer form head menu nav".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id names that mark what is not the article, in any compound.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comments consent cookie cookies disqus footer gdpr masthead menu menus modal nav navbar navigation newsletter "
    "pager pagination popup promo promoted promotion sidebar sidebars signup sponsor sponsored sponsors subscribe subscription toolbar topbar".split()
)
#: Words that do so alone, or among these and words for boxes: an article has an entry-header and may tell of search-results.
_WEAK = frozenset(
    "banner byline comment copyright disclaimer discussion dropdown form header hidden login notice notices popular privacy related replies reply respond responses search share "
    "sharing skip social trending widget widgets".split()
)
_BOXES = frozenset("area bar block body box bottom buttons col column container content global group inner item items left links list main outer page panel right row section site slot top wrap wrapper".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


@cache
def _apart(tag: str, attributes: str) -> bool:
    """Whether an element's name or attributes tell that it is not part of the article."""
    if tag in _APART:
        return True
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id"):
            for compound in value.split():
                words = set(re.findall(r"[a-z]+", compound))
                if words & _STRONG or words & _WEAK and words <= _WEAK | _BOXES:
                    return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, int, int]]:
    """(text, apart, number of the outermost article or main element that holds it, link characters, without white space) of each block."""
    out: list[tuple[str, bool, int, int]] = []
    stack: list[tuple[str, bool, int]] = []  # element, apart, article
    parts: list[str] = []
    linked: list[str] = []
    articles = at = 0
    in_link = False

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, apart, article = stack[-1] if stack else ("", False, 0)
                out.append((text, apart, article, len("".join(html.unescape("".join(linked)).split())) if linked else 0))
            linked.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked.append(parts[-1])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is None and not m[0].startswith("<!"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            close()
        elif tag == "a":
            in_link = not m[2]
        elif tag in ("br", "td", "th", "img", "input"):
            parts.append(" ")
        if tag not in _NEST:
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close()
                    del stack[k:]
                    break
        elif not m[0].endswith("/>"):
            _, apart, article = stack[-1] if stack else ("", False, 0)
            own = _apart(tag, m[4]) or tag == "header" and not article
            if own and not apart:
                close()  # what an inline element holds apart is a block of its own
            if tag in ("article", "main") and not article and not apart and not own:
                articles += 1
                article = articles
            stack.append((tag, apart or (own and tag != "body"), article))
    if page[at:].strip():
        parts.append(page[at:])
    close()
    return out


def main_text(page: str) -> str:
    lines = lines_of(page)
    weight = [0 if apart else max(0, len(text) - text.count(" ") - links) for text, apart, _, links in lines]
    if not any(weight):
        return ""
    # windows that begin at each line; a stretch runs from a surge to the next dive
    sums = [sum(weight[k : k + WINDOW]) for k in range(len(weight))]
    stretches, begin = [], None
    for k, s in enumerate([*sums, 0]):
        if s and begin is None:
            begin = k
        elif not s and begin is not None:
            stretches.append((begin, k))
            begin = None
    chosen, heavy = set(), []
    for a, b in stretches:
        at = [k for k in range(a, b) if weight[k]]
        heavy.append((sum(weight[k] for k in at), at))
        linked = sum(x[3] for x in lines[at[0] : at[-1] + 1] if not x[1])
        if heavy[-1][0] >= DENSITY * (heavy[-1][0] + linked):
            chosen.update(range(at[0], at[-1] + 1))
    at = max(heavy, key=lambda x: x[0])[1]
    chosen.update(range(at[0], at[-1] + 1))
    # articles that these lines lie in stay as a whole
    articles = {lines[k][2] for k in chosen if weight[k]} - {0}
    return "\n".join(x[0] for k, x in enumerate(lines) if not x[1] and (k in chosen or x[2] in articles))


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches):
        for batch in pieces(batches, "html"):
            texts = [main_text(t) for t in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    bounded_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(tidy(work), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: one row a page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
