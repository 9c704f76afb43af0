"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is cut into tokens by one pattern: comments, scripts and styles, tags, and text between them. Words score
positive and tags negative; one linear scan finds the contiguous run of tokens with the greatest sum, which is then
widened to whole blocks of text. Scores are weights from labelled pages: pages that mark their content with an article
or main element say, per kind of tag and per element that words stand in (a link, a paragraph, a menu), how much more
often it is found inside than outside. So the words of a list of links cost, wherever they stand; on a page with an
article or main element, all words outside of it cost (where there is a main element, it alone). A page without either that writes
most words straight into boxes such as div keeps them, whatever boxes hold on the labelled pages. What stands in known boilerplate elements costs little, so a run
may cross a notice or form inside an article; it is left out when the run is rendered block by block.

Defined results: null or empty html, and pages without a word that scores, give an empty text; a tag whose quotes don't
end is a tag up to its first `>`. Extra columns are not read."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages the weights are learned from, on average, chosen by a hash of page_id.
MAX_FIT_PAGES = 2000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORDS = re.compile(r"[a-z]+")
MAIN = re.compile(r"<main[\s>/]", re.I)
SPACES = re.compile(r"[ \t\n\r\f\v ]+")

#: Fixed lists: elements that end a block of text, void elements, elements of boilerplate, words of their classes.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("head title nav header footer aside form button label input menu dialog object audio video canvas map datalist".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments cookie cookies consent discussion disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related replies reply share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that end the name of a class and only say what it holds; names of contents, whose headers belong to them.
HOLDERS = frozenset("area bar block body box button buttons container content entry group holder icon inner item items label layer line link links list outer panel row section slot space text title top unit wrap wrapper zone".split())
OF_CONTENT = frozenset("article content entry headline main page post story".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that a start tag closes where they are still open (HTML's implied end tags).
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT = frozenset(("article", "main"))
#: Boxes that say nothing of what they hold, and elements of running text, which no name makes boilerplate inside an article.
BOXES = frozenset(f"@{x}" for x in "body center dd div fieldset section table tbody td tr".split())
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: What a word in a box scores on a page that writes most of its words straight into boxes.
BOX_WORD = 0.5
#: What a token inside a boilerplate element costs (nothing inside an article or main element); what a tag inside an
#: article or main element, and an unknown tag, costs; what a word of a page's title adds.
BOILERPLATE_COST, CONTENT_TAG, UNKNOWN_TAG, TITLE_WORD = 0.05, -0.1, -0.5, 3.0
#: Words of evidence that a kind of words scores like the text of a page, before any page is counted.
PRIOR_WORDS = 200


def _names_boilerplate(value: str, content: bool) -> bool:
    """Whether one of the names in a class or id is one of boilerplate: what it ends with counts, apart from holders."""
    for name in value.split():
        words = WORDS.findall(name)
        while len(words) > 1 and words[-1] in HOLDERS:
            words.pop()
        if words and words[-1] in BOILERPLATE_WORDS and not (words[-1] == "header" and (content or not OF_CONTENT.isdisjoint(words))):
            return True
    return False


def _marks(attributes: str, content: bool, running: bool = False) -> bool:
    """Whether a tag's attributes say boilerplate or hidden."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and not running and _names_boilerplate(value, content):
            return True
    return False


def tokens(page: str) -> list[tuple[str, str, bool, bool]]:
    """(kind, text, boilerplate, inside an article or main element) for each token; kind is `@` and the element that text
    stands in (a link or the nearest block), or the tag's name with a slash where it closes."""
    out, stack, noise, content, links = [], [], 0, 0, 0
    open_: dict[str, int] = {}
    # Where a page has a main element, an article elsewhere (a reader's comment, a teaser) isn't its content.
    holding = frozenset(("main",)) if MAIN.search(page) else CONTENT

    def close():
        nonlocal noise, content, links
        name, own, _ = stack.pop()
        open_[name] -= 1
        noise -= own
        content -= name in holding
        links -= name == "a"

    for m in TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            out.append(("@a" if links else stack[-1][2] if stack else "@body", text, noise > 0, content > 0))
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        if m.group(2):
            if open_.get(name):
                while stack[-1][0] != name:
                    close()
                close()
            out.append(("/" + name, "", noise > 0, content > 0))
            continue
        attributes = m.group(4).removesuffix(">")
        closes = CLOSED_BY.get(name, {"p"} if name in BLOCKS else ())
        if stack and stack[-1][0] in closes:
            close()
        own = name in BOILERPLATE and not (name in ("header", "label") and content) or _marks(attributes, content > 0, content > 0 and name in RUNNING)
        if name in CONTENT or name in ("body", "html"):
            own = False
        out.append((name, "", noise + own > 0, content > 0))
        if name not in VOID and not attributes.endswith("/"):
            stack.append((name, int(own), f"@{name}" if name in BLOCKS or own else stack[-1][2] if stack else "@body"))
            open_[name] = open_.get(name, 0) + 1
            noise += own
            content += name in holding
            links += name == "a"
    return out


def scores(page: list[tuple[str, str, bool, bool]], weights: dict[str, float]) -> list[float]:
    """What each token adds to a run."""
    labelled, out = any(t[3] for t in page), []
    boxes = {}
    if not labelled:
        count: dict[bool, int] = {True: 0, False: 0}
        for kind, text, boilerplate, _ in page:
            if kind[0] == "@" and not boilerplate and (kind in BOXES or weights.get(kind, 1.0) > 0):
                count[kind in BOXES] += len(text.split())
        boxes = dict.fromkeys(BOXES, BOX_WORD) if count[True] > count[False] else {}
    for kind, text, boilerplate, content in page:
        n = len(text.split()) if kind[0] == "@" else 1
        if boilerplate:
            out.append(0.0 if content else -BOILERPLATE_COST * n)
        elif kind[0] == "@":
            out.append(n * ((1.0 if content else weights.get("outside", -1.0)) if labelled else max(weights.get(kind, 1.0), boxes.get(kind, -1.0)) * (TITLE_WORD if kind == "@h1" else 1.0)))
        else:
            out.append(CONTENT_TAG if content else weights.get(kind, UNKNOWN_TAG))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """The run with the greatest sum, by one scan: (first, one beyond the last); the shortest of equals."""
    best, run, at, found = 0.0, 0.0, 0, (0, 0)
    for i, value in enumerate(values):
        run += value
        if run <= 0:
            run, at = 0.0, i + 1
        elif run > best:
            best, found = run, (at, i + 1)
    return found


def whole_blocks(page: list[tuple[str, str, bool, bool]], first: int, last: int) -> tuple[int, int]:
    """The run widened to the ends of its first and its last block."""
    ends = lambda i: page[i][0][0] != "@" and page[i][0].lstrip("/") in BLOCKS
    while first < last and first > 0 and not ends(first) and not ends(first - 1):
        first -= 1
    while first < last < len(page) and not ends(last - 1) and not ends(last):
        last += 1
    return first, last


def render(page: list[tuple[str, str, bool, bool]]) -> str:
    """Blocks of text, without boilerplate, white space made single, joined by an empty line."""
    blocks, now = [], []
    for kind, text, boilerplate, _ in page:
        if kind[0] == "@":
            if not boilerplate:
                now.append(text)
        elif kind == "br":
            now.append(" ")
        elif kind.lstrip("/") in BLOCKS:
            blocks.append(now)
            now = []
    blocks.append(now)
    clean = (SPACES.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(page: str | None, weights: dict[str, float]) -> str:
    if not page:
        return ""
    found = tokens(page)
    a, b = whole_blocks(found, *best_run(scores(found, weights)))
    return render(found[a:b])


def _tally(batches):
    for batch in batches:
        inside: dict[str, int] = {}
        outside: dict[str, int] = {}
        for page in batch.column(0).to_pylist():
            found = tokens(page or "")
            if not any(t[3] for t in found):
                continue
            for kind, text, boilerplate, content in found:
                if boilerplate and content:
                    continue
                n = len(text.split()) if kind[0] == "@" else 1
                where = inside if content else outside
                where[kind] = where.get(kind, 0) + n
        kinds = sorted({*inside, *outside})
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array([inside.get(k, 0) for k in kinds], pa.int64()), pa.array([outside.get(k, 0) for k in kinds], pa.int64())], names=["kind", "inside", "outside"])


def fit(pages: DataFrame, max_fit_pages: int = MAX_FIT_PAGES) -> dict[str, float]:
    """Weights from the pages with an article or main element: how much likelier a kind of token is inside than outside, in
    logarithms; words from -1 to 1, tags from -1 to -0.1. `outside` is for words outside such elements, `@` and a name for
    words of pages without them. Kinds beyond the 200 commonest get the values of unknown ones."""
    n = pages.count()
    share = min(1.0, max_fit_pages / n) if n else 0.0
    sample = pages.where((F.xxhash64(F.lit("fit"), "page_id") / float(1 << 63) + 1) / 2 < share)
    rows = sample.select(F.col("html").cast("string")).mapInArrow(_tally, "kind string, inside bigint, outside bigint")
    rows = rows.groupBy("kind").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o")).orderBy(F.desc(F.col("i") + F.col("o")), "kind").limit(200).collect()
    total_in, total_out = sum(r.i for r in rows) + 1, sum(r.o for r in rows) + 1
    out = {}
    for r in rows:
        if r.kind[0] == "@":
            out[r.kind] = min(1.0, max(-1.0, math.log((r.i + PRIOR_WORDS) / (r.o + 1))))
        else:
            out[r.kind] = min(-0.1, max(-1.0, math.log((r.i + 0.5) / total_in) - math.log((r.o + 0.5) / total_out)))
    words = [r for r in rows if r.kind[0] == "@"]
    out["outside"] = min(-0.1, max(-1.0, -math.log((sum(r.o for r in words) + PRIOR_WORDS) / (PRIOR_WORDS + 1) + 1.0)))
    return out


def _extractor(weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            texts = [extract(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    weights = fit(pages) if weights is None else weights
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extractor(weights), "page_id bigint, url string, text string, n_chars bigint")
