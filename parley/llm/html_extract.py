"""Main text of web pages by consensus host paths (operator 7).

A page is cut into blocks: runs of text between block tags, each in an element of the page's tree. An
element's path is the chain of generalised ``tag.class`` steps down to it (digits in classes become
``#``), kept as a 64-bit hash. Containers are scored by the text that they hold: characters of prose less
what is in links, weighted by how article-like their own tag and class are; boilerplate (navigation,
headers, footers, asides, notices, adverts, forms, comments, scripts, styles) counts for nothing and is
never returned. Spark adds up the scores by host and path, and the best path of a host wins. Pages are
then extracted again with their host's path; a page that does not have it uses the best of its own
containers, else its whole body. A first-level headline before the container belongs to it if the
container has none.

Parsing takes time in proportion to the page, however deep or unclosed its markup is: elements point to
their parents, what they inherit is passed down and their scores are passed up in one pass each, and an end tag
finds its start tag by name.

Cases: a null or empty html has the empty text; a null URL or one without a host votes with the others
of its kind under the empty host; null ids are kept; repeated rows vote once each and get equal
texts; an empty table gives an empty result; other columns are ignored. Unclosed and stray tags
are tolerated: block tags end open paragraphs, an end tag closes up to its match, a quote without an end
ends with its tag; scripts, pictures and form controls don't split the text around them.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.store import table

#: A tag from its ``<``. Quotes count only after an equals sign; nothing here is tried twice.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?>\s*=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol p plaintext pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Skipped whole with their content. The content of the first is no markup: without an end tag it runs to the end of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset("noscript template object svg canvas audio video select button datalist".split())
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SKIPPED}
#: Tags that are boilerplate wherever they stand.
OUTSIDE = frozenset("nav footer aside form dialog menu search".split())
#: What start tags end: if such an element is the innermost.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "thead", "tbody")}
#: Words that, as a class, id or role or as the first or last part of one, name boilerplate.
_OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget footer foot contentinfo complementary cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments replies reply disqus discussion pagination pager toolbar skip search".split()
)
#: These only outside of articles, where the page's own header stands.
_HEADER_WORDS = frozenset("header head masthead topbar top".split())
#: A name that begins so tells of the page's layout, as ``no-sidebar`` does.
_LAYOUT_WORDS = frozenset("no non not without with has have is hide layout page body col cols column columns one two three".split())
_ARTICLE_WORDS = frozenset("article content main post entry story hentry maincontent".split())
_ARTICLE_NAMES = re.compile(r"article|content|main|post|entry|story|text|body", re.I)
_PROSE = frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot pre hr caption legend figcaption".split())
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[-_\d]+")


@dataclass
class Page:
    """Elements in the order of their start tags, the first standing for the page; and the blocks of text."""

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    step: list[str] = field(default_factory=lambda: [""])
    path: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    outside: list[bool] = field(default_factory=lambda: [False])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters in links


def path_hash(steps: str) -> int:
    """The hash of a path written as ``body/div.main-#``."""
    h = 0
    for step in steps.split("/"):
        h = xxhash.xxh64_intdigest(step, h)
    return h


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(text))} if text.strip("/ ") else {}


def _hides(found: dict[str, str]) -> bool:
    """Whether an element's own attributes hide it."""
    return found.get("hidden", "false").lower() != "false" or found.get("aria-hidden", "").strip().lower() == "true" or ("style" in found and bool(re.search(r"display\s*:\s*none", found["style"], re.I)))


def _named_outside(found: dict[str, str], in_article: bool) -> bool:
    """Whether class, id or role name boilerplate. A whole name decides; else a name of the article outweighs parts of names."""
    partly = article = False
    for name in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".lower().split():
        parts = [x for x in _PARTS.split(name) if x]
        if not parts or parts[0] in _LAYOUT_WORDS:
            continue
        if len(parts) == 1:
            if parts[0] in _OUTSIDE_WORDS or not in_article and parts[0] in _HEADER_WORDS:
                return True
            article = article or parts[0] in _ARTICLE_WORDS
        elif parts[0] in _OUTSIDE_WORDS or parts[-1] in _OUTSIDE_WORDS or not in_article and (parts[0] in _HEADER_WORDS or parts[-1] in _HEADER_WORDS and parts[0] not in _ARTICLE_WORDS):
            partly = True
        elif parts[0] in _ARTICLE_WORDS and parts[-1] in ("body", "content", "text", "main"):
            article = True
    return partly and not article


def parse(page: str) -> Page:
    """The elements and the blocks of a page; hidden text is left out, boilerplate is marked."""
    out = Page()
    stack, hidden, article = [0], [False], [False]  # by depth; whether hidden and whether in an article
    opened: dict[str, list[int]] = defaultdict(list)  # depths by tag
    parts: list[str] = []
    linked = links = at = 0
    absent: set[str] = set()  # tags that no longer end
    forms: list[int] = []

    def flush() -> None:
        nonlocal linked, links
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.blocks.append((stack[-1], text, linked))
            parts.clear()
        linked = links = 0

    def close_to(depth: int) -> None:
        for element in stack[depth:]:
            opened[out.tag[element]].pop()
        del stack[depth:], hidden[depth:], article[depth:]

    def start(tag: str, found: dict[str, str], hides: bool) -> None:
        kind = " ".join(sorted(set(re.sub(r"\d+", "#", found.get("class", "")).split())))
        step = tag + ("." + kind.replace(" ", ".") if kind else "")
        above = stack[-1]
        off = tag in OUTSIDE or tag == "header" and not article[-1]
        if tag not in ("html", "body", "article", "main"):
            off = off or bool(found) and _named_outside(found, article[-1])
        if tag == "form":
            forms.append(len(out.tag))
        opened[tag].append(len(stack))
        stack.append(len(out.tag))
        hidden.append(hidden[-1] or hides)
        article.append(article[-1] or tag in ("article", "main"))
        for column, value in ((out.parent, above), (out.tag, tag), (out.step, step), (out.path, xxhash.xxh64_intdigest(step, out.path[above])), (out.depth, out.depth[above] + 1), (out.outside, off)):
            column.append(value)

    def add(text: str) -> None:
        nonlocal linked
        if not hidden[-1]:
            parts.append(entities.unescape(text) if "&" in text else text)
            if links:
                linked += len(text)

    while at < len(page):
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        at = less
        after = page[at + 1 : at + 2]
        if after in ("!", "?"):
            if page.startswith("<!--", at):
                end = at + 4 if page.startswith(("<!-->", "<!--->"), at) else page.find("-->", at + 4)
                at = len(page) if end < 0 else page.find(">", end) + 1
            else:
                end = page.find("]]>", at) + 2 if page.startswith("<![CDATA[", at) else -1
                end = end if end > 1 else page.find(">", at)
                at = len(page) if end < 0 else end + 1
            continue
        match = _TAG.match(page, at)
        if not match:  # no markup; an end tag without a name is dropped
            end = page.find(">", at) if after == "/" else -1
            if end < 0:
                add("<")
            at = end + 1 if end >= 0 else at + 1
            continue
        at = match.end()
        closing, tag, rest = match.groups()
        tag = tag.lower()
        if tag in SKIPPED:
            if not closing and tag not in absent:
                end = _END[tag].search(page, at)
                if end:
                    at = end.start()
                elif tag in RAW:
                    at = len(page)
                else:
                    absent.add(tag)
            continue
        if tag == "br":
            add(" ")
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            depth = opened[tag][-1] if opened[tag] else 0
            # A stray end of a paragraph or item doesn't reach out of an article or a cell.
            if depth and (tag not in ("p", "li") or all(not opened[x] or opened[x][-1] < depth for x in ("article", "main", "td"))):
                if tag in BLOCK:
                    flush()
                close_to(depth)
            elif tag in BLOCK:
                flush()
            continue
        found = _attributes(rest)
        hides = bool(found) and tag not in ("html", "body") and _hides(found)
        if tag not in BLOCK:
            if tag == "a":
                links += 1
            if hides and not rest.endswith("/"):
                start(tag, found, hides)
            continue
        flush()
        if tag == "hr":
            continue
        if out.tag[stack[-1]] == "p":
            close_to(len(stack) - 1)  # a block tag ends an open paragraph
        while out.tag[stack[-1]] in _ENDS.get(tag, ()):
            innermost = out.tag[stack[-1]]
            close_to(len(stack) - 1)
            if innermost == tag:
                break
        start(tag, found, hides)
    flush()
    # A form that holds an article is the page's frame.
    if forms:
        holds = [tag in ("article", "main", "h1") for tag in out.tag]
        for k in range(len(holds) - 1, 0, -1):
            holds[out.parent[k]] = holds[out.parent[k]] or holds[k]
        for k in forms:
            out.outside[k] = out.outside[k] and not holds[k]
    for k in range(1, len(out.tag)):
        out.outside[k] = out.outside[k] or out.outside[out.parent[k]]
    return out


def container_scores(page: Page) -> dict[int, tuple[float, int]]:
    """Score and depth of every container path, the whole page's among them: the prose in it, weighed by its own step."""
    held = [0.0] * len(page.tag)
    for element, text, linked in page.blocks:
        if not page.outside[element]:
            held[element] += max(0, len(text) - 2 * linked)
    for k in range(len(held) - 1, 0, -1):
        held[page.parent[k]] += held[k]
    out: dict[int, tuple[float, int]] = {}
    for k, tag in enumerate(page.tag):
        if held[k] and tag not in _PROSE and (tag in BLOCK or k == 0):
            weight = 4.0 if tag == "article" else 3.0 if tag == "main" else 2.0 if _ARTICLE_NAMES.search(page.step[k].partition(".")[2]) else 1.0
            out[page.path[k]] = out.get(page.path[k], (0.0, 0))[0] + held[k] * weight, page.depth[k]
    return out


def extract(page: Page, winner: int | None) -> str:
    """Text of the blocks inside ``winner``, or inside the best container if the page hasn't that path."""

    def inside(container: int) -> list[str]:
        within = [page.path[0] == container] * len(page.tag)
        for k in range(1, len(within)):
            within[k] = within[page.parent[k]] or page.path[k] == container
        found, before, headed = [], [], False
        for element, text, _ in page.blocks:
            if page.outside[element]:
                continue
            if within[element]:
                found.append(text)
                headed = headed or page.tag[element] == "h1"
            elif not found and page.tag[element] == "h1":
                before.append(text)
        return found if headed or not found else before + found

    found = inside(winner) if winner is not None else []
    if not found:
        scores = container_scores(page)
        found = inside(min(scores, key=lambda x: (-scores[x][0], scores[x][1], x))) if scores else []
    return " ".join(found or [text for element, text, _ in page.blocks if not page.outside[element]])


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, depth, score, pages): container scores, a page's scaled to 1 and summed by task."""

    def run(batches):
        held: dict[tuple[str, int], list] = defaultdict(lambda: [0, 0.0, 0])

        def out():
            keys = list(held)
            path = pa.array([k[1] - (k[1] >> 63 << 64) for k in keys], pa.int64())
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys]), path, *(pa.array([held[k][i] for k in keys], kind) for i, kind in enumerate((pa.int32(), pa.float64(), pa.int64())))], names=["host", "path", "depth", "score", "pages"]
            )
            held.clear()
            return batch

        for batch in batches:
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                scores = container_scores(parse(page or ""))
                most = max((score for score, _ in scores.values()), default=0)
                for path, (score, depth) in scores.items():
                    entry = held[name, path]
                    entry[0] = depth
                    entry[1] += score / most
                    entry[2] += 1
                if len(held) > 50_000:
                    yield out()
        if held:
            yield out()

    by_task = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path long, depth int, score double, pages long")
    return by_task.groupBy("host", "path").agg(F.max("depth").alias("depth"), F.sum("score").alias("score"), F.sum("pages").alias("pages"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and its winning path: the highest sum of scores, then the shorter path."""
    best = F.max(F.struct(F.round("score", 6), -F.col("depth"), F.col("path").alias("path")))
    return votes(pages).groupBy("host").agg(best.alias("best")).select("host", "best.path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The winners are a written table whose size Catalyst knows: few hosts are broadcast, many
    are joined by a shuffle in which the adaptive skew join splits a host that has many pages.
    """
    winners = table(winning_paths(pages), "host-paths")

    def run(batches):
        for batch in batches:
            texts = [extract(parse(page or ""), None if winner is None else winner & 0xFFFFFFFFFFFFFFFF) for page, winner in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    asked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host")).join(winners, "host", "left")
    return asked.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long")
