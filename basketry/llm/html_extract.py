"""HTML main text by consensus host paths.

1. Every page is cut into blocks of text, each under its chain of open containers. A
   container's path is the chain of tags and classes from the root, with digits
   generalised, so pages made from one template share paths. Each container is scored
   by the text of its blocks less what stands in links, fading with depth.
2. A page votes for its best path. Votes are added up per host and path in Spark (on the
   map side first, so a host with a third of the pages is a few rows per task); the
   winning paths of a host are those with at least ``SHARE`` of its votes, so there are
   at most 1 / SHARE of them.
3. The pages are read once more, and the text is taken from the winning path of the best
   score on the page, or from the page's own best path where no winner has ``LEAST`` of its
   score. A path is widened to the next container around it that adds text, when text
   outside links stands in that container itself (headline and lead over the content).

Menus, footers, sidebars, notices, adverts, scripts, styles, hidden parts and the header of
the page (not of an article) are known by tag, role or attribute, and are no part of a block.
A class or id that names such a thing, and a form, only raise a doubt: layouts carry such
words too (``content no-sidebar``, ``has-comments``, ``ad-free``). Doubtful elements are
judged from the one with most text outside links downwards: one is kept if most of its text
is outside links and what has been found to be the page's text so far is little beside it
(``DOUBT``), or next to nothing if its class or id says nothing else (``NAMED``), so that
what wraps the article stays and what stands beside it goes, however long the comments are.

The winning paths are broadcast when their written size is under ``BROADCAST_BYTES``;
beyond, pages and hosts meet in a shuffle join whose hot host is split at run time.

Containers nested deeper than ``MAX_DEPTH`` have no path of their own; their text belongs
to the path above them.

Defined cases: null html is empty, an empty page gives empty text; a null url, or one
without a host, is a host of its own page (no consensus); malformed, unclosed and
truncated markup is read leniently; repeated rows each give a row. Empty tables give
empty results. Extra columns are ignored."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import chunks, over_batches, written

SHARE = 0.1
FADE = 0.85
LEAST = 0.2         # of the page's best score, that a winner must have on the page
DOUBT = 0.25        # of a doubtful element's text, that may have been found outside it
NAMED, NAMED_TEXT = 250, 40     # an element whose class says nothing else needs that much text, with less outside
MAX_DEPTH = 64      # containers nested deeper count as part of the one at this depth
BROADCAST_BYTES = 16 << 20

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^<>"']*(?:"[^"]*"[^<>"']*|'[^']*'[^<>"']*)*)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_DIGITS = re.compile(r"\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
CONTAINERS = frozenset("html body main article section div td".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption "
    "figure figcaption address fieldset details summary center hr".split())
BOILERPLATE_TAGS = frozenset(
    "nav header footer aside form menu dialog button select option label input svg canvas object "
    "audio video head".split())
BOILERPLATE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog "
    "toolbar".split())
#: Words of a class or id that name something beside the article.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notification alert popup modal overlay newsletter "
    "subscribe subscription signup login social share sharing related recommended recommendations "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar widget "
    "footer header masthead comment comments commentlist reply replies respond disqus form search".split())
_WORDS = re.compile(r"[a-zA-Z][a-z]*|[A-Z]+")
_CLOSES_P = BLOCKS | BOILERPLATE_TAGS - frozenset("button select option label input svg canvas object audio video".split())


_TELLING = re.compile(r"class|id|role|hidden|style", re.I)


_HARD = BOILERPLATE_TAGS - {"form"}


def _doubt(tokens: list[str], words: frozenset[str]) -> int:
    """2 if a class or id names nothing but boilerplate, 1 if it has such a word, else 0."""
    out = 0
    for t in tokens:
        of = {w.lower() for w in _WORDS.findall(t)}
        if of & words:
            out = max(out, 2 if of <= words else 1)
    return out


@lru_cache(maxsize=4096)
def _boilerplate(tag: str, attrs: str, in_article: bool) -> tuple[bool, int, str]:
    """Whether an element is beside the article, how doubtful it is, its generalised classes."""
    got = {}
    for m in _ATTR.finditer(attrs):
        got.setdefault(m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or "")
    names, role = got.get("class", ""), got.get("role", "").lower()
    own_header = tag == "header" and in_article
    hard = (tag in _HARD and not own_header or role in BOILERPLATE_ROLES - {"form"} or "hidden" in got
            or got.get("aria-hidden", "").lower() == "true"
            or "display:none" in got.get("style", "").replace(" ", "").lower())
    words = BOILERPLATE_WORDS - {"header", "masthead"} if in_article else BOILERPLATE_WORDS
    doubt = 0 if tag in ("html", "body") else max(_doubt([*names.split(), got.get("id", "")], words),
                                                  int(tag == "form" or role == "form"))
    return hard, doubt, ".".join(sorted(_DIGITS.sub("#", c) for c in names.split()))


def _judged(found: list, kinds: list[int]) -> list[tuple[tuple[str, ...], str, int]]:
    """The blocks that stand in no doubtful element but such as are kept."""
    inside: dict[int, list[int]] = {}
    plain, linked = [0] * len(kinds), [0] * len(kinds)
    for i, (_, t, links, doubts) in enumerate(found):
        for k in doubts:
            inside.setdefault(k, []).append(i)
            plain[k] += len(t) - links
            linked[k] += links
    left = [len(doubts) for *_, doubts in found]        # doubtful elements not yet kept around each block
    text = sum(len(t) - links for _, t, links, doubts in found if not doubts)
    for k in sorted(inside, key=lambda k: (-plain[k], k)):
        if plain[k] > linked[k] and (text < DOUBT * plain[k] if kinds[k] == 1 else
                                     text < NAMED_TEXT and plain[k] >= NAMED):
            for i in inside[k]:
                left[i] -= 1
                if not left[i]:
                    text += len(found[i][1]) - found[i][2]
    return [(paths, t, links) for (paths, t, links, _), n in zip(found, left) if not n]


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(paths of the open containers from the root, text, characters in links) of each
    block of text that is not beside the article, in page order."""
    out: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []
    stack: list[tuple[str, bool, bool, int]] = []      # tag, boilerplate, container, doubtful
    paths: list[str] = []
    kinds: list[int] = []                              # of the doubtful elements, by number
    doubts: list[int] = []                             # the open ones
    parts: list[str] = []
    links, beside, in_link = 0, 0, 0
    opened: dict[str, int] = {}                        # open elements by tag

    def text(piece: str):
        nonlocal links
        if not beside and piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if in_link:
                links += len(piece)

    def flush():
        nonlocal links
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                out.append((tuple(paths), t, min(links, len(t)), tuple(doubts)))
            parts.clear()
            links = 0

    def close():
        nonlocal beside, in_link
        tag, bad, container, doubt = stack.pop()
        opened[tag] -= 1
        if tag in BLOCKS or bad or doubt:
            flush()
        beside -= bad
        if doubt:
            doubts.pop()
        in_link -= tag == "a"
        if container:
            paths.pop()

    def close_to(tags, stop) -> None:
        """Closes up to the innermost open element of ``tags``, unless one of ``stop`` is nearer."""
        if not any(map(opened.get, tags)):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    close()
                return
            if stack[k][0] in stop:
                return

    at, n, match = 0, len(page), _TAG.match
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at and not beside:
            text(page[at:lt])
        m = match(page, lt)
        if m is None:
            nxt = page[lt + 1:lt + 2]
            if nxt == "!" and page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if nxt and nxt in "!?":
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = _LOOSE.match(page, lt)
        if m is None:
            if nxt.isalpha() or nxt == "/" and page[lt + 2:lt + 3].isalpha():   # a tag cut off at the end
                break
            text("<")
            at = lt + 1
            continue
        at = m.end()
        slash, tag, attrs = m.groups()
        tag = tag.lower()
        if slash:
            if tag in BLOCKS or tag in BOILERPLATE_TAGS:
                close_to((tag,), () if tag in CONTAINERS or tag in BOILERPLATE_TAGS else CONTAINERS)
            else:
                close_to((tag,), BLOCKS)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            if end is None:
                break
            gt = page.find(">", end.start())
            at = n if gt < 0 else gt + 1
            continue
        if tag in _CLOSES_P:
            close_to(("p",), CONTAINERS | {"li", "table"})
        if tag == "li":
            close_to(("li",), ("ul", "ol"))
        elif tag in ("dt", "dd"):
            close_to(("dt", "dd"), ("dl",))
        elif tag in ("td", "th"):
            close_to(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            close_to(("tr",), ("table",))
        elif tag == "option":
            close_to(("option",), ("select",))
        in_article = bool(opened.get("article"))
        bad, doubt, classes = _boilerplate(tag, attrs if _TELLING.search(attrs) else "", in_article)
        doubt = doubt if not bad and not beside and len(doubts) < MAX_DEPTH else 0
        if tag in BLOCKS or bad or doubt:
            flush()
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        if attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        container = tag in CONTAINERS and len(paths) < MAX_DEPTH
        if container:
            paths.append((paths[-1] + ">" if paths else "") + (f"{tag}.{classes}" if classes else tag))
        stack.append((tag, bad, container, doubt))
        if doubt:
            doubts.append(len(kinds))
            kinds.append(doubt)
        opened[tag] = opened.get(tag, 0) + 1
        beside += bad
        in_link += tag == "a"
    while stack:
        close()
    flush()
    return _judged(out, kinds)


_BONUS = {"article": 1.6, "main": 1.3, "html": 0.2, "body": 0.4}


def scores(found: list[tuple[tuple[str, ...], str, int]]) -> dict[str, float]:
    """Score of each container path of a page."""
    out: dict[str, float] = {}
    for paths, t, links in found:
        w = (len(t) - links) * (1 - links / len(t))
        for p in reversed(paths):
            out[p] = out.get(p, 0.0) + w
            w *= FADE
    return {p: s * _BONUS.get(p.rsplit(">", 1)[-1].split(".")[0], 1.0) for p, s in out.items()}


def best_path(found, marks: dict[str, float] | None = None) -> tuple[str, float] | None:
    return min((scores(found) if marks is None else marks).items(), key=lambda x: (-x[1], x[0]), default=None)


def widened(path: str, found) -> str:
    """``path``, or the container around it that holds unlinked text of its own: upwards,
    containers that add nothing are passed, and the first that adds other text without
    having such text, as html and body, ends the way."""
    out, n = path, sum(path in paths for paths, _, _ in found)
    while ">" in path:
        path = path.rsplit(">", 1)[0]
        if path.rsplit(">", 1)[-1].split(".")[0] in ("html", "body"):
            break
        inside = [(paths[-1] == path and 2 * links < len(t)) for paths, t, links in found if path in paths]
        if len(inside) > n:
            if not any(inside):
                break
            out, n = path, len(inside)
    return out


def extract(page: str, winners: list[str]) -> str:
    """The text of the one of ``winners`` with the best score on the page, or of the page's
    best path where they have too little of its score, else of blocks without a container."""
    found = blocks(page)
    marks = scores(found)
    if not marks:
        return "\n".join(t for _, t, _ in found)
    best = best_path(found, marks)
    path = max((w for w in winners if w in marks), key=lambda w: marks[w], default=None)
    if path is None or marks[path] < LEAST * best[1]:
        path = best[0]
    path = widened(path, found)
    return "\n".join(t for paths, t, _ in found if path in paths)


def _named(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
                        ).withColumn("host", F.coalesce(host, F.lit("")))


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the winning paths of each host, by falling votes."""
    def run(batches):
        for b in chunks(batches):
            hosts, paths, marks = [], [], []
            for h, t in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                if (best := best_path(blocks(t))) is not None:
                    hosts.append(h)
                    paths.append(best[0])
                    marks.append(best[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(marks, pa.float64())],
                ["host", "path", "mark"])
    votes = (over_batches(_named(pages).where("host <> ''").select("host", "html"), run,
                          "host string, path string, mark double")
             .groupBy("host", "path").agg(F.count("*").alias("votes")))
    votes = written(votes, "host-votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    # at most 1 / share paths of a host pass, so the list is short
    return (votes.join(total, "host").where(F.col("votes") >= share * F.col("all"))
            .groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path")))
                                 .getField("path").alias("paths")))


def main_text(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``."""
    winners = written(host_paths(pages, share), "host-paths")
    size = winners.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 32)).first()[0] or 0
    side = F.broadcast(winners) if size <= BROADCAST_BYTES else winners

    def run(batches):
        for b in chunks(batches):
            got = [extract(t, p or []) for t, p in zip(b.column("html").to_pylist(), b.column("paths").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(got, pa.string()),
                 pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"])
    joined = _named(pages).join(side, "host", "left").select("page_id", "url", "html", "paths")
    return over_batches(joined, run, "page_id long, url string, text string, n_chars long")
