"""Main text of web pages by tag-path ratios.

Each page is cut into text nodes with their root-to-leaf tag paths. For every path text length, punctuation
and nodes are summed; length and punctuation per node are smoothed over the page's node order and fused to a
score of the path, the mean over its nodes. Paths that lie in an element which by tag, class, id or role is a
menu, header, footer, sidebar, notice, advert, form or reader comment are paths of their own, whose score is
lowered; a class, id or role on what wraps the page's text ("has-sidebar") is no such sign. Paths with a score
of at least THRESHOLD of the page's best are content. Between them, small gaps of unmarked blocks are content
too, and inside an element that holds content (each article, else main, else the one that holds nearly all of
it) unmarked paths that come near by their own unsmoothed ratio. Only what is never shown (scripts, styles,
hidden elements) takes no part.

Pages are independent rows: Spark deals them out, and a task holds one batch at a time.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from restwave.llm.common import row_struct, ship_package, with_outputs

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<(/?)([a-zA-Z][^\s/<>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?|</[^>a-zA-Z][^>]*>?"
                    r"|<(/?)([a-zA-Z][^\s/<>\x00]*)([^<>\"']*[\"'][^<>]*)(?:>|(?=<)|\Z)", re.S)  # the last: a quote that never closes ends with the tag
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_UNSEEN = _RAW | {"head", "svg", "math", "object", "canvas", "audio", "video", "map", "applet", "select", "option", "dialog"}
_MARKED = {"nav", "header", "footer", "aside", "button", "label", "fieldset", "menu"}
_BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "aside", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "hgroup", "search", "dialog", "menu"}
_INLINE_OUT = {"a", "abbr", "b", "big", "cite", "code", "em", "font", "i", "mark", "q", "s", "small", "span", "strike", "strong", "sub", "sup", "tt", "u", "ins", "del", "kbd", "samp", "var", "time"}
#: Words of class, id and role that name what is no content.
_HINTS = {"nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "advertising",
          "adsense", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
          "comment", "comments", "disqus", "respond", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "contentinfo",
          "complementary", "search", "alert", "alertdialog", "dialog", "form", "copyright", "skip", "toc"}
_REPLIES = {"comment", "comments", "disqus", "respond", "replies"}
HINT, REPLIES, MARK, SURE = 1, 2, 3, 4
_CONTAINER = {"div", "section", "article", "main", "body", "html", "td", "center", "blockquote", "details"}
_TOP = {"html", "body", "main"}
_PUNCT = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
_SPLIT = re.compile(r"[^a-z]+")
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_SCOPE = {"table", "td", "th", "caption", "button", "object", "html", "body"}
#: Parts of the best path's score: of content, of what comes near inside its container; and what is left of a marked path's score.
THRESHOLD, NEAR, LOWERED = 0.04, 0.003, 0.001
#: Blocks between two blocks of text that are text too.
GAP = 2
KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)


def _noise(tag: str, attributes: str) -> int:
    """SURE of what is never shown, MARK of tags that name no content, or what class, id and role hint: HINT,
    REPLIES (comments on the article) or 0."""
    if tag in _UNSEEN:
        return SURE
    mark = MARK if tag in _MARKED else HINT if tag == "form" else 0  # a form may wrap the page
    if not attributes or tag in _TOP or attributes.isspace():
        return mark
    kind = mark
    for name, *values in _ATTR.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
        if name in ("class", "id", "role"):
            for one in value.split():
                words = set(_SPLIT.split(re.sub(r"(comment|side|nav|foot|head)(s|bar|er)?(list|section|area|box|wrap|wrapper)$", r"\1\2", one)))
                hit = words & _HINTS
                if tag == "article":
                    hit &= {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"}
                if hit or ("header" in words or one == "banner" or "banner" in words) and not words & {"article", "post", "entry", "content", "story"}:
                    kind = max(kind, REPLIES if hit & _REPLIES else HINT)
    return kind


def _hinted_noise(nodes: list[tuple[int, str, int, str]], parents: list[int], tags: list[str], hints: dict[int, int]) -> set[int]:
    """Elements that lie in a hinted one, but for hints on what wraps the page's text.

    That is an element with most of the text in <article> and <main>, and more of it than there is text without
    any hint (of comments: four times as much); in pages without such text, one with most of all text.
    """
    n = len(parents)
    size, article, plain = [0] * n, [0] * n, 0
    within, hinted = [False] * n, [False] * n  # in <article> or <main> with no hint below it; in a hinted element
    for e in range(1, n):
        within[e] = e not in hints and (tags[e] in ("article", "main") or within[parents[e]])
        hinted[e] = e in hints or hinted[parents[e]]
    for e, _, _, raw in nodes:
        length = len(raw.strip())
        size[e] += length
        article[e] += length * within[e]
        plain += length * (not hinted[e])
    for e in range(n - 1, 0, -1):
        size[parents[e]] += size[e]
        article[parents[e]] += article[e]

    def wraps(e: int) -> bool:
        if article[0]:
            return 2 * article[e] > article[0] and article[e] > plain * (4 if hints[e] == REPLIES else 1)
        return hints[e] != REPLIES and 2 * size[e] > size[0]

    out: set[int] = set()
    for e in range(1, n):
        if parents[e] in out or e in hints and not wraps(e):
            out.add(e)
    return out


def text_nodes(page: str) -> tuple[list[tuple[int, int, int, str, bool]], list[int], list[str]]:
    """(element, tag path, block, raw text, marked) of every text node that is shown; parent and tag of each element.

    Tag paths are numbers: those of a tree of (path above, tag). A marked node lies in an element that names no content.
    """
    nodes: list[tuple[int, int, int, str]] = []
    parents, tags, stack = [-1], [""], [(0, "", 0, 0)]  # stack: element, tag, path, kind
    paths: dict[tuple[int, str], int] = {}
    hints: dict[int, int] = {}
    marks: set[int] = set()
    opened: dict[str, int] = defaultdict(int)
    block, at, n = 0, 0, len(page)

    def close(until: int) -> None:
        for x in stack[until:]:
            opened[x[1]] -= 1
        del stack[until:]

    while at < n:
        match = _TOKEN.search(page, at)
        end = match.start() if match else n
        if end > at and stack[-1][3] != SURE:
            nodes.append((stack[-1][0], stack[-1][2], block, page[at:end]))
        if not match:
            break
        at = match.end()
        ending, tag, attributes = (match[i] or match[i + 3] or "" for i in (1, 2, 3))
        tag = tag.lower()
        if not tag:
            continue
        if ending:
            if tag == "p" and not opened["p"]:
                block += 1
                continue
            block += tag in _BLOCK
            for i in range(len(stack) - 1 if opened[tag] else 0, 0, -1):
                if stack[i][1] == tag:
                    close(i)
                    break
                if tag in _INLINE_OUT and stack[i][1] in _BLOCK:
                    break
            continue
        if tag in _BLOCK:
            block += 1
            for i in range(len(stack) - 1 if opened["p"] else 0, 0, -1):  # a block ends an open paragraph
                if stack[i][1] == "p":
                    close(i)
                    break
                if stack[i][1] in _SCOPE:
                    break
        if tag in _CLOSES:
            ended, limits = _CLOSES[tag]
            for i in range(len(stack) - 1 if any(opened[x] for x in ended) else 0, 0, -1):
                if stack[i][1] in limits:
                    break
                if stack[i][1] in ended:
                    close(i)
                    if tag != "tr" or stack[-1][1] not in ended:
                        break
        if tag in _VOID:
            if tag == "br" and stack[-1][3] != SURE:
                nodes.append((stack[-1][0], stack[-1][2], block, " "))
            continue
        if tag in ("body", "html") and opened[tag]:
            continue
        if tag == "body" and stack[-1][1] == "head":
            close(len(stack) - 1)
        kind = _noise(tag, attributes)
        if tag in _RAW:
            done = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = done.end() if done else n
            continue
        parents.append(stack[-1][0])
        tags.append(tag)
        if kind in (HINT, REPLIES):
            hints[len(parents) - 1] = kind
        elif kind == MARK:
            marks.add(len(parents) - 1)
        path = stack[-1][2] if tag in _INLINE_OUT else paths.setdefault((stack[-1][2], tag), len(paths) + 1)
        opened[tag] += 1
        stack.append((len(parents) - 1, tag, path, max(stack[-1][3], kind)))
    for e in range(1, len(parents)):  # parents come first
        if parents[e] in marks:
            marks.add(e)
    if hints:
        marks |= _hinted_noise([x for x in nodes if x[0] not in marks], parents, tags, hints)
    return [(*x, x[0] in marks) for x in nodes], parents, tags


def path_scores(nodes: list[tuple[tuple[int, bool], str]]) -> tuple[dict, dict]:
    """Of nodes (path with its mark, text) in page order: the score of each path, and the fused ratio of the path by itself.

    A path's ratios are its characters and its punctuation marks for each node. Both are smoothed over the nodes,
    length times one plus punctuation is a node's fused value, and a path's score the mean over its nodes; a
    marked path keeps LOWERED of it.
    """
    sums: dict = defaultdict(lambda: [0.0, 0.0, 0.0])
    for path, text in nodes:
        s = sums[path]
        s[0] += len(text.strip())
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
    own = {p: (s[0] / s[2]) * (1 + s[1] / s[2]) * (LOWERED if p[1] else 1) for p, s in sums.items()}
    ratio = np.array([[sums[p][0] / sums[p][2], sums[p][1] / sums[p][2]] for p, _ in nodes])
    kernel = KERNEL / KERNEL.sum()
    padded = np.pad(ratio, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(kernel[j] * padded[j:j + len(ratio)] for j in range(5))
    score: dict = defaultdict(float)
    for (path, _), x in zip(nodes, (smooth[:, 0] * (1 + smooth[:, 1])).tolist()):
        score[path] += x / sums[path][2] * (LOWERED if path[1] else 1)
    return dict(score), own


def main_text(page: str | None, threshold: float = THRESHOLD, near: float = NEAR) -> str:
    """Blocks of text, in page order, joined by two line feeds; empty if there are none."""
    if not page:
        return ""
    nodes, parents, tags = text_nodes(page)
    kept = [(e, (path, marked), block, html.unescape(raw)) for e, path, block, raw, marked in nodes]
    full = [x for x in kept if not x[3].isspace()]
    if not full:
        return ""
    score, own = path_scores([(path, text) for _, path, _, text in full])
    best = max(score.values())
    chosen = {p for p, x in score.items() if x >= threshold * best}
    if all(p[1] for p in chosen):  # nothing but menus, notices and the like
        return ""
    # how much of the chosen text each element holds
    weight: dict[int, int] = defaultdict(int)
    for e, path, _, text in full:
        if path in chosen:
            weight[e] += len(text.strip())
    for e in range(len(parents) - 1, 0, -1):
        if e in weight:
            weight[parents[e]] += weight[e]
    inside = _containers(weight, weight[0], parents, tags)
    for e in range(1, len(parents)):
        if parents[e] in inside:
            inside.add(e)
    # blocks in order, and which of them are text
    blocks: dict[int, list[str]] = defaultdict(list)
    taken: dict[int, bool] = {}
    marked: set[int] = set()
    ratio: dict[int, float] = defaultdict(float)  # the best own ratio in a block
    for e, path, block, text in kept:
        if path[1] and path not in chosen:
            if not text.isspace():
                marked.add(block)
                taken.setdefault(block, False)
            continue
        blocks[block].append(text)
        if not text.isspace():
            ratio[block] = max(ratio[block], own[path])
            taken[block] = taken.get(block, False) or path in chosen or e in inside and own[path] >= near * best
    last = None
    for at, block in enumerate(order := list(taken)):
        if taken[block]:
            if last is not None and at - last <= GAP + 1 and not marked.intersection(order[last:at]):
                taken.update((b, True) for b in order[last:at] if ratio[b] >= near * best)
            last = at
    joined = (" ".join("".join(parts).split()) for block, parts in blocks.items() if taken.get(block))
    return "\n\n".join(x for x in joined if x)


def _containers(weight: dict[int, int], total: int, parents: list[int], tags: list[str]) -> set[int]:
    """Elements within which paths that come near are text: each <article> with chosen text, else each <main>,
    else the deepest container that holds nearly all chosen text."""
    for name in ("article", "main"):
        if marked := {e for e in weight if tags[e] == name}:
            return marked
    root = max((e for e, w in weight.items() if 20 * w >= 19 * total), default=0)
    while root and tags[root] not in _CONTAINER:
        root = parents[root]
    return {root}


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of pages (all, if None) and text, n_chars (code points) for every page.

    Null or empty html, and pages without content: empty text, 0. Broken markup is read as far as it goes; a quote
    that never closes ends with its tag, at the next > or <.
    Repeated rows count one by one; an empty table gives an empty result. Input columns named text or n_chars
    give way to the outputs.
    """
    ship_package(pages.sparkSession)
    own = row_struct(pages, keep)
    source = pages.select(own.alias("row"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["row", "text", "n_chars"])

    schema = T.StructType([T.StructField("row", source.schema["row"].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return with_outputs(source.mapInArrow(run, schema), "row", ["text", "n_chars"])
