"""Main text of web pages, by container paths on which the pages of a host agree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fits, map_batches, stored

#: What stands in these up to their end tag is not markup, and not text of the page either.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset("body div section article main aside nav header footer form table tbody thead tfoot tr td th ul ol dl figure details dialog fieldset menu blockquote center".split())
_BREAKS = _CONTAINERS | frozenset("html head p h1 h2 h3 h4 h5 h6 li dt dd pre hr address figcaption summary caption legend option optgroup search".split())
#: Elements that are not main text wherever they stand.
_NEVER = frozenset("head nav aside footer form button menu dialog fieldset noscript template svg math object canvas select audio video map label datalist".split())
#: Words of class, id and role names that mark what is not main text, and those that mark what is.
_UNWANTED = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr header masthead menu modal nav navbar
navigation newsletter notice notices pagination popup promo promoted promotion related respond replies reply share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget widgets""".split())
_WANTED = frozenset("article body content entry main post story text".split())
#: A start tag of the key ends open elements of the first set, looked for up to one of the second.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "tr": (frozenset(["tr"]), frozenset(["table"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: By how much a container counts less for each unwanted element that it is or stands in: by weak name, by name, by tag.
_WEIGHTS = (1.0, 0.4, 0.1, 0.05)
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_TAG_END = re.compile(r"[\s/]*>")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Longer runs of equal steps count as one step of a path.
_RUN = 8


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None, bool]]:
    """(kind, text or tag, attributes, whether it ends itself) of a page, kind being `text`, `start` or `end`.

    The states are: text, start tag with its attributes, end tag, comment, declaration and raw text. What opens no tag
    is text; a comment, a raw element or a tag that is not closed reaches to the end.
    """
    at, size, lower = 0, len(page), None
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            yield "text", page[at:], None, False
            return
        after = page[mark + 1 : mark + 2]
        ending = after == "/" and page[mark + 2 : mark + 3].isascii() and page[mark + 2 : mark + 3].isalpha()
        if not ending and after not in ("!", "?", "/") and not (after.isascii() and after.isalpha()):
            yield "text", page[at : mark + 1], None, False
            at = mark + 1
            continue
        if mark > at:
            yield "text", page[at:mark], None, False
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 2)  # <!--> is a whole comment
            at = size if end < 0 else end + 3
        elif after in ("!", "?") or after == "/" and not ending:
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
        elif ending:
            name = _NAME.match(page, mark + 2)
            end = page.find(">", name.end())
            at = size if end < 0 else end + 1
            yield "end", name[0].lower(), None, False
        else:
            name = _NAME.match(page, mark + 1)
            tag, at, found = name[0].lower(), name.end(), {}
            while True:
                end = _TAG_END.match(page, at)
                if end:
                    at = end.end()
                    break
                m = _ATTRIBUTE.match(page, at)
                if not m or m.end() == at:
                    at = size
                    break
                at = m.end()
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            yield "start", tag, found, page[at - 2 : at] == "/>"
            if tag in _RAW:
                if lower is None:
                    lower = page.lower()
                    if len(lower) != size:  # a letter whose small form is longer: places must agree
                        lower = "".join(c.lower() if c.isascii() else c for c in page)
                close = lower.find(f"</{tag}", at)
                while close >= 0 and lower[close + len(tag) + 2 : close + len(tag) + 3] not in ("", ">", "/", " ", "\t", "\n", "\r", "\f"):
                    close = lower.find(f"</{tag}", close + 1)
                at = size if close < 0 else close


class Node:
    """An open element: how much it is unwanted (0 to 3), how much it and what it stands in count, and its path."""

    __slots__ = ("parent", "tag", "bad", "weight", "path", "run", "inside")

    def __init__(self, parent: Node | None, tag: str, first: str, bad: int):
        self.parent, self.tag, self.bad = parent, tag, bad
        self.weight = (parent.weight if parent else 1.0) * _WEIGHTS[bad]
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.path, self.run = None, 0
        if tag in _CONTAINERS:
            step = "/" + tag + ("." + _DIGITS.sub("#", first) if first else "")
            outer = parent
            while outer and outer.path is None:
                outer = outer.parent
            before = outer.path if outer else ""
            self.run = outer.run + 1 if outer and before.endswith(step) else 1
            self.path = before if self.run > _RUN else before + step


def unwanted(names: list[str], inside: bool) -> int:
    """0 to 2: how much class, id and role names say that an element is not main text.

    The last word of a name tells what the element is, so names that end in an unwanted word count fully and names that
    only hold one count half; a name that ends in a wanted word speaks against both. A header inside an article, or one
    named after what it heads, is wanted.
    """
    bad, good = 0, False
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if not words:
            continue
        here = [w for w in words if w in _UNWANTED and not (w == "header" and (inside or not _WANTED.isdisjoint(words)))]
        if here:
            bad = max(bad, 2 if words[-1] in here else 1)
        elif words[-1] in _WANTED:
            good = True
    return max(0, bad - good)


def _opened(parent: Node, tag: str, attributes: dict[str, str]) -> Node:
    bad, first = 3 if tag in _NEVER or tag == "header" and not parent.inside else 0, ""
    if attributes:
        cls = attributes.get("class", "").split()
        first = cls[0] if cls else ""
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
            bad = 3
        if not bad and tag not in ("html", "body", "article", "main"):
            bad = unwanted([*cls, *attributes.get("id", "").split(), *attributes.get("role", "").split()], parent.inside)
            if bad == 1 and tag not in _BREAKS:
                bad = 0  # inside a line only names that end in an unwanted word count
    return Node(parent, tag, first, bad)


@dataclass
class Block:
    """A run of text between block tags: its text, the innermost element around it and how much of it is in links."""

    text: str
    node: Node
    linked: int


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in page order, those of unwanted elements too.

    A block ends at any block-level tag, and at either end of an unwanted element's text. Unclosed tags are closed by
    the end of an outer container, or by the next element that can't stand in them; an end tag that matches nothing is
    passed over.
    """
    out: list[Block] = []
    root = Node(None, "html", "", 0)
    stack = [root]
    pieces: list[tuple[str, Node, bool]] = []

    def flush() -> None:
        if not pieces:
            return
        # Unwanted elements inside a line leave the line around them whole.
        runs: dict[int, list[tuple[str, Node, bool]]] = {}
        for piece in pieces:
            node = piece[1]
            while node.parent and not node.bad and node.tag not in _BREAKS:
                node = node.parent
            runs.setdefault(id(node) if node.bad and node.tag not in _BREAKS else 0, []).append(piece)
        for run in runs.values():
            text = _SPACE.sub(" ", entities.unescape("".join(p[0] for p in run))).strip()
            if text:
                out.append(Block(text, run[0][1], min(sum(len(p[0].strip()) for p in run if p[2]), len(text))))
        pieces.clear()

    def cut(depth: int) -> None:
        nonlocal links
        for node in stack[depth:]:
            links -= node.tag == "a"
        del stack[depth:]

    links = 0
    for kind, tag, attributes, self_ending in tokens(page or ""):
        if kind == "text":
            pieces.append((tag, stack[-1], links > 0))
        elif kind == "start":
            if tag == "br":
                pieces.append((" ", stack[-1], False))
            if tag in _BREAKS:
                flush()
                depth = len(stack) - 1  # a paragraph ends where another block begins
                while depth > 0 and stack[depth].tag not in _CONTAINERS and stack[depth].tag not in ("p", "li", "dt", "dd"):
                    depth -= 1
                if stack[depth].tag == "p":
                    cut(depth)
                ends, limit = _ENDS.get(tag, ((), ()))
                if ends:
                    depth = len(stack) - 1
                    while depth > 0 and stack[depth].tag not in limit and stack[depth].tag not in ends:
                        depth -= 1
                    if stack[depth].tag in ends:
                        cut(depth)
            if tag not in _VOID and not (self_ending and tag in ("svg", "math")) and tag != "html":
                if tag == "a" and links:
                    depth = max(i for i, node in enumerate(stack) if node.tag == "a")
                    if not any(node.tag in _CONTAINERS for node in stack[depth:]):
                        cut(depth)
                stack.append(_opened(stack[-1], tag, attributes))
                links += tag == "a"
        else:
            if tag in _BREAKS:
                flush()
            depth = len(stack) - 1
            while depth > 0 and stack[depth].tag != tag and (tag in _CONTAINERS or stack[depth].tag not in _CONTAINERS):
                depth -= 1
            if depth > 0 and stack[depth].tag == tag:
                cut(depth)
    flush()
    return out


def container_scores(found: list[Block]) -> dict[str, float]:
    """A score for each generalised container path.

    A block counts with its unlinked text for the container around it, and less for the ones around that, but for none
    beyond an unwanted element. What an unwanted element holds counts less, but it counts: its name is not final.
    """
    scores: dict[str, float] = {}
    weights: dict[str, float] = {}
    for b in found:
        worth = (len(b.text) - 2 * b.linked) * (1.0 if len(b.text) >= 80 or b.text[-1:] in ".!?" else 0.5)
        node, share = b.node, 1.0
        while node and share > 0.1:
            if node.path is not None:
                scores[node.path] = scores.get(node.path, 0.0) + worth * share
                weights[node.path] = max(weights.get(node.path, 0.0), node.weight)
                share *= 0.5
            if node.bad:
                break
            node = node.parent
    for path in scores:
        tag = path.rpartition("/")[2].partition(".")[0]
        scores[path] *= weights[path] * (2.0 if tag in ("article", "main") else 0.6 if tag == "body" else 1.0)
    return scores


def _best(found: list[Block]) -> str | None:
    """The path of the best container, or of the one around it if that adds but a headline or a few paragraphs.

    It is taken instead while its own text is at most three tenths of the other's and hardly in links; body, and what
    has tables or lists as parts, only if all it adds are headlines.
    """
    scores = container_scores(found)
    best, top = max(scores.items(), key=lambda x: (x[1], x[0]), default=(None, 0.0))
    if best is None or top <= 0:
        return None
    outer = best.rpartition("/")[0]
    while outer and not re.match(r"(article|main)(\.|$)", best.rpartition("/")[2]):
        inner, around = within(found, best), within(found, outer)
        own = {id(b) for b in inner}
        more = [b for b in around if id(b) not in own]
        if not more or sum(len(b.text) for b in more) > 0.3 * sum(len(b.text) for b in inner) or 3 * sum(b.linked for b in more) > sum(len(b.text) for b in more):
            break
        if any(b.node.weight < 0.5 for b in more) or outer.rpartition("/")[2].startswith("body") and any(_line(b.node) not in ("h1", "h2", "h3") for b in more):
            break
        best, outer = outer, outer.rpartition("/")[0]
    return best


def _line(node: Node | None) -> str:
    """The tag of the block-level element around a block."""
    while node and node.tag not in _BREAKS:
        node = node.parent
    return node.tag if node else ""


def within(found: list[Block], path: str) -> list[Block]:
    """The blocks in containers of that path, without those of unwanted elements further in."""
    out = []
    for b in found:
        node, bad = b.node, False
        while node:
            if node.path == path and (not node.parent or node.parent.path != path):
                if not bad:
                    out.append(b)
                break
            if node.path != path:
                bad = bad or node.bad > 0
            node = node.parent
    return out


def best_path(page: str | None) -> str | None:
    return _best(blocks(page))


def main_text(page: str | None, winners: list[str] | None) -> str:
    """The blocks in the first winning path that the page has, or else in the page's own best container.

    A path counts as had if it holds a tenth of what the page's own best container does. If there is no container with
    more text than links, all text outside unwanted elements is taken.
    """
    found = blocks(page)
    best = _best(found)
    if best is None:
        return "\n".join(b.text for b in found if b.node.weight == 1)
    own = within(found, best)
    size = sum(len(b.text) - b.linked for b in own)
    for path in winners or ():
        if path == best:
            break
        there = within(found, path)
        if there and 10 * sum(len(b.text) - b.linked for b in there) >= size:
            own = there
            break
    return "\n".join(b.text for b in own)


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str, share: float = 0.05) -> DataFrame:
    """Extract every page's main text: id column, url column, text string, n_chars long.

    First each page scores its containers and votes for the generalised path (tags with their first class, digits as #)
    of the best. Spark counts votes by host; paths with at least `share` of a host's votes win, most votes first (ties:
    the path that sorts first), and pages are extracted again by the winning paths. A page that has none of them uses
    its own best container. Null or empty html gives empty text; pages with a null url, or one without a host, form one
    host; repeated rows give repeated results; an empty table gives none; other columns are not read.

    Votes are added up before they are shuffled, so a host may have most of the pages. The winning paths, at most
    1 / `share` a host, are broadcast if they are measured to fit; else those of hosts with more than a thousandth of
    the votes are broadcast, which are fewer than a thousand, and the others joined by host.
    """
    kind, url_kind = (pages.select(c).schema[0].dataType.simpleString() for c in (id_col, url_col))
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        votes = [(h, p) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (p := best_path(page)) is not None]
        return pa.RecordBatch.from_pydict({"host": [v[0] for v in votes], "path": [v[1] for v in votes]}) if votes else None

    votes = stored(map_batches(rows.select("host", "html"), vote, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n")), "votes")
    of_host = Window.partitionBy("host")
    rank = votes.withColumns({"cast": F.sum("n").over(of_host), "top": F.max("n").over(of_host)}).where(F.col("n") >= F.least(F.col("cast") * share, F.col("top")))
    won = rank.groupBy("host").agg(F.max("cast").alias("cast"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))), lambda x: x["path"]).alias("paths"))
    won = stored(won, "won")
    totals = won.agg(F.sum(F.length("host") + F.length(F.concat_ws("", "paths")) + 64), F.sum("cast")).first()
    if fits(totals[0] or 0):
        joined = rows.join(F.broadcast(won), "host", "left")
    else:
        heavy = won.where(F.col("cast") * 1000 > totals[1])
        joined = rows.join(F.broadcast(heavy), "host").unionByName(rows.join(F.broadcast(heavy.select("host")), "host", "left_anti").join(won.hint("merge"), "host", "left"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, paths) for page, paths in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    return map_batches(joined.select("id", "url", "html", "paths"), run, f"id {kind}, url {url_kind}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
