"""HTML extraction by consensus host paths.

A page is read into blocks (text between block-level tags) with the chain of containers around each. A
container's path is its chain of tags and classes with numbers generalised (`div.post-N`). Each page
scores its containers by the text of their blocks less that of links, the nearest container in full and
those above it in part, and casts one vote, of that score's share, for its best path. Votes are summed by
host in Spark; every page is then read again with its host's winning path. A page that lacks the path
uses its own best container.

What never counts, wherever it stands: the tags of `SKIPPED`, and elements whose class or id has a word
of `MARKED`. Fixed values, both; they name menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments. A word of `DOUBTFUL` names lists of links as often as main text
(`related-work`, `widget-content`), so its element goes only if half of its text or more is links; an inline one
goes from within its block.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.shared import keep

SKIPPED = frozenset("head title script style noscript template iframe object svg math canvas nav header footer aside form button select textarea input label dialog menu".split())
MARKED = frozenset("ad ads advert advertisement advertisements adverts banner promo sponsor sponsored cookie cookies consent gdpr notice alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar comment comments disqus replies footer header masthead login signup subscribe newsletter toolbar pagination".split())
DOUBTFUL = frozenset("related recommended share sharing social widget".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends an open paragraph or list item or cell of these.
CLOSES = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: What a block of text gives to the containers around it, nearest first.
SHARES = (1.0, 0.5, 0.25)
DEEPEST = 100
#: Rows (host and path, some 100 bytes) up to which the winners are broadcast; beyond, pages are shuffled by host.
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def marked(names: str, by: frozenset[str] = MARKED) -> bool:
    """Whether a class or id says that the element isn't main text; `no-sidebar` doesn't."""
    words = [w.lower() for w in _WORD.findall(names)]
    return any(w in by and (not k or words[k - 1] not in ("no", "has", "with", "without")) for k, w in enumerate(words))


class Block:
    __slots__ = ("chain", "doubts", "linked", "parts", "size")

    def __init__(self, chain: tuple[int, ...], doubts: tuple[int, ...]) -> None:
        self.chain, self.doubts, self.parts, self.linked, self.size = chain, doubts, [], 0, 0

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def blocks_of(page: str) -> tuple[list[Block], list[str]]:
    """The page's blocks that aren't skipped, in order, and the paths of its containers by number; number 0
    is the whole page. Containers more than DEEPEST deep count as the one around them."""
    blocks: list[Block] = []
    paths: list[str] = [""]
    around, opened = [0], Counter()
    doubts: list[int] = []  # doubtful elements around, by number, as deep as containers
    n_doubts = 0
    # tag, container or -1, skipped, doubtful block element, and where a doubtful inline one began: block, and its parts, linked letters and letters till then
    stack: list[tuple[str, int, bool, bool, tuple[Block | None, int, int, int] | None]] = []
    block: Block | None = None
    links = at = 0
    skipped = 0

    def say(text: str) -> None:
        nonlocal block
        if skipped or not text:
            return
        if block is None:
            if text.isspace():
                return
            block = Block(tuple(reversed(around)), tuple(doubts))
            blocks.append(block)
        block.parts.append(text)
        block.size += len(text)
        if links:
            block.linked += len(text)

    def leave(n: int) -> None:
        nonlocal skipped, links, block
        while len(stack) > n:
            tag, number, skips, doubtful, began = stack.pop()
            opened[tag] -= 1
            if number >= 0:
                around.pop()
            if doubtful:
                doubts.pop()
            if began and block is not None:
                _, n_parts, linked, size = began if began[0] is block else (block, 0, 0, 0)
                if 2 * (block.linked - linked) >= block.size - size:
                    del block.parts[n_parts:]
                    block.linked, block.size = linked, size
            skipped -= skips
            links -= tag == "a"
            if tag not in INLINE:
                block = None

    while found := _TOKEN.search(page, at):
        say(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:  # a comment or a declaration: nothing
            continue
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None) if opened[tag] else None
            if depth is not None and (tag not in INLINE or all(t in INLINE or t == tag for t, *_ in stack[depth:])):
                leave(depth)
            elif tag == "p":
                block = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            block = None
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] not in INLINE), None)
            if depth is not None and (stack[depth][0] == "p" or stack[depth][0] in CLOSES.get(tag, "").split()):
                leave(depth)
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        names = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(found[3] or "")}
        classes = names.get("class", "")
        called = "" if tag in ("html", "body", "main", "article") else f"{classes} {names.get('id', '')}"
        skips = tag in SKIPPED or marked(called)
        skipped += skips
        doubtful, began = not skips and len(doubts) <= DEEPEST and marked(called, DOUBTFUL), None
        if doubtful and tag in INLINE:
            doubtful, began = False, (block, len(block.parts), block.linked, block.size) if block else (None, 0, 0, 0)
        if doubtful:
            doubts.append(n_doubts)
            n_doubts += 1
        links += tag == "a"
        number = -1
        if tag not in INLINE and tag not in ("p", "html", "h1", "h2", "h3", "h4", "h5", "h6") and len(around) <= DEEPEST:
            number = len(paths)
            label = ".".join([tag, *sorted(re.sub(r"\d+", "N", classes).split())])
            paths.append(f"{paths[around[-1]]}>{label}")
            around.append(number)
        stack.append((tag, number, bool(skips), doubtful, began))
        opened[tag] += 1
    say(page[at:])
    return without_link_lists(blocks), paths


def without_link_lists(blocks: list[Block]) -> list[Block]:
    """The blocks, without those in a doubtful element of which half the text or more is links."""
    sizes, linked = Counter(), Counter()
    for b in blocks:
        for d in b.doubts:
            sizes[d] += b.size
            linked[d] += b.linked
    lists = {d for d, n in sizes.items() if 2 * linked[d] >= n}
    return [b for b in blocks if lists.isdisjoint(b.doubts)] if lists else blocks


def best_path(blocks: list[Block], paths: list[str]) -> tuple[str | None, float]:
    """The path of the best container, and its share of all containers' scores. An article or main element
    around the best one is taken instead of it. Ties: the first in the page."""
    scores: dict[int, float] = {}
    for b in blocks:
        value = max(0, b.size - 2 * b.linked)
        for share, c in zip(SHARES, b.chain, strict=False):
            scores[c] = scores.get(c, 0.0) + share * value
    total = sum(scores.values())
    if not total:
        return None, 0.0
    best = max(scores, key=lambda c: (scores[c], -c))
    chain = next(b.chain for b in blocks if best in b.chain)
    whole = [c for c in chain[chain.index(best) :] if paths[c].rpartition(">")[2].split(".")[0] in ("article", "main")]
    return paths[whole[0] if whole else best], scores[best] / total


def main_text(page: str | None, path: str | None = None) -> str:
    """The main text with a given path, or, if the page lacks it, with its own best."""
    blocks, paths = blocks_of(page or "")
    if path is None or path not in paths:
        path, _ = best_path(blocks, paths)
    if path is None:
        return ""
    inside = {c for c, p in enumerate(paths) if p == path}
    texts = [b.text() for b in blocks if not inside.isdisjoint(b.chain)]
    return "\n\n".join(t for t in texts if t)


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cast = [(host, *best_path(*blocks_of(page or ""))) for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        cast = [v for v in cast if v[1]]
        yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in cast], pa.string()), pa.array([v[1] for v in cast], pa.string()), pa.array([v[2] for v in cast], pa.float64())], ["host", "path", "vote"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page, path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["key", "url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every row of pages, from its whole html.

    A null or empty page, and one without text outside what is skipped, has an empty text. Pages whose
    url is null or has no host vote together as one host. Repeated rows vote each, and null keys come
    back as they are; of a host's paths with equal votes the smallest wins. Other columns are not read.
    An empty table gives an empty one. Very long pages need memory in proportion to the one page. A hot host's votes are summed before the shuffle; pages are
    shuffled only where hosts are too many to broadcast.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    after = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.coalesce(F.lower(F.regexp_extract(after, "^[^/?#]*", 0)), F.lit(""))
    kind = rows.schema["key"].dataType.simpleString()
    # whole numbers, so that sums don't depend on their order
    votes = rows.select(host.alias("host"), "html").mapInArrow(_votes, "host string, path string, vote double").withColumn("vote", F.round(F.col("vote") * 1_000_000).cast("long"))
    sums = votes.groupBy("host", "path").agg(F.sum("vote").alias("votes"))
    first = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    winners = keep(sums.withColumn("n", F.row_number().over(first)).where("n = 1").select("host", "path"), "winners")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    at = rows.withColumn("host", host).join(winners, "host", "left")
    out = at.select("key", "url", "html", "path").mapInArrow(_texts, f"key {kind}, url string, text string, n_chars bigint")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", "n_chars")
