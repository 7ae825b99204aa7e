"""Main text of web pages by the paths that a host's pages agree on.

Each page's containers are scored by their texts and the best one's generalised path (tags and
classes, digits made alike) is the page's vote. Spark counts votes by host and path and keeps a host's
winning paths; a second pass cuts each page's text out of the containers with the first winning path
that has any, or out of the page's own best container.
"""

from __future__ import annotations

import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import free_name, slices, stored

#: A winning path has at least one of so many votes of its host, so that a host has no more winners.
SHARE = 20
#: Characters that a block must have before its text counts for its container, and what its tag adds.
SHORT, ARTICLE, BODY_CLASS = 20, 100, 50

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp svg math select".split())
HEAD = frozenset("html head meta link title script style base noscript template".split())
CONTAINERS = frozenset("html body main article section div td center header footer nav aside form dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = CONTAINERS | HEADINGS | VOID & {"hr"} | frozenset(
    "address blockquote caption dd details dir dl dt fieldset figcaption figure hgroup legend li menu ol optgroup option p pre search summary "
    "table tbody tfoot th thead tr ul".split()
)
#: What a start tag ends, if it is open inside the innermost of the second set.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "a": ({"a"}, CONTAINERS),
}
#: Elements, roles and words of class names or ids whose content is no part of an article.
DROPPED = frozenset("nav footer aside form button noscript template dialog menu search head object applet audio video canvas".split())
DROPPED_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar "
    "footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond "
    "disqus related recommended share sharing social widget toolbar pagination pager".split()
)
#: Headers are dropped too, but for headings inside an article.
HEADER_WORDS = frozenset(["header", "masthead"])
ARTICLE_WORDS = frozenset("article post entry story content main body text".split())
#: Names with one of these words tell of a layout, not of what an element holds.
LAYOUT_WORDS = frozenset("has with no without layout".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile("class|id|role|hidden|style|itemprop", re.I).search
_WORDS = re.compile("[A-Z]*[a-z]+|[A-Z]+").findall
_DIGITS = re.compile("[0-9]+")


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?![a-z0-9-])", re.I)


@functools.lru_cache(1 << 16)
def _key(parent: int, label: str) -> int:
    """A path's key: a digest of its parent's key and its last label."""
    return int.from_bytes(hashlib.blake2b(parent.to_bytes(8, "little", signed=True) + label.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(1 << 14)
def _traits(tag: str, attributes: str) -> tuple[str, int, int]:
    """An element's label in paths, how it is dropped (1: but for headings, 2: whole), what it adds to its score."""
    drop, bonus, classes = (2 if tag in DROPPED else tag == "header"), (ARTICLE if tag in ("article", "main") else 0), []
    held = {n.lower(): a or b or c for n, a, b, c in reversed(_ATTRIBUTE.findall(attributes))} if _TELLING(attributes) else {}
    if held:
        classes = held.get("class", "").split()
        names = [set(map(str.lower, _WORDS(x))) for x in (*classes, held.get("id", ""))]
        words = set().union(*(x for x in names if not x & LAYOUT_WORDS))
        role = held.get("role", "").lower()
        if tag not in ("html", "body", "main", "article") or words & {"comment", "comments", "reply"}:
            if words & DROPPED_WORDS or role in DROPPED_ROLES:
                drop = 2
            elif words & HEADER_WORDS or role == "banner":
                drop = drop or 1
        if "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower():
            drop = 2
        if role in ("main", "article") or held.get("itemprop", "").lower() == "articlebody":
            bonus = ARTICLE
        elif words & ARTICLE_WORDS:
            bonus = max(bonus, BODY_CLASS)
    if tag in ("html", "body"):
        return tag, int(drop), 0
    return ".".join([tag, *sorted({_DIGITS.sub("#", x.lower()) for x in classes})]), int(drop), bonus


class Page:
    """A page's containers, in page order, and its blocks of text with the containers that hold them."""

    def __init__(self, source: str) -> None:
        # of each container, the document itself being the first: its parent, path's key, label, bonus
        self.parents, self.keys, self.labels, self.bonus = [0], [0], [""], [0]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, value for its container's score
        self._parse(source)

    def _parse(self, source: str) -> None:
        # open elements: name, container, how dropped, inside a link, inside an article, heading
        stack = [("", 0, 0, False, False, False)]
        opened: Counter = Counter()
        pieces: list[str] = []
        linked = at = 0
        search, length, unescape = _TAG.search, len(source), html.unescape

        def end_block() -> None:
            nonlocal linked
            if pieces:
                text = " ".join("".join(pieces).split())
                if text:
                    top = stack[-1]
                    self.blocks.append((top[1], text, len(text) - (0 if top[5] else SHORT) - 2 * linked))
                pieces.clear()
                linked = 0

        def close(depth: int) -> None:
            for x in stack[depth:]:
                opened[x[0]] -= 1
                if x[0] in BLOCKS:
                    end_block()  # while the block's own element is still the innermost
            del stack[depth:]

        def find(names: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> int:
            if any(opened[x] > 0 for x in names):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in names:
                        return depth
                    if stack[depth][0] in within:
                        break
            return 0

        def add(text: str) -> None:
            nonlocal linked
            _, _, drop, link, article, heading = stack[-1]
            if drop == 0 or drop == 1 and heading and article:
                text = unescape(text) if "&" in text else text
                pieces.append(text)
                if link:
                    linked += len(text)

        while match := search(source, at):
            if match.start() > at:
                add(source[at : match.start()])
            at = match.end()
            tag = match[2]
            if tag is None:
                continue
            tag = tag.lower()
            if match[1]:
                if tag == "br":
                    add(" ")
                elif opened[tag] > 0 and (depth := find({tag}, frozenset() if tag in BLOCKS else CONTAINERS)):
                    close(depth)
                elif tag in BLOCKS:
                    end_block()
                continue
            if tag == "br":
                add(" ")
                continue
            if opened["head"] > 0 and tag not in HEAD:
                close(find({"head"}, frozenset()))
            if tag in BLOCKS:
                if opened["p"] > 0 and (depth := find({"p"}, CONTAINERS)):
                    close(depth)
                end_block()
            if tag in RAW:
                end = _raw_end(tag).search(source, at)
                at = end.start() if end else length
                continue
            if tag in ENDS and (depth := find(*ENDS[tag])):
                close(depth)
            if tag in VOID:
                continue
            _, container, drop, link, article, heading = stack[-1]
            label, dropped, bonus = _traits(tag, match[3] if tag != "a" or _TELLING(match[3]) else "")
            if tag in CONTAINERS:
                self.parents.append(container)
                self.keys.append(_key(self.keys[container], label))
                self.labels.append(label)
                self.bonus.append(bonus)
                container = len(self.keys) - 1
            stack.append((tag, container, max(drop, dropped), link or tag == "a", article or bonus > 0, heading or tag in HEADINGS))
            opened[tag] += 1
        add(source[at:])
        close(1)
        end_block()

    def best(self) -> int:
        """The container whose texts count most, the innermost of equal ones; 0 if there is no text."""
        n = len(self.keys)
        totals, held = [0] * n, [False] * n
        for container, _, value in self.blocks:
            totals[container] += value
            held[container] = True
        for i in range(n - 1, 0, -1):
            totals[self.parents[i]] += totals[i]
            held[self.parents[i]] |= held[i]
        return max((i for i in range(n) if held[i]), key=lambda i: (totals[i] + self.bonus[i], i), default=0)

    def path(self, container: int) -> str:
        """The generalised path of a container, for people to read."""
        labels = []
        while container:
            labels.append(self.labels[container])
            container = self.parents[container]
        return "/".join(reversed(labels))

    def text(self, chosen: set[int]) -> str:
        """The blocks inside the chosen containers, in page order, one a line."""
        inside = [i in chosen for i in range(len(self.keys))]
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parents[i]]
        return "\n".join(text for container, text, _ in self.blocks if inside[container])

    def extract(self, winners: list[int]) -> str:
        """The text by the first of the winning paths that has any, or else of the best container."""
        for key in winners:
            found = {i for i, k in enumerate(self.keys) if k == key}
            if found and (text := self.text(found)):
                return text
        return self.text({self.best()})


def votes(pages: DataFrame) -> DataFrame:
    """(host, key, path): the path of each page's best container; pages without host or text have no vote."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for host, source in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                page = Page(source.as_py())
                if page.blocks:
                    best = page.best()
                    rows.append((host, page.keys[best], page.path(best)))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows) if rows else ([], [], []), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["host", "key", "path"])

    return pages.where("host IS NOT NULL AND html IS NOT NULL").select("host", "html").mapInArrow(vote, "host string, key long, path string")


def winning_paths(counted: DataFrame) -> DataFrame:
    """(host, winners) from (host, key, votes): keys of paths with at least 1/SHARE of a host's votes, most votes first."""
    total = counted.groupBy("host").agg(F.sum("votes").alias("total"))
    own = counted.join(total, "host").where(F.col("votes") * SHARE >= F.col("total"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "key")))
    return own.groupBy("host").agg(F.transform(ordered, lambda x: x["key"]).alias("winners"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, key, path, votes): how many pages of each host voted for each path."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return votes(pages.select(host.alias("host"), "html")).groupBy("host", "key").agg(F.max("path").alias("path"), F.count("*").alias("votes"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html).

    The text is the article's: blocks in page order, one a line, white space inside a block made one
    space, character references decoded, without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles and comments. A null or empty html has an empty text. Pages without a host (null
    url, or one without "//") go by their own best container. Repeated rows, null ids and very long
    pages are kept; an empty table gives an empty result; other columns are left out, whatever their names.

    Votes are counted by host and path before they are shuffled; a host has at most SHARE winners, so
    the table of winners holds that many keys a host. It is written first, so that Spark knows its size: it is
    broadcast if small, and otherwise joined by sorting, where a host with many pages is split."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html")
    winners = stored(winning_paths(stored(host_paths(pages).drop("path"), "html-votes")), "html-winners")
    types = {f.name: f.dataType for f in pages.schema.fields}
    schema = f"page_id {types['page_id'].simpleString()}, url {types['url'].simpleString()}, text string, n_chars long"

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [Page(s.as_py() or "").extract(w or []) for s, w in zip(batch["html"], batch["winners"].to_pylist(), strict=True)]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    name = free_name(pages, "host")
    return pages.withColumn(name, host).join(winners.withColumnRenamed("host", name), name, "left").select("page_id", "url", "html", "winners").mapInArrow(extract, schema)
