"""Main text of web pages by the containers that a host's pages agree on.

1. Each page scores its containers: prose outside links, navigation, adverts and the like. Walking down from the body, it goes
   to the child that holds most of the prose, and names the innermost article or main on that way, else the last
   container, by its generalised path: tags with their sorted classes, digits as #.
2. Each host's pages vote for paths (grouped sums, added up within tasks first). A path wins with `least_share` of
   the host's votes and at least two, so a host has at most 1 / least_share winners.
3. Each page is extracted again: by the winning path with most votes that holds prose in it, else by its own.
   The body never overrules a page's own choice, as every page has one.

The winners are broadcast where they are few enough (checked by rows and bytes); beyond, pages meet theirs by host and
a salt of the page, so a host with a third of all pages spreads over `salts` partitions.

What is dropped: markup, comments, scripts, styles, and whole elements that are menus, headers, footers, sidebars,
notices, adverts, forms or readers' comments by tag, role, class or id. Everything else of the winning container stays: its blocks (p,
li, headings, cells and other block elements) in page order, white space within them as one space, character
references decoded, joined by two line feeds.

Defined results: null, empty or textless html gives '' and 0; unclosed elements end with their container; an unclosed
comment, script or style swallows the rest, and a tag that never ends is dropped; a page without a host takes its own path. Rows may repeat and ids may be null:
each row is a page. An empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch, broadcast_if_small

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)|([^>]*+))>|<[!?][^>]*+>", re.S)
OPENED = re.compile(r"<(?=[A-Za-z/!?])")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|itemprop|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/\"'>]|\Z)", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")

#: Elements whose content is no markup, or never text of an article.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SKIPPED = RAW | frozenset("noscript template svg math select button object canvas audio video map datalist".split())
#: Elements that make up paths.
CONTAINERS = frozenset("div section article main nav header footer aside form table td th ul ol dl figure details fieldset dialog menu center".split())
#: Other elements that begin and end blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address tr tbody thead tfoot caption figcaption summary legend hr body html hgroup".split())

#: Containers nested deeper count as part of the one at this depth, so that paths stay short.
MOST_DEPTH = 256

#: Tags, roles and words of classes and ids of what is no article.
NO_TAGS = frozenset("nav footer aside dialog menu".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NO_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead comment comments disqus respond share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "search pagination pager widget toolbar teaser".split()
)
YES_WORDS = frozenset("article entry post story content body".split())
#: What an article or main must be called to be none.
NO_ARTICLE = frozenset("comment comments related recommended teaser promo sponsored advert advertisement".split())


def host_of(url: Column) -> Column:
    """The lower-case host of an address without user and port; null without one."""
    found = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    return F.when(found != "", found)


def judge(tag: str, attributes: str) -> tuple[str, int]:
    """(segment of the path, 0 for text, 1 for a form, 2 for what is no article)."""
    named = {}
    for name, value in ATTRIBUTE.findall(attributes):
        named.setdefault(name.lower(), value.strip("\"'"))
    classes = sorted({re.sub(r"\d+", "#", c.lower()) for c in unescape(named.get("class", "")).split()})
    segment = ".".join([tag, *(c.replace(">", "") for c in classes)])
    words = {w.lower() for w in WORDS.findall(named.get("class", "") + " " + named.get("id", ""))}
    if "hidden" in named or re.search(r"display\s*:\s*none", named.get("style", ""), re.I) or named.get("aria-hidden", "").lower() == "true":
        return segment, 2
    if tag in ("article", "main"):
        return segment, 2 if words & NO_ARTICLE else 0
    if tag in NO_TAGS or named.get("role", "").lower() in NO_ROLES or words & NO_WORDS:
        return segment, 2
    if "header" in words and not words & YES_WORDS:
        return segment, 2
    return segment, 1 if tag == "form" else 0


_judge = common.Memo(lambda key: judge(*key), most=20_000)


def blocks(html: str) -> list[tuple[str, int, str, int, int]]:
    """(path, level as by `judge`, text, characters outside links, number of the container) of every block with text, in page order."""
    out: list[tuple[str, int, str, int, int]] = []
    stack: list[tuple[str, str, int, int]] = [("body", "body", 0, 0)]  # tag, path, highest level on the way, number
    opened = 0
    parts: list[str] = []
    linked = leaf_level = at = 0
    in_link, leaf, unclosed = False, "", set()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((stack[-1][1], max(stack[-1][2], leaf_level), text, max(0, len(text) - linked), stack[-1][3]))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                linked += len(text)

    end = html.rfind(">") + 1
    while found := TOKEN.search(html, at, end):
        say(html[at : found.start()])
        at = found.end()
        closing, tag, quoted, plain = found.groups()
        if tag is None:
            if at == end and found.group().startswith("<!--") and not found.group().endswith(">"):
                at = len(html)
                break
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if closing or tag in unclosed:
                continue
            close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
            if close:
                at = close.start()
            elif tag in RAW:
                at = len(html)
                break
            else:
                unclosed.add(tag)
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            parts.append(" ")
        elif tag in CONTAINERS:
            flush()
            in_link, leaf, leaf_level = False, "", 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            else:
                if tag in ("td", "th"):  # a cell ends the cell before it
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == "table":
                            break
                        if stack[k][0] in ("td", "th"):
                            del stack[k:]
                            break
                attributes = quoted or plain or ""
                segment, level = _judge[tag, attributes] if len(attributes) <= 300 else judge(tag, attributes)
                if tag == "header" and not any(x[0] == "article" for x in stack):
                    level = 2  # the page's header, not an article's
                path = f"{stack[-1][1]}>{segment}" if len(stack) < MOST_DEPTH else stack[-1][1]
                opened += 1
                stack.append((tag, path, max(stack[-1][2], level), opened))
        elif tag in LEAVES:
            flush()
            in_link = False
            if closing or leaf in ("", "p", tag):
                leaf, leaf_level = "", 0
            attributes = quoted or plain or ""
            if not closing and attributes and tag not in ("body", "html"):
                level = (_judge[tag, attributes] if len(attributes) <= 300 else judge(tag, attributes))[1]
                if level:
                    leaf, leaf_level = tag, level
    say(OPENED.split(html[at:], maxsplit=1)[0])  # a tag that never ends is no text
    flush()
    return out


def prose(found: list[tuple[str, int, str, int, int]]) -> tuple[int, Counter, set[str]]:
    """(level up to which blocks count, characters outside links under each path, paths of cells that hold data).

    Text outside forms counts; where there is none, that within forms does. Cells that share a path hold data, a single one a layout.
    """
    level = 0 if any(x[1] == 0 and x[3] for x in found) else 1
    under: Counter = Counter()
    cells: dict[str, int] = {}
    data = set()
    for path, how, _, chars, number in found:
        if how <= level and chars:
            under[path] += chars
            if cells.setdefault(path, number) != number:
                data.add(path)
    whole: Counter = Counter()
    for path, chars in under.items():
        cut = len(path)
        while cut > 0:
            whole[path[:cut]] += chars
            cut = path.rfind(">", 0, cut)
    return level, whole, {p for p in data if last_tag(p) in ("td", "th")}


def last_tag(path: str) -> str:
    return path.rpartition(">")[2].split(".")[0]


def semantic(path: str) -> bool:
    return last_tag(path) in ("article", "main")


def best_path(whole: Counter, data: set[str]) -> str | None:
    """The container that a page names: see the module; ties go to the path that is first by letters."""
    if not whole:
        return None
    children: dict[str, list[str]] = {}
    for path in whole:
        if path != "body" and path not in data:
            children.setdefault(path.rpartition(">")[0], []).append(path)
    now, chosen = "body", None
    while True:
        if semantic(now):
            chosen = now
        below = sorted(children.get(now, []), key=lambda p: (-whole[p], p))
        # an article or main needs a third of the prose around it, any other container most of it
        step = next((p for p in below if 3 * whole[p] >= whole[now] and semantic(p)), None)
        step = step or next((p for p in below if 5 * whole[p] >= 3 * whole[now]), None)
        if step is None:
            return chosen or now
        now = step


def extract(html: str, winners: list[str]) -> tuple[str, str | None, bool]:
    """(text, path, whether the path is one of the host's winners)."""
    found = blocks(html)
    level, whole, data = prose(found)
    own = best_path(whole, data)
    if own is None:
        return "", None, False
    path = next((p for p in winners if whole.get(p)), own)
    inside = [text for at, how, text, *_ in found if how <= level and (at == path or at.startswith(path + ">"))]
    return "\n\n".join(inside), path, path in winners


def votes(pages: DataFrame, html_col: str = "html", most_kept: int = 50_000) -> DataFrame:
    """(host, path, votes): what the pages of each host name. A task holds up to `most_kept` sums at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(sums)
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(sums.values()), pa.int64())], ["host", "path", "votes"])
            sums.clear()
            return batch

        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
                path = best_path(*prose(blocks(html))[1:])
                if path is not None:
                    sums[host, path] += 1
            if len(sums) > most_kept:
                yield out()
        yield out()

    named = common.arrow_pass(pages.select("host", html_col).where("host IS NOT NULL"), run, "host string, path string, votes long")
    return named.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def winning_paths(voted: DataFrame, least_share: float = 0.1, most_rows: int = 500_000) -> DataFrame:
    """(host, paths): a host's winners, most votes first, ties by path; at most 1 / least_share of them."""
    total = voted.groupBy("host").agg(F.sum("votes").alias("total"))
    won = voted.join(broadcast_if_small(total, most_rows), "host").where((F.col("votes") >= 2) & (F.col("votes") >= least_share * F.col("total")) & (F.col("path") != "body"))
    paths = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("v"), "path"))), lambda x: x["path"])
    return won.groupBy("host").agg(paths.alias("paths"))


def main_texts(pages: DataFrame, *, least_share: float = 0.1, most_hosts: int = 500_000, salts: int = 32, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars, path (null without text), agreed (whether the host's pages agree on it)."""
    spark = pages.sparkSession
    common.bounded_batches(spark)
    scratch = Scratch(spark, "html")
    pages = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), host_of(pages[url_col]).alias("host"), pages[html_col].cast("string").alias("html"))
    winners = winning_paths(scratch.cut(votes(pages), "votes"), least_share, most_hosts)
    winners = scratch.cut(winners, "winners")
    if winners.limit(most_hosts + 1).count() <= most_hosts:
        met = pages.join(broadcast_if_small(winners, most_hosts), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = pages.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [extract(html, winners or []) for html, winners in zip(common.texts(batch.column(2)), batch.column(3).to_pylist())]
            text, path, agreed = zip(*got) if got else ((), (), ())
            columns = [pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array(path, pa.string()), pa.array(agreed, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "url", "text", "n_chars", "path", "agreed"])

    kind = pages.schema["id"].dataType.simpleString()
    out = common.arrow_pass(met.select("id", "url", "html", "paths"), run, f"id {kind}, url string, text string, n_chars long, path string, agreed boolean")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
