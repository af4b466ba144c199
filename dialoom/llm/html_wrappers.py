r"""Operator 6: main text of web pages by union-free wrappers of hosts.

A page becomes a stream of tags and text slots, in which runs that repeat fold into
``(...)+``.  Equal streams of a host are counted as one, and streams are aligned a few at
a time, round by round: what matches stays, what only one side has becomes an optional
group ``(...)?``, adjacent equal groups become repeated.  The result is a union-free
regular expression per host, whose slots are grouped by the region (element below the
body) that holds them; the region named article or main, or else the one that holds most
characters outside page furniture over all pages of the host, is the host's main region.

A page's text is what lies in that region outside menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and comments.  A page without the region falls
back to all text outside furniture, less blocks that at least half of the host's distinct
texts (three or more) share; a text of such blocks alone is kept whole.  Every page is aligned and every page is extracted; a group that is aligned at once has
at most ``FAN_IN`` streams, however many pages a host has.

Edge cases: null or empty html gives an empty text; a null url is a host of its own; repeated
rows are extracted alike; very long pages are read whole; of regions with equal text the last by name wins; extra columns
are not read, whatever their names; broken markup follows the usual implied ends; no rows give no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.llm.common import join_bounded, materialize

FAN_IN = 32
#: rows (a host each) up to which wrappers are broadcast; a wrapper takes a few hundred bytes
WRAPPER_ROWS = 20_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("nav footer aside form menu head button dialog".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsored sponsor promo cookie cookies notice notices banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs comment comments reply replies discussion footer share social related subscribe newsletter popup modal consent search "
    "login signup toolbar pagination widget".split()
)
#: parts that a furniture class may have beside such words: inside an article a class counts only if it is made of both
AFFIXES = frozenset("area bar block body box button buttons container content form group header inner item items links list outer panel row section slot thread unit wrap wrapper".split())
MAIN = ("article", "main")
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def names_of(attributes: str) -> set[str]:
    """Classes, ids and roles of a tag."""
    return set(" ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower().split()) if attributes else set()


def parts_of(name: str) -> list[str]:
    return re.split(r"[_-]+", name)


def tells_furniture(names: set[str], inside: bool) -> bool:
    """Outside an article any part of a class tells; inside, where ``notice-board`` may be the topic, all of it must."""
    for parts in map(parts_of, names):
        told = [x in WORDS for x in parts]
        if any(told) and (not inside or all(t or x in AFFIXES or x.isdigit() for t, x in zip(told, parts, strict=True))):
            return True
    return False


class Reader:
    """Reads a page: its token stream and its blocks as (region, furniture, text)."""

    def __init__(self, page: str):
        self.stream: list[str] = []
        self.blocks: list[tuple[str, bool, str]] = []
        self.stack: list[tuple[str, bool, str]] = []
        self.parts: list[str] = []
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.parts.append(page[at : m.start()])
            at = m.end()
            if m.group(3):
                self.tag(m.group(3).lower(), bool(m.group(2)), m.group(4))
            elif m.group(1) and m.group(1).lower() in BLOCKS:
                self.end_block()
        self.parts.append(page[at:])
        self.end_block()

    def tag(self, name: str, closing: bool, attributes: str) -> None:
        if name in BLOCKS:
            self.end_block()
        elif name == "br":
            self.parts.append(" ")
        if name in VOID:
            return
        if closing:
            open_at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name), None)
            if open_at is not None and (name in BLOCKS or all(x[0] not in BLOCKS for x in self.stack[open_at:])):
                del self.stack[open_at:]
                if name in BLOCKS:
                    self.stream.append("/" + name)
            return
        if name in BLOCKS:
            self.implied(name)
        named = names_of(attributes)
        names = {x for one in named for x in parts_of(one) if x}
        above = self.stack[-1] if self.stack else ("", False, "")
        inside = above[2] in MAIN
        off = above[1] or name in FURNITURE or tells_furniture(named, inside) or (not inside and (name == "header" or "header" in names))
        region = above[2]
        if name in MAIN or "main" in names and name in BLOCKS:
            region = name if name in MAIN else "main"
        elif not region and name in BLOCKS and name not in ("html", "body", "head"):
            region = name + "." + ".".join(sorted(names)) if names else name
        self.stack.append((name, off, region))
        if name in BLOCKS:
            self.stream.append(name + ("!" if off else ""))

    def implied(self, name: str) -> None:
        ends = CLOSED_BY.get(name, ())
        for k in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[k][0]
            if tag == "p" or tag in ends:
                del self.stack[k:]
                if tag == "p":
                    break
            elif tag in BLOCKS:
                break

    def end_block(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(self.parts)).split())
            self.parts = []
            if text:
                _, off, region = self.stack[-1] if self.stack else ("", False, "")
                self.blocks.append((region, off, text))
                self.stream.append(f"#{'!' if off else ''}{region}")


def folded(stream: list[str], longest: int = 6) -> list[str]:
    """Runs of an equal unit become one ``(unit)+``."""
    for width in range(1, longest + 1):
        out: list[str] = []
        i = 0
        while i < len(stream):
            unit = stream[i : i + width]
            j = i + width
            while len(unit) == width and stream[j : j + width] == unit:
                j += width
            if j > i + width:
                text = " ".join(unit)
                out.append(text if text.endswith(")+") and width == 1 else f"({text})+")
                i = j
            else:
                out.append(stream[i])
                i += 1
        stream = out
    return stream


def optional(group: list[str]) -> list[str]:
    return [x if x.endswith(")?") else f"({x})?" for x in group]


def aligned(a: list[str], b: list[str]) -> list[str]:
    """A union-free pattern of both: common parts, the rest optional."""
    plain = lambda xs: [x[1:-2] if x.endswith(")?") else x for x in xs]
    out: list[str] = []
    for kind, i, j, k, m in SequenceMatcher(None, plain(a), plain(b), autojunk=False).get_opcodes():
        if kind == "equal":
            out += [x if not (x.endswith(")?") or y.endswith(")?")) else optional([x])[0] for x, y in zip(a[i:j], b[k:m], strict=True)]
        else:
            out += optional(a[i:j]) + optional(b[k:m])
    return folded(out, 2)


def main_region(pattern: list[str], heaviest: str) -> str:
    slots = re.findall(r"#(!?)([^\s()]*)", " ".join(pattern))
    good = {r for off, r in slots if not off}
    return next((name for name in MAIN if name in good), heaviest)


def streams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, pattern, null, 1) for each page and (host, null, region, characters outside furniture)."""
    for batch in batches:
        rows, held = [], Counter()
        for host, page in zip(batch["host"], batch["html"], strict=True):
            read = Reader(page)
            rows.append((host, json.dumps(folded(read.stream)), None, 1))
            for region, off, text in read.blocks:
                if not off:
                    held[host, region] += len(text)
        rows += [(host, None, region, n) for (host, region), n in held.items()]
        yield pd.DataFrame(rows, columns=["host", "pattern", "region", "n"])


def merged(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values(["pages", "pattern"], ascending=[False, True])
    pattern: list[str] = []
    for k, text in enumerate(rows["pattern"]):
        pattern = aligned(pattern, json.loads(text)) if k else json.loads(text)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "pattern": [json.dumps(pattern)], "pages": [int(rows["pages"].sum())]})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, pattern, heaviest): a wrapper per host from all its pages (host, html), and its region of most text."""
    told = pages.mapInPandas(streams, "host string, pattern string, region string, n bigint").groupBy("host", "pattern", "region").agg(F.sum("n").alias("n"))
    told = materialize(told, "wrapper-streams")
    heaviest = told.filter("region is not null").groupBy("host").agg(F.max_by("region", F.struct("n", "region")).alias("heaviest"))
    heaviest = materialize(heaviest, "wrapper-regions")
    found = told.filter("pattern is not null").select("host", "pattern", F.col("n").alias("pages"))
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("n")).filter("n > 1")
        sizes = materialize(sizes, "wrapper-sizes")
        if not sizes.limit(1).count():
            return join_bounded(found, heaviest, ["host"], "left", WRAPPER_ROWS).select("host", "pattern", F.coalesce("heaviest", F.lit("")).alias("heaviest"))
        todo = join_bounded(found, sizes, ["host"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        groups = F.greatest(F.ceil(F.col("n") / F.lit(FAN_IN / 2)), F.lit(1))
        todo = todo.withColumn("part", F.when(F.col("n") <= FAN_IN, 0).otherwise(F.pmod(F.xxhash64("pattern"), groups)))
        todo = todo.filter("n > 1").groupBy("host", "part").applyInPandas(merged, "host string, pattern string, pages bigint")
        done = join_bounded(found, sizes.select("host"), ["host"], "left_anti").select("host", "pattern", "pages")
        found = materialize(todo.unionByName(done), "wrapper-streams")


def extracted(page: str, region: str) -> tuple[str, bool]:
    """(text, whether it lies in the region)."""
    blocks = Reader(page).blocks
    own = [t for r, off, t in blocks if not off and r == region] if region else []
    inside = bool(own) or any(r == region for r, _, _ in blocks if region)
    if not inside:
        named = [r for r, off, _ in blocks if not off and r in MAIN]
        own = [t for r, off, t in blocks if not off and (r == named[0] if named else True)]
        inside = bool(named)
    return "\n\n".join(own), inside


def extract_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        regions = [main_region(json.loads(p), h) if isinstance(p, str) else "" for p, h in zip(batch["pattern"], batch["heaviest"], strict=True)]
        found = [extracted(h, r) for h, r in zip(batch["html"], regions, strict=True)]
        yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "host": batch["host"], "text": [t for t, _ in found], "inside": [i for _, i in found]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html)."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))
    own = pages.select("page_id", "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = infer_wrappers(own.select("host", "html"))
    paired = join_bounded(own, materialize(wrappers, "wrappers"), ["host"], "left", WRAPPER_ROWS)
    texts = paired.select("page_id", "url", "host", "html", "pattern", "heaviest").mapInPandas(extract_batches, "page_id bigint, url string, host string, text string, inside boolean")
    texts = materialize(texts, "page-texts")
    loose = texts.filter("not inside and text <> ''")
    if loose.limit(1).count():
        # Blocks that most of a host's distinct loose texts share are template text; copies of a page tell nothing.
        numbered = loose.select("host", F.xxhash64("text").alias("p"), F.explode(F.array_distinct(F.split("text", "\n\n"))).alias("b"))
        seen = numbered.select("host", "p", F.xxhash64("b").alias("b")).distinct().groupBy("host", "b").agg(F.count("*").alias("n"))
        pages_of = materialize(loose.select("host", F.xxhash64("text").alias("p")).distinct().groupBy("host").agg(F.count("*").alias("all")), "page-hosts")
        common = join_bounded(seen.filter("n >= 3"), pages_of, ["host"]).filter("2 * n >= all")
        common = materialize(common.groupBy("host").agg(F.collect_set("b").alias("common")), "page-template")
        texts = join_bounded(texts, common, ["host"], "left", WRAPPER_ROWS)
        less = F.array_join(F.filter(F.split("text", "\n\n"), lambda b: ~F.array_contains(F.col("common"), F.xxhash64(b))), "\n\n")
        texts = texts.withColumn("less", F.when(~F.col("inside") & F.col("common").isNotNull(), less))
        texts = texts.withColumn("text", F.when(F.col("less") != "", F.col("less")).otherwise(F.col("text")))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
