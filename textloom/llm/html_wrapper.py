"""Main text of web pages by union-free wrappers of each host.

A page is a token stream: for each block of text the path of elements that it stands in. Runs of
paths that come again at once (p p p, or h2 p h2 p) fold into repeated groups. Pages of a host that
begin and end with the same paths have one template. Its pages with equal streams are one skeleton,
whose items say whether their text is the same on all pages. The skeletons of a template are then
aligned one after another: what matches stays, a text that differs becomes a slot, and a mismatch
becomes an optional item, or one more turn of a group. The result is the template's wrapper, a
union-free regular expression over paths.

The wrapper says what the article is. A text that is the same on pages that differ elsewhere is
template and goes; slots and groups stay, unless they are mostly links. Tags, classes and roles are
hints: they name containers that hold an article, or that never do. Each page is aligned with its
wrapper again, so every block is judged by its own item.

Skeletons are counted with a map-side combine and merged in a tree of small groups chosen by hash,
so neither a host with a third of all pages nor the layout of files makes a difference.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared_store import bounded_batches, stored

# Elements by their part in a page.
RAW_TEXT = frozenset("script style textarea title iframe noscript".split())
NO_TEXT = frozenset("head template svg math object canvas audio video".split())
HEAD_PARTS = frozenset("meta link base title script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Hints that an element is the article, or isn't: its tag, or the words of a class, id or role.
NEVER_TAGS = frozenset("nav header footer aside form button select dialog menu".split())
ARTICLE_TAGS = frozenset(("article", "main"))
NEVER_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios complementary contentinfo cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related reply replies share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget alert consent pagination pager".split())
ARTICLE_WORDS = frozenset("article content main post story entry".split())
# Of the words above, those that settle it whatever else a name says.
DECISIVE_WORDS = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments comentarios cookie cookies disqus navbar navigation newsletter pagination promoted replies sidebar sponsored subscribe subscription".split())
#: Words that say nothing by themselves, so that "ad-slot" is an ad while "share-table" is not a share bar.
NEUTRAL_WORDS = frozenset("slot box list bar block container wrapper wrap area item items links link form thread signup section body text left right top bottom site page posts global primary secondary single blog inner outer group row col inline the by".split())
#: Elements of a path; deeper ones have the path of the last of these, and their hints.
PATH_DEPTH = 64
#: Longest run of paths that folds into a group with its neighbour.
GROUP_LENGTH = 4
#: Cells of the table by which two streams are aligned at once.
TABLE_CELLS = 1 << 20
#: Wrappers that one task merges at once; more are merged in a tree.
FAN = 16
#: Bytes of all wrappers up to which they are broadcast; beyond, they are joined by template and one of SALTS.
BROADCAST_BYTES = 32 << 20
SALTS = 32
#: Partial skeletons that a task holds before it sends them on.
HELD_SKELETONS = 2000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[a-zA-Z][^>]*>", re.S)
_ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _hint(tag: str, marks: list[str]) -> int:
    """-1: never of an article, 1: by its words an article, 2: by its tag or role, 0: nothing known."""
    best = 2 if tag in ARTICLE_TAGS else -1 if tag in NEVER_TAGS else 0
    for mark in marks:
        parts = {w.lower() for w in _PARTS.findall(mark) if len(w) > 1}  # the x of 300x250 is no word
        if parts & DECISIVE_WORDS:
            return -1
        if not parts or parts - NEVER_WORDS - ARTICLE_WORDS - NEUTRAL_WORDS:
            continue
        if parts & NEVER_WORDS:
            return -1
        if parts & ARTICLE_WORDS:
            best = max(best, 2 if parts == {"main"} else 1) if best >= 0 else best
    return best


@lru_cache(10_000)
def _name(tag: str, attributes: str) -> tuple[str, int]:
    """The element's part of a path (tag and marks without digits), and its hint."""
    marks: list[str] = []
    for key, *values in _ATTR.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "style":
            gone = re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)
        else:
            gone = key == "hidden" or key == "aria-hidden" and value.lower() == "true"
        if gone:
            return f"{tag}.hidden", -1
        if key in ("class", "id", "role"):
            marks += [x for m in value.split() if (x := re.sub(r"[0-9/]+", "", m).strip("-_."))]
    hint = 0 if tag in ("html", "body") else _hint(tag, marks)
    return ".".join([tag, *sorted(set(marks))]) if tag not in ("html", "body") else tag, hint


class Block:
    """A block of text: its path, its hint, its text and how many of its characters are links."""

    __slots__ = ("path", "hint", "text", "links")

    def __init__(self, path: str, hint: int, text: str, links: int):
        self.path, self.hint, self.text, self.links = path, hint, text, links


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; character references are decoded, white space becomes one space.

    End tags that are missing close with their parents; head ends with the first element that it
    can't hold; an element without text of its own that is never closed counts as empty.
    """
    out: list[Block] = []
    stack: list[tuple[str, str, int, bool]] = [("", "", 0, False)]  # tag, path, hint, without text
    opened: Counter[str] = Counter()
    words: list[str] = []
    links = at = 0
    low = ""

    def flush() -> None:
        nonlocal links
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            _, path, hint, _ = stack[-1]
            out.append(Block(path, hint, text, min(links, len(text))))
        words.clear()
        links = 0

    def say(text: str) -> None:
        nonlocal links
        if text and not stack[-1][3]:
            words.append(text)
            if opened["a"]:
                links += len(text)

    def cut(depth: int) -> None:
        if any(t not in INLINE for t, *_ in stack[depth:]):
            flush()
        for t, *_ in stack[depth:]:
            opened[t] -= 1
        del stack[depth:]

    def innermost(tags: frozenset[str] | set[str], fence: frozenset[str] = frozenset()) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                return k
            if stack[k][0] in fence:
                break
        return 0

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                cut(innermost({tag}))
            elif tag not in INLINE:
                flush()
            continue
        if opened["head"] and tag not in HEAD_PARTS:
            cut(innermost({"head"}))
        if tag not in INLINE:
            flush()
        elif tag in ("br", "img"):
            say(" ")
        if tag in VOID:
            continue
        if tag in RAW_TEXT or tag in NO_TEXT and tag != "head":
            low = low or page.lower()
            end = low.find(f"</{tag}", at)
            if tag in RAW_TEXT:
                at = end if end >= 0 else len(page) if tag in ("script", "style") and not m[3].endswith("/") else at
                continue
            if end < 0 or m[3].endswith("/"):
                continue
        if tag in CLOSES_P and opened["p"]:
            if k := innermost({"p"}, CLOSES_P - {"p"}):
                cut(k)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            mine = {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {"tr"} if tag == "tr" else {"option"}
            if k := innermost(mine, frozenset(("ul", "ol", "dl", "table", "select"))):
                cut(k)
        _, path, hint, mute = stack[-1]
        name, own = _name(tag, m[3])
        mute = mute or tag in NO_TEXT
        if tag in INLINE:  # part of its block, whatever its class says, but for what isn't shown
            mute, own = mute or name.endswith(".hidden"), 0
        else:
            if tag == "header" and hint > 0 and own < 0 and name == "header":
                own = 0  # an article's own header holds its title
            if tag != "html" and (len(stack) <= PATH_DEPTH or own):
                path = f"{path}/{name}" if path else name
        stack.append((tag, path, -1 if hint < 0 or own < 0 else max(hint, own), mute))
        opened[tag] += 1
    say(page[at:])
    flush()
    return out


def fold(paths: list[str]) -> tuple[list[list], list[int]]:
    """Items [path, repeated] of a stream, in which a run that comes again at once is one group, and the item of each block."""
    out: list[int] = []
    alias: list[int] = []
    repeated: list[bool] = []
    for path in paths:
        out.append(len(alias))
        alias.append(len(alias))
        repeated.append(False)
        again = True
        while again:
            again = False
            for n in range(1, min(GROUP_LENGTH, len(out) // 2) + 1):
                if all(paths[out[-k]] == paths[out[-k - n]] for k in range(1, n + 1)):
                    for k in range(1, n + 1):
                        alias[out[-k]] = out[-k - n]
                        repeated[out[-k - n]] = True
                    del out[-n:]
                    again = True
                    break

    def root(k: int) -> int:
        while alias[k] != k:
            k = alias[k]
        return k

    place = {k: i for i, k in enumerate(out)}
    return [[paths[k], repeated[k]] for k in out], [place[root(k)] for k in range(len(paths))]


class Item:
    """An item of a wrapper.

    low and high: the smallest and largest hash of its text on a page, so it is a slot where they
    differ; first and last: the same of whole pages, so where they differ at least two different
    pages have it. chars and links are sums over pages.
    """

    __slots__ = ("path", "hint", "optional", "repeated", "low", "high", "first", "last", "chars", "links")

    def __init__(self, path, hint, optional, repeated, low, high, first, last, chars, links):
        self.path, self.hint, self.optional, self.repeated = path, hint, optional, repeated
        self.low, self.high, self.first, self.last, self.chars, self.links = low, high, first, last, chars, links

    @property
    def slot(self) -> bool:
        return self.low != self.high

    def row(self) -> list:
        return [getattr(self, k) for k in self.__slots__]

    def joined(self, other: Item) -> Item:
        return Item(self.path, self.hint, self.optional or other.optional, self.repeated or other.repeated, min(self.low, other.low), max(self.high, other.high), min(self.first, other.first), max(self.last, other.last), self.chars + other.chars, self.links + other.links)


def common(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """Steps through both sequences: pairs of a longest common subsequence, and what only one has.

    Up to TABLE_CELLS a table of lengths; larger pairs are halved, with lengths counted in the bits of two
    numbers (Hirschberg's way), so memory grows with the sequences and not with their product.
    """
    if a == b:
        return [(k, k) for k in range(len(a))]
    out: list[tuple[int | None, int | None]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        low, high, first, last = waiting.pop()
        if (high - low) * (last - first) <= TABLE_CELLS or last - first < 2:
            out += [(None if i is None else low + i, None if j is None else first + j) for i, j in _table_steps(a[low:high], b[first:last])]
            continue
        mid = (first + last) // 2
        ahead = _prefix_lengths(a[low:high], b[first:mid])
        behind = _prefix_lengths(a[low:high][::-1], b[mid:last][::-1])[::-1]
        cut = low + max(range(high - low + 1), key=lambda k: ahead[k] + behind[k])
        waiting += [(cut, high, mid, last), (low, cut, first, mid)]  # the left half is taken next
    return out


def _prefix_lengths(a: list[str], b: list[str]) -> list[int]:
    """The length of a longest common subsequence of b with each prefix of a, all of them at once in the bits of a number."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    every = rest = (1 << len(a)) - 1
    for x in b:
        if here := places.get(x, 0) & rest:
            rest = ((rest + here) | (rest - here)) & every
    out = [0]
    for bit in reversed(f"{rest:0{len(a)}b}" if a else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def _table_steps(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    n, m = len(a), len(b)
    if n * m > TABLE_CELLS:  # one element of b against very many of a
        k = a.index(b[0]) if m and b[0] in a else None
        return [(i, 0 if i == k else None) for i in range(n)] if k is not None or not m else [*((i, None) for i in range(n)), (None, 0)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else row[j + 1] if row[j + 1] > below[j] else below[j]
    steps, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j] and best[i][j] == best[i + 1][j + 1] + 1:
            steps.append((i, j))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            steps.append((i, None))
            i += 1
        else:
            steps.append((None, j))
            j += 1
    return steps


def settled(items: list[Item]) -> list[Item]:
    """Groups again after an alignment: between two items that all pages have, optional items of one path are one repeated item."""
    out: list[Item] = []
    since: dict[str, int] = {}
    for item in items:
        if out and out[-1].path == item.path:
            both = out[-1].joined(item)
            both.optional, both.repeated = out[-1].optional and item.optional, True
            out[-1] = both
        elif item.optional and item.path in since:
            k = since[item.path]
            out[k] = out[k].joined(item)
            out[k].repeated = True
        else:
            out.append(item)
        if not out[-1].optional:
            since.clear()
        elif out[-1] is item:
            since[item.path] = len(out) - 1
    return out


def align(a: list[Item], b: list[Item]) -> list[Item]:
    """The wrapper of both: matches join, so texts that differ become slots; the rest becomes optional."""
    out = []
    for i, j in common([x.path for x in a], [y.path for y in b]):
        if i is not None and j is not None:
            out.append(a[i].joined(b[j]))
        else:
            item = a[i] if j is None else b[j]
            out.append(Item(*(item.row()[:2] + [True] + item.row()[3:])))
    return settled(out)


def verdicts(wrapper: list[Item]) -> list[int]:
    """For each item 0 (not of the article), or how surely it is: 1 by the wrapper alone, 2 and 3 with a hint.

    Template is what has the same text on pages that differ elsewhere. Inside a container that is
    hinted at, pages of which most of the text is the same are copies of each other, and nothing of them is template.
    Without a hint, the deepest container with most of the slots' text is the article's; a heading beside it stays.
    """
    constant = [not x.slot and x.first != x.last for x in wrapper]
    differs = any(x.slot for x in wrapper)
    out = []
    inside = [(x.chars, c) for x, c in zip(wrapper, constant, strict=True) if x.hint > 0]
    copies = 2 * sum(n for n, c in inside if c) > sum(n for n, _ in inside)
    for x, c in zip(wrapper, constant, strict=True):
        if x.hint < 0:
            out.append(0)
        elif x.hint > 0:
            out.append(0 if c and differs and not copies else 1 + x.hint)
        else:
            out.append(0 if c and differs or 2 * x.links > x.chars else 1)
    plain = [k for k, v in enumerate(out) if v == 1]
    mass: Counter[str] = Counter()
    for k in plain:
        parts = wrapper[k].path.split("/")
        for n in range(1, len(parts)):
            mass["/".join(parts[:n])] += wrapper[k].chars
    total = sum(wrapper[k].chars for k in plain)
    held = [p for p, n in mass.items() if 10 * n >= 6 * total]
    if held:
        main = max(held, key=lambda p: (p.count("/"), p))
        for k in plain:
            path = wrapper[k].path
            if not path.startswith(f"{main}/") and not path.rsplit("/", 1)[-1].split(".")[0] == "h1":
                out[k] = 0
    return out


def least_verdict(wrapper: list[Item], judged: list[int]) -> int:
    """The verdict from which on items are the article: the highest that holds, with those above it, half of what is judged to be of
    hinted containers; of plain ones only where hinted containers have less than a tenth of all.

    So the mass of text decides, and a hint between containers of like mass: a title in an article element doesn't outweigh
    the body beside it.
    """
    mass = [sum(x.chars for x, v in zip(wrapper, judged, strict=True) if v == level) for level in range(4)]
    hinted = mass[2] + mass[3]
    if 10 * hinted < mass[1]:
        return 1
    return 3 if 2 * mass[3] >= hinted > 0 else 2 if hinted else 1


def page_verdicts(paths: list[str], wrapper: list[Item], judged: list[int]) -> list[int]:
    """A verdict for each block of a page, from the wrapper's items that its stream aligns with."""
    items, of = fold(paths)
    steps = common([p for p, _ in items], [x.path for x in wrapper])
    match = {i: j for i, j in steps if i is not None and j is not None}
    by_path: dict[str, list[int]] = {}
    for j, x in enumerate(wrapper):
        by_path.setdefault(x.path, []).append(j)
    own = []
    for i, (path, _) in enumerate(items):
        j = match.get(i)
        if j is None:  # a turn of a group that was folded elsewhere: the item of its path
            found = by_path.get(path, [])
            j = next((k for k in found if wrapper[k].optional), found[0] if found else None)
        own.append(judged[j] if j is not None else 0)
    return [own[k] for k in of]


def _text_hash(parts: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\n\n".join(parts).encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_wrapper(page: str) -> list[Item]:
    """The wrapper of one page."""
    found = blocks(page)
    items, of = fold([b.path for b in found])
    texts: list[list[str]] = [[] for _ in items]
    sums = [[0, 0, 0] for _ in items]
    for b, k in zip(found, of, strict=True):
        texts[k].append(b.text)
        sums[k][0] += len(b.text)
        sums[k][1] += b.links
        sums[k][2] = b.hint
    whole = _text_hash([b.text for b in found])
    return [Item(path, n[2], False, r, h, h, whole, whole, n[0], n[1]) for (path, r), n, h in zip(items, sums, map(_text_hash, texts), strict=True)]


def template_of(host: str, paths: list[str]) -> str:
    """The key of a page's template: its host, and the paths that it begins and ends with."""
    return "\n".join((host, paths[0], paths[-1])) if paths else host


_PARTIAL = "template string, skeleton string, k int, low bigint, high bigint, first bigint, last bigint, chars bigint, links bigint"


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of the pages' skeletons, joined as far as a task's pages share them."""
    held: dict[tuple[str, str], list[Item]] = {}

    def sent() -> pa.RecordBatch:
        rows = [(template, skeleton, k, *x.row()[4:]) for (template, skeleton), items in held.items() for k, x in enumerate(items)]
        held.clear()
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 6]
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["template", "skeleton", "k", "low", "high", "first", "last", "chars", "links"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            items = page_wrapper(page.as_py() or "")
            key = template_of(host, [x.path for x in items]), json.dumps([[x.path, x.hint, x.repeated] for x in items])
            held[key] = [x.joined(y) for x, y in zip(held[key], items, strict=True)] if key in held else items
            if len(held) >= HELD_SKELETONS:
                yield sent()
    yield sent()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """The wrapper of up to about FAN wrappers of a template, taken in an order that depends on them alone."""
    whole: list[Item] | None = None
    for text in sorted(group["wrapper"], key=lambda t: (len(t), t)):
        items = [Item(*row) for row in json.loads(text)]
        whole = items if whole is None else align(whole, items)
    return pd.DataFrame({"template": [group["template"].iloc[0]], "bucket": [group["bucket"].iloc[0]], "wrapper": [json.dumps([x.row() for x in whole or []])]})


def template_wrappers(pages: DataFrame) -> DataFrame:
    """template, wrapper (JSON rows of Item) from pages with host and html."""
    spark = pages.sparkSession
    partial = pages.select("host", "html").mapInArrow(_skeletons, _PARTIAL)
    sums = partial.groupBy("template", "skeleton", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    rows = sums.groupBy("template", "skeleton").agg(F.array_sort(F.collect_list(F.struct("k", "low", "high", "first", "last", "chars", "links"))).alias("items"))
    name = F.from_json("skeleton", "array<array<string>>")
    row = lambda n, i: F.to_json(F.struct(n[0].alias("p"), n[1].cast("int").alias("h"), F.lit(False).alias("o"), n[2].cast("boolean").alias("r"), *[i[c].alias(c) for c in ("low", "high", "first", "last", "chars", "links")]))
    # to_json writes objects; their values in order are the rows of Item
    made = rows.select("template", F.xxhash64("skeleton").alias("code"), F.zip_with(name, "items", row).alias("rows")).mapInArrow(_as_wrapper, "template string, code bigint, wrapper string")
    made = stored(spark, made)
    counts = made.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    most = counts.agg(F.max("n")).first()[0] or 0
    now = made.join(counts, "template").select("template", F.pmod("code", F.ceil(F.col("n") / FAN)).cast("bigint").alias("bucket"), "wrapper")
    left = most
    while True:
        now = now.groupBy("template", "bucket").applyInPandas(_merge, "template string, bucket bigint, wrapper string")
        left = -(-left // FAN)
        if left <= 1:
            return stored(spark, now.select("template", "wrapper"))
        now = now.select("template", F.floor(F.col("bucket") / FAN).cast("bigint").alias("bucket"), "wrapper")


def _as_wrapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [json.dumps([list(json.loads(r).values()) for r in rows]) for rows in batch.column("rows").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("template"), batch.column("code"), pa.array(made, pa.string())], names=["template", "code", "wrapper"])


def _with_template(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their template and a salt."""
    for batch in batches:
        keys, salts = [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            found = blocks(page.as_py() or "")
            keys.append(template_of(host, [b.path for b in found]))
            salts.append(_text_hash([b.text for b in found]) % SALTS)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(salts, pa.int32()), batch.column("html"), batch.column("row")], names=["template", "salt", "html", "row"])


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Adds text (blocks of the article joined by an empty line, "" if none) and n_chars to each page row.

    Null or empty html gives "", as does a page without text; a null url counts as a host of its own, whose wrappers its pages
    share. Repeated rows stay, each with its text. Very long pages are read whole. Of docs' columns
    only those named text and n_chars are replaced; the html is left out.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"//([^/?#]+)", 1)), F.lit(""))
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    types = dict(pages.dtypes)
    wrappers = template_wrappers(pages.select(host.alias("host"), F.col(html_col).alias("html")))
    rows = pages.select(host.alias("host"), F.col(html_col).alias("html"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row") if kept else F.struct(F.lit(1)).alias("row"))
    inner = ", ".join(f"`{c}`: {types[c]}" for c in kept) or "col1: int"
    size = wrappers.agg(F.coalesce(F.sum(F.octet_length("template") + F.octet_length("wrapper")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast({r.template: r.wrapper for r in wrappers.collect()})
        joined, wrapper_of = rows, lambda batch: None
    else:
        salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = rows.mapInArrow(_with_template, f"template string, salt int, html string, row struct<{inner}>")
        table, wrapper_of = None, lambda batch: batch.column("wrapper").to_pylist()
        joined = keyed.join(salted, ["template", "salt"], "left_outer").select("wrapper", "html", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[Item], list[int], int]] = {}
        streams: dict[tuple, list[int]] = {}
        for batch in batches:
            texts = []
            own_wrappers = wrapper_of(batch)
            hosts = batch.column("host").to_pylist() if own_wrappers is None else None
            for n, page in enumerate(batch.column("html")):
                found = blocks(page.as_py() or "")
                paths = tuple(b.path for b in found)
                wrapper = (own_wrappers[n] if hosts is None else table.value.get(template_of(hosts[n], paths))) or "[]"
                if wrapper not in known:
                    if len(known) >= 1000:
                        known.clear()
                        streams.clear()
                    items = [Item(*row) for row in json.loads(wrapper)]
                    judged = verdicts(items)
                    known[wrapper] = items, judged, least_verdict(items, judged)
                own = streams.get((wrapper, paths))
                if own is None:
                    own = page_verdicts(list(paths), *known[wrapper][:2])
                    if len(streams) >= 5000:
                        streams.clear()
                    if len(paths) <= 500:
                        streams[wrapper, paths] = own
                least = max(1, min(known[wrapper][2], max(own, default=0)))  # a page without the article's container has what it has
                texts.append("\n\n".join(b.text for b, v in zip(found, own, strict=True) if v >= least))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    done = joined.mapInArrow(run, f"row struct<{inner}>, text string, n_chars bigint")
    return done.select(*[F.col("row").getField(c).alias(c) for c in kept], "text", "n_chars")
