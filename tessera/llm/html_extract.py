"""Main text of web pages by wrappers inferred per host.

A page is read as a stream of tags and text slots.  Repeated neighbouring
blocks of the stream are folded into ``(...)+``, then the streams of one host
are aligned one after another: what only some of them have becomes ``(...)?``,
what differs in text stays a slot.  The result is the host's wrapper, a regular
expression without unions.  Each task infers wrappers of its own pages; equal
ones collapse, and the remaining few per host are aligned with each other, by
host and salt first and by host then, so no task holds all pages of a host.

Every page is then read by its host's wrapper as an automaton, which says for
each text which slot of the wrapper it fills; a tag that the wrapper lacks is
passed over and leaves the automaton where it is.  A slot, together with the
elements that are open there, decides about its texts:

* on pages with an article, the slots within it are the page's own text;
* on other pages, a text that all pages of the host with this slot hold in it
  is template, if at least ``TEMPLATE_PAGES`` of these pages are different, and
  what varies is own text.  Pages whose slots hold the same texts count as one;
* slots in elements for navigation, notices, forms, adverts, scripts, styles or
  reader comments never are.  Element names decide that, and class, id and role
  where they name nothing else: ``cookie-notice`` does, ``related-work`` doesn't.

Slots within articles aren't compared between pages, as near copies of one
article would empty each other.  A stretch whose alignment would pass
``ALIGN_CELLS`` or ``WIDEST`` becomes a loose group that reads any sequence of
its tags; no text is left out by that.

Defined results: null and empty pages have the empty text; a null address is
the host "" ; unclosed elements end with their parent, a truncated page ends all
of them; a tag without its end is markup up to the next ``<``, or the end of the
page, and an attribute whose quotation mark isn't closed ends with its tag;
repeated rows give equal rows; nothing is capped: a page of any length is read
whole, in time linear in its length.
"""

from __future__ import annotations

import functools
import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch, table

TEMPLATE_PAGES = 3
SALTS = 64
#: Wrapper tables up to this many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 16_000_000
#: Steps of a wrapper's automaton that a task keeps, and automata.
STEPS_HELD, READERS_HELD = 50_000, 500
LONGEST_BLOCK = 16
ALIGN_CELLS = 40_000
WIDEST = 48
HOSTS_HELD = 5_000

# Element and class names by their role.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed".split())
SKIPPED = frozenset("script style noscript iframe template svg head title nav header footer aside form button select textarea input menu dialog object canvas audio video xmp noembed".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a new start tag of the same group closes.
SIBLINGS = {"p": "p", "li": "li", "dt": "dl", "dd": "dl", "tr": "tr", "td": "td", "th": "td", "option": "option"}
BARRIERS = frozenset("ul ol dl table article section div body html main td th blockquote nav header footer aside form".split())
#: Words of class, id and role that say what an element is for wherever they stand in a name.
ASIDE_WORDS = frozenset("advert advertisement sponsor sponsored nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead cookie cookies disqus newsletter subscribe signup login".split())
#: Words that say so only in a name of such words and neutral ones, on an element all of whose names are so.
WEAK_ASIDE_WORDS = frozenset("ad ads banner promo menu header consent notice alert popup modal share sharing social related recommended comment comments".split())
NEUTRAL_WORDS = frozenset("site page main global top bottom left right center box bar list item items wrapper container section block area widget inner outer body content text links link buttons button icons posts post stories primary secondary row col grid flex bg card panel group small large mobile desktop hidden sticky fixed the and of by".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[a-zA-Z][^\s<>/\"']*+(?:[^<>\"']|\"[^\"]*\"(?=\s|/?>)|'[^']*'(?=\s|/?>))*+>"
    r"|<[a-zA-Z/!?][^<>]*+>?",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_NAMED = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"[a-z][a-z_-]*")
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is open, close or text; comments and declarations give nothing."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        tag = m[0]
        if (named := _NAME.match(tag)) is None:
            continue
        name = named[1].lower()
        if tag[1] == "/":
            yield "close", name, ""
            continue
        whole = tag[-1] == ">"
        yield "open", name, tag[named.end() : -1] if whole else tag[named.end() :]
        if name in RAW and whole and not tag.endswith("/>"):
            end = _raw_end(name).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                yield "text", "", page[at:stop]
            at = stop


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def label(name: str, rest: str) -> str:
    """An element's name with the names of its class, id and role."""
    if not rest:
        return name
    names = sorted({w for groups in _NAMED.findall(rest) for w in _NAMES.findall("".join(groups).lower())})
    return name + "".join(f".{w}" for w in names)


class Walk:
    """Open elements of a page, by the rules that browsers close them with."""

    def __init__(self):
        self.names: list[str] = []
        self.labels: list[str] = []
        self.paths: list[str] = [""]

    def open(self, name: str, rest: str) -> str:
        if (group := SIBLINGS.get(name)) is not None or name in BLOCKS:
            for k in range(len(self.names) - 1, -1, -1):
                own = self.names[k]
                if own == "p" and name in BLOCKS or group and SIBLINGS.get(own) == group:
                    self._cut(k)
                    break
                if own in BARRIERS:
                    break
        shown = label(name, rest)
        if name not in VOID and not rest.endswith("/"):
            self.names.append(name)
            self.labels.append(shown)
            self.paths.append(f"{self.paths[-1]}/{shown}")
        return shown

    def close(self, name: str) -> None:
        for k in range(len(self.names) - 1, -1, -1):
            if self.names[k] == name:
                self._cut(k)
                return

    def _cut(self, k: int) -> None:
        del self.names[k:], self.labels[k:], self.paths[k + 1 :]


def aside(names: list[str]) -> bool:
    """Whether the names of class, id and role say that an element holds no text of the page's own."""
    words = [frozenset(_WORD.findall(n)) for n in names]
    if any(not ASIDE_WORDS.isdisjoint(w) for w in words):
        return True
    return any(not WEAK_ASIDE_WORDS.isdisjoint(w) for w in words) and all(w <= WEAK_ASIDE_WORDS | NEUTRAL_WORDS for w in words)


@functools.lru_cache(100_000)
def skipped(path: str) -> bool:
    """Whether a path runs through an element that never holds the page's own text."""
    within = False
    for step in path.split("/")[1:]:
        name, *names = step.split(".")
        if name in SKIPPED and not (name == "header" and within):
            return True
        within |= name == "article"
        if name not in ("html", "body", "article", "main") and aside(names):
            return True
    return False


@functools.lru_cache(100_000)
def in_article(path: str) -> bool:
    return any(s.split(".")[0] in ("article", "main") for s in path.split("/")[1:])


# ---------------------------------------------------------------- wrappers

Items = tuple  # of str (a tag or "#"), ("+", Items) or ("?", Items)


def folded(stream: list) -> Items:
    """The stream with repeated neighbouring blocks written as ("+", block)."""
    seq, changed = list(stream), True
    while changed:
        changed = False
        for size in range(1, min(LONGEST_BLOCK, len(seq) // 2) + 1):
            out, i, n = [], 0, len(seq)
            while i < n:
                block = seq[i : i + size]
                j = i + size
                while seq[j : j + size] == block and j + size <= n:
                    j += size
                if j > i + size:
                    only = block[0] if size == 1 and isinstance(block[0], tuple) and block[0][0] == "+" else ("+", tuple(block))
                    out.append(only)
                    i, changed = j, True
                    continue
                out.append(seq[i])
                i += 1
            seq = out
        k = 0
        while k < len(seq):  # x x+ and x+ x are x+
            if isinstance(seq[k], tuple) and seq[k][0] == "+":
                body, size = list(seq[k][1]), len(seq[k][1])
                if seq[k + 1 : k + 1 + size] == body:
                    del seq[k + 1 : k + 1 + size]
                    changed = True
                    continue
                if k >= size and seq[k - size : k] == body:
                    del seq[k - size : k]
                    k, changed = k - size, True
                    continue
            k += 1
    return tuple(seq)


def _bare(item):
    return item[1] if isinstance(item, tuple) else (item,)


def _tags(item) -> frozenset:
    """The tags and slots that an item may read."""
    return frozenset((item,)) if isinstance(item, str) else frozenset().union(*map(_tags, item[1]))


def _first(item) -> str:
    return item if isinstance(item, str) else _first(item[1][0])


def _loose(items) -> tuple:
    """The least regular group that reads any sequence of the items' tags: every one optional, all repeated."""
    return ("+", tuple(("?", (t,)) for t in sorted(frozenset().union(*map(_tags, items)))))


def _is_loose(item) -> bool:
    return isinstance(item, tuple) and item[0] == "+" and all(isinstance(i, tuple) and i[0] == "?" and len(i[1]) == 1 and isinstance(i[1][0], str) for i in item[1])


def _same(a, b) -> bool:
    """Whether two items can share a place in a wrapper."""
    if a == b:
        return True
    if isinstance(a, str) and isinstance(b, str):
        return False
    if _bare(a) == _bare(b):
        return True
    if _is_loose(a):
        return _tags(b) <= _tags(a)
    if _is_loose(b):
        return _tags(a) <= _tags(b)
    return isinstance(a, tuple) and isinstance(b, tuple) and _first(a) == _first(b)


def _joined(a, b):
    """The item that reads what either of two items of one place reads."""
    if a == b:
        return a
    if _is_loose(a) or _is_loose(b):
        return _loose((a, b))
    kinds = {x[0] for x in (a, b) if isinstance(x, tuple)}
    inner = _bare(a) if _bare(a) == _bare(b) else aligned(_bare(a), _bare(b))
    if kinds == {"+", "?"}:
        return ("?", (("+", inner),))
    return (kinds.pop(), inner)


def _optional(items: list) -> list:
    """A run of items that some pages lack, as one optional group."""
    if not items or all(isinstance(x, tuple) and x[0] == "?" for x in items):
        return items
    return [("?", tuple(items))]


def _grouped(seq: Items, other: Items) -> Items:
    """Runs that a group of the other side reads, written as that group."""
    for kind, body in {i for i in other if isinstance(i, tuple)}:
        size, out, i = len(body), [], 0
        while i < len(seq):
            if tuple(seq[i : i + size]) == body:
                out.append((kind, body))
                i += size
            else:
                out.append(seq[i])
                i += 1
        seq = tuple(out)
    return seq


def _size(items) -> int:
    return sum(1 if isinstance(i, str) else 1 + _size(i[1]) for i in items)


def aligned(a: Items, b: Items) -> Items:
    """A wrapper that reads what either of two wrappers reads.

    Mismatches between shared places become optional groups; a stretch whose
    alignment would pass ``WIDEST`` items is written as one loose group instead.
    """
    if a == b:
        return a
    a, b = _grouped(a, b), _grouped(b, a)
    head = 0
    while head < min(len(a), len(b)) and _same(a[head], b[head]):
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and _same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    middle: list = []
    if len(x) * len(y) > ALIGN_CELLS:
        middle = [_loose((*x, *y))]
    elif x or y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if _same(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        left: list = []
        right: list = []
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and _same(x[i], y[j]):
                middle += [*_optional(left), *_optional(right), _joined(x[i], y[j])]
                left, right, i, j = [], [], i + 1, j + 1
            elif j >= len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
                left.append(x[i])
                i += 1
            else:
                right.append(y[j])
                j += 1
        middle += [*_optional(left), *_optional(right)]
        if _size(middle) > WIDEST:
            middle = [_loose(middle)]
    before = [_joined(p, q) for p, q in zip(a[:head], b[:head], strict=True)]
    after = [_joined(p, q) for p, q in zip(a[len(a) - tail :], b[len(b) - tail :], strict=True)]
    return folded([*before, *middle, *after])


def written(items: Items) -> str:
    """A wrapper as a regular expression over tags and slots."""
    return "".join(f"({written(i[1])}){i[0]}" if isinstance(i, tuple) else "#" if i == "#" else f"<{i}>" for i in items)


def _plain(items):
    return [[i[0], _plain(i[1])] if isinstance(i, tuple) else i for i in items]


def _items(plain) -> Items:
    return tuple((i[0], _items(i[1])) if isinstance(i, list) else i for i in plain)


class Reader:
    """A wrapper as an automaton over tags and slots, made deterministic step by step where pages need it.

    Its positions are the tags and slots of the wrapper in order; a state is the
    set of positions that the last symbol may have filled.
    """

    def __init__(self, items: Items):
        self.symbols: list[str] = []
        self.after: list[set[int]] = []
        _, first, _ = self._sequence(items)
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.start = frozenset(first)

    def _sequence(self, items: Items) -> tuple[bool, set[int], set[int]]:
        """Whether the items may read nothing, and the positions that may come first and last."""
        empty, first, last = True, set(), set()
        for item in items:
            if isinstance(item, str):
                at = len(self.symbols)
                self.symbols.append(item)
                self.after.append(set())
                none, begins, ends = False, {at}, {at}
            else:
                none, begins, ends = self._sequence(item[1])
                if item[0] == "+":
                    for p in ends:
                        self.after[p] |= begins
                none = none or item[0] == "?"
            for p in last:
                self.after[p] |= begins
            if empty:
                first |= begins
            last = last | ends if none else ends
            empty = empty and none
        return empty, first, last

    def _state(self, positions: frozenset) -> int:
        if positions not in self.states:
            self.states[positions] = len(self.sets)
            self.sets.append(positions)
        return self.states[positions]

    def read(self, state: int, symbol: str) -> tuple[int, int]:
        """The next state (-1 before the first symbol) and the least position filled; -1 where the wrapper has no place."""
        got = self.steps.get((state, symbol))
        if got is None:
            if len(self.steps) >= STEPS_HELD:
                held = self.sets[state] if state >= 0 else None
                self.states, self.sets, self.steps = {}, [], {}
                state = -1 if held is None else self._state(held)
            open_ = self.start if state < 0 else frozenset().union(*(self.after[p] for p in self.sets[state]))
            filled = frozenset(p for p in open_ if self.symbols[p] == symbol)
            got = (self._state(filled), min(filled)) if filled else (state, -1)
            self.steps[state, symbol] = got
        return got


def reader(items: str | None, held: dict = {}) -> Reader:  # noqa: B006 - a memo per process
    """The automaton of a wrapper as ``infer`` writes it."""
    got = held.get(items)
    if got is None:
        if len(held) >= READERS_HELD:
            held.clear()
        got = held[items] = Reader(_items(json.loads(items)) if items else ())
    return got


def stream_of(page: str) -> list[str]:
    """A page's tags and slots; neighbouring texts are one slot."""
    walk, stream = Walk(), []
    for kind, name, rest in tokens(page):
        if kind == "text":
            if stream[-1:] != ["#"] and not rest.isspace():
                stream.append("#")
        elif kind == "open":
            stream.append(walk.open(name, rest))
        else:
            walk.close(name)
            stream.append("/" + name)
    return stream


def slots_of(page: str, by: Reader) -> Iterator[tuple[str, str, str, str]]:
    """(kind, name, path, text) of a page's tokens in order; kind is "slot N" for a text that fills slot N of the wrapper."""
    walk, state, kind_now = Walk(), -1, None
    for kind, name, rest in tokens(page):
        if kind == "text":
            if kind_now is None and not rest.isspace():
                state, at = by.read(state, "#")
                kind_now = f"slot {at}"
            yield kind_now or "space", "", walk.paths[-1], rest
        else:
            if kind == "open":
                shown = walk.open(name, rest)
            else:
                walk.close(name)
                shown = "/" + name
            state, _ = by.read(state, shown)
            kind_now = None
            yield kind, name, "", ""


def _check(text: str) -> int:
    return zlib.crc32(text.strip().encode("utf-8", "replace"))


def slot_checks(page: str, by: Reader) -> tuple[dict[str, set[int]], int]:
    """Checksums of the texts of each slot and path outside articles, and a digest of all texts."""
    slots, whole = {}, xxhash.xxh3_64()
    for kind, _, path, text in slots_of(page, by):
        if kind.startswith("slot") and not skipped(path) and not text.isspace():
            check, key = _check(text), f"{kind}{path}"
            if not in_article(path):
                slots.setdefault(key, set()).add(check)
            whole.update(f"{key}\0{check}\0".encode("utf-8", "replace"))
    return slots, whole.intdigest()


def _seen(a: list | None, b: list) -> list:
    """Checksums that all pages with a slot hold, and the least digests of different ones of these pages, as many as a template needs."""
    if a is None:
        return [sorted(b[0]), b[1]]
    pages = a[1] if b[1] == a[1] else sorted({*a[1], *b[1]})[:TEMPLATE_PAGES]
    return [[c for c in a[0] if c in b[0]], pages]


def _text_of(value) -> str:
    return "" if value is None else value


def by_host(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the host of the address."""
    at = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select("page_id", "url", "html", at.alias("host"))


def _merged(first: DataFrame, merge, schema: str) -> DataFrame:
    """Rows of tasks merged by host and salt, then by host."""
    once = first.groupBy("host", (F.spark_partition_id() % SALTS).alias("salt")).applyInPandas(merge, schema)
    return once.groupBy("host").applyInPandas(merge, schema)


def infer(pages: DataFrame) -> DataFrame:
    """host, n_pages, the wrapper as a regular expression, and as ``items`` for :func:`reader`."""

    def local(batches):
        held: dict[str, list] = {}

        def flush():
            rows = [(h, n, json.dumps(_plain(w), ensure_ascii=False)) for h, (w, n, _) in held.items()]
            held.clear()
            if rows:
                h, n, w = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n, pa.int64()), pa.nulls(len(h), pa.string()), pa.array(w)], names=["host", "n_pages", "wrapper", "items"])

        for batch in batches:
            for at, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                stream = stream_of(_text_of(page))
                kept = held.setdefault(at, [None, 0, set()])
                key = hash(tuple(stream))
                if key not in kept[2]:
                    shape = folded(stream)
                    kept[0] = shape if kept[0] is None else aligned(kept[0], shape)
                    if len(kept[2]) < 10_000:
                        kept[2].add(key)
                kept[1] += 1
            if len(held) > HOSTS_HELD:
                yield from flush()
        yield from flush()

    def merge(key, rows):
        import pandas as pd

        whole = None
        for items in sorted(set(rows["items"])):
            new = _items(json.loads(items))
            whole = new if whole is None else aligned(whole, new)
        return pd.DataFrame({"host": [key[0]], "n_pages": [int(rows["n_pages"].sum())], "wrapper": [written(whole)], "items": [json.dumps(_plain(whole), ensure_ascii=False)]})

    schema = "host string, n_pages long, wrapper string, items string"
    return _merged(by_host(pages).select("host", "html").mapInArrow(local, schema), merge, schema)


def template_slots(read: DataFrame) -> DataFrame:
    """host and the template texts of its slots, from pages (host, html, items) without an article."""

    def local(batches):
        held: dict[str, dict] = {}

        def flush():
            rows = [(h, json.dumps(s, ensure_ascii=False)) for h, s in held.items()]
            held.clear()
            if rows:
                h, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(s)], names=["host", "slots"])

        for batch in batches:
            for at, page, items in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "items")), strict=True):
                slots, digest = slot_checks(_text_of(page), reader(items))
                kept = held.setdefault(at, {})
                for key, checks in slots.items():
                    kept[key] = _seen(kept.get(key), [checks, [digest]])
            if len(held) > HOSTS_HELD:
                yield from flush()
        yield from flush()

    def merge(key, rows):
        import pandas as pd

        slots: dict = {}
        for found in rows["slots"]:
            for at, seen in json.loads(found).items():
                slots[at] = _seen(slots.get(at), seen)
        return pd.DataFrame({"host": [key[0]], "slots": [json.dumps(slots, ensure_ascii=False)]})

    def fixed(batches):
        for batch in batches:
            got = [sorted(f"{k}\0{c}" for k, (checks, pages) in json.loads(s).items() if len(pages) >= TEMPLATE_PAGES for c in checks) for s in batch.column("slots").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(got, pa.list_(pa.string()))], names=["host", "template"])

    schema = "host string, slots string"
    other = read.where(~F.coalesce("html", F.lit("")).rlike(r"(?i)<(article|main)[\s/>]"))
    return _merged(other.select("host", "html", "items").mapInArrow(local, schema), merge, schema).mapInArrow(fixed, "host string, template array<string>")


def main_text(page: str, by: Reader | None = None, template: frozenset = frozenset()) -> str:
    """The page's own text: its blocks, white space folded, joined by empty lines."""
    inner: list[str] = []
    outer: list[str] = []
    parts: list[str] = []
    where = inner

    def flush():
        nonlocal parts
        if parts:
            block = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if block:
                where.append(block)
            parts = []

    for kind, name, path, text in slots_of(page, by or reader(None)):
        if name:
            if name in BLOCKS:
                flush()
            elif name == "br":
                parts.append(" ")
        elif not skipped(path):
            target = inner if in_article(path) else outer
            if target is not where:
                flush()
                where = target
            if target is inner or not template or f"{kind}{path}\0{_check(text)}" not in template:
                parts.append(text)
    flush()
    return "\n\n".join(inner or outer)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    The tables of wrappers and template slots are written once and broadcast if
    they are small by measure; otherwise pages are joined with them by host,
    where Spark splits skewed hosts.
    """
    wrappers = table(infer(pages).select("host", "items"))
    sized = lambda df, c: F.broadcast(df) if (df.agg(F.sum(F.octet_length(F.to_json(F.struct("host", c))))).first()[0] or 0) <= BROADCAST_BYTES else df
    read = by_host(pages).join(sized(wrappers, "items"), "host", "left")
    fixed = table(template_slots(read).where(F.size("template") > 0))
    joined = read.join(sized(fixed, "template"), "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def make():
        def one(batch):
            got = []
            for page, items, slots in zip(*(batch.column(c).to_pylist() for c in ("html", "items", "template")), strict=True):
                got.append(main_text(_text_of(page), reader(items), frozenset(slots or ())))
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return one

    return per_batch(joined.select("page_id", "url", "html", "items", "template"), make, f"page_id {kind}, url string, text string, n_chars long")
