"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns of four kinds (email, ip, card, phone) give the base spans.  A
conditional random field over word shapes then reads the words and adds spans
of the same kinds that the patterns miss (local phone numbers, addresses with a
spelled-out at sign, colon-separated hosts).  Words of letters alone carry no
personal data of these kinds: the field holds them to the tag ``O``, so the
chain falls apart into independent runs between them without changing the best
path, and the runs of a whole Arrow batch are decoded together, padded to a
common length, by one numpy Viterbi pass.

The field is trained from a small labelled table: by default one made by a rule
from templates with a fixed seed, or any DataFrame of (tokens array<string>,
tags array<string>).

Defined results: null and empty texts have no spans; offsets count code points,
end exclusive; a base span always stays and an added span never overlaps one;
whole texts are read in time proportional to their length.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, texts

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *KINDS)
Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match begins where a run of digits does, so a run is tried once and not from each of its digits.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[Span]:
    """Every at sign belongs to at most one address, whose local part is the run before it."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            out.append((begin, free, "email"))
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d)
        if place % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, sorted by start and kind."""
    out = _emails(text)
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() > 11:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    out.sort(key=_order)
    return out


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


# ---------------------------------------------------------------- the field

#: Words that may stand before personal data.
CUES = frozenset("tel phone call fax mobile card visa ip host server mail email contact".split())
#: The field reads the words with a digit, an at sign or a bracketed at.
_MARK = re.compile(r"[0-9@]|[\[(]at[\])]")
_SPACES = frozenset(" \t\n\x0b\x0c\r")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_EDGE = ".,;:!?%$#&*|\"'<>="
_WORD_BEFORE = re.compile(r"([A-Za-z]+)[.:]?[\x20\x09-\x0D]+$")
_RUNS = ((re.compile(r"[0-9]+"), lambda m: f"9{min(len(m[0]), 20)}"), (re.compile(r"[^\W\d_]+"), lambda m: "a"))


def shape(word: str) -> str:
    """Digit runs with their length, letter runs as one letter, everything else as it is."""
    out = _RUNS[1][0].sub("a", word)
    return _RUNS[0][0].sub(_RUNS[0][1], out)


def features(word: str, cue: str) -> list[str]:
    digits = sum(c.isdigit() for c in word)
    size = "0" if not digits else next((str(n) for n in (2, 4, 6, 8, 11, 15, 19) if digits <= n), "more")
    marks = "".join(sorted({c for c in word if not c.isalnum()}))
    out = [f"shape={shape(word)}", f"digits={size}", f"marks={marks}", f"first={shape(word[:1])}", f"letters={any(c.isalpha() for c in word)}", "bias"]
    if re.search(r"[\[(]at[\])]|@", word):
        out.append("at")
    if cue:
        out.append(f"cue={cue}")
    return out


def labelled_table(seed: int = 7, rows: int = 360) -> list[tuple[list[str], list[str]]]:
    """The default training table, made by a rule: templates with drawn digits and names."""
    draw = np.random.default_rng(seed)
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    name = lambda: "".join(draw.choice(["an", "to", "mi", "re", "lu", "sa"], draw.integers(1, 4)))
    makers = (
        lambda: ([f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"),
        lambda: ([f"{digits(3)}-{digits(3)}-{digits(4)}"], "phone"),
        lambda: ([f"{digits(3)}.{digits(3)}.{digits(4)}"], "phone"),
        lambda: (["+" + digits(2), digits(3), digits(4), digits(3)], "phone"),
        lambda: ([f"{name()}[at]{name()}.example.com"], "email"),
        lambda: ([f"{name()}.{digits(2)}(at){name()}.example.org"], "email"),
        lambda: ([f"{name()}.{digits(2)}@{name()}.example.org"], "email"),
        lambda: ([".".join(str(draw.integers(0, 256)) for _ in range(4))], "ip"),
        lambda: ([":".join(f"{draw.integers(4096, 65536):x}" for _ in range(8))], "ip"),
        lambda: ([digits(4), digits(4), digits(4), digits(4)], "card"),
        lambda: (["-".join(digits(4) for _ in range(4))], "card"),
    )
    plain = (
        lambda: [digits(draw.integers(1, 9))], lambda: [f"{digits(2)}.{digits(2)}"], lambda: [f"20{digits(2)}-{digits(2)}-{digits(2)}"],
        lambda: [f"{digits(2)}:{digits(2)}"], lambda: [f"${digits(2)}.{digits(2)}"], lambda: [f"v{digits(1)}.{digits(1)}.{digits(2)}"],
        lambda: [f"{name()}{digits(2)}"], lambda: [f"{digits(2)}%"], lambda: [f"{name()}@"], lambda: [f"@{name()}{digits(1)}"],
        lambda: [f"{digits(1)}/{digits(1)}"], lambda: [digits(draw.integers(9, 20))], lambda: [f"{digits(16)}{name()}{digits(8)}"], lambda: [digits(2), digits(2)],
        lambda: [f"{digits(1)}-{digits(2)}"], lambda: [digits(3), digits(3)], lambda: [f"{digits(4)}-{digits(4)}"], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}"],
        lambda: [f"{name()}={draw.integers(1 << 40, 1 << 60):x}"], lambda: [f"{draw.integers(1 << 50, 1 << 62):x}"], lambda: [f"{name().upper()}{digits(2)}{name().upper()}{digits(1)}"],
    )
    out = []
    for k in range(rows):
        tokens, tags = [name()], ["O"]
        for _ in range(2):
            if draw.random() < 0.5:
                got, tag = makers[k % len(makers)]()
            else:
                got, tag = plain[draw.integers(len(plain))](), "O"
            if draw.random() < 0.3:
                tokens.append(str(draw.choice(sorted(CUES))) if tag != "O" else name())
                tags.append("O")
            tokens += got
            tags += [tag] * len(got)
            tokens.append(name())
            tags.append("O")
        out.append((tokens, tags))
    return out


class Field:
    """Weights of word features and of neighbouring tags."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, pairs: np.ndarray):
        self.index, self.emit, self.pairs = index, emit, pairs
        self.memo: dict = {}

    def scores(self, word: str, cue: str) -> np.ndarray:
        """Tag scores of one word, kept by those of its features that the field knows."""
        key = tuple([self.index[f] for f in features(word, cue) if f in self.index])
        got = self.memo.get(key)
        if got is None:
            got = self.emit[list(key)].sum(axis=0) if key else np.zeros(len(TAGS))
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[key] = got
        return got

    def viterbi(self, runs: list[list[np.ndarray]]) -> list[list[int]]:
        """Best tags of every run; all runs start after and end before a word tagged O."""
        out: list = [None] * len(runs)
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by_size.setdefault(1 << (len(r) - 1).bit_length(), []).append(i)
        for size, which in by_size.items():
            sizes = np.array([len(runs[i]) for i in which])
            e = np.zeros((len(which), size, len(TAGS)))
            for row, i in enumerate(which):
                e[row, : sizes[row]] = runs[i]
            best = e[:, 0] + self.pairs[0]
            back = np.zeros((len(which), size, len(TAGS)), dtype=np.int8)
            last = best.copy()
            for t in range(1, size):
                ways = best[:, :, None] + self.pairs
                back[:, t] = ways.argmax(axis=1)
                best = ways.max(axis=1) + e[:, t]
                last = np.where((sizes > t)[:, None], best, last)
            tag = (last + self.pairs[:, 0]).argmax(axis=1)
            path = np.zeros((len(which), size), dtype=np.int8)
            rows = np.arange(len(which))
            for t in range(size - 1, -1, -1):
                inside = sizes > t
                path[inside, t] = tag[inside]
                if t:
                    tag = np.where(inside, back[rows, t, tag], tag)
            for row, i in enumerate(which):
                out[i] = path[row, : sizes[row]].tolist()
        return out


def _plain(word: str) -> bool:
    return _MARK.search(word) is None


def train(table=None, steps: int = 150, rate: float = 0.1, decay: float = 0.01) -> Field:
    """Fit the field by gradient ascent of the conditional log likelihood (forward-backward in numpy)."""
    table = labelled_table() if table is None else [(list(r[0]), list(r[1])) for r in (table.collect() if isinstance(table, DataFrame) else table)]
    index: dict[str, int] = {}
    rows = []
    for tokens, tags in table:
        row = []
        for i, (w, tag) in enumerate(zip(tokens, tags, strict=True)):
            cue = tokens[i - 1].strip(".:").lower() if i and tokens[i - 1].strip(".:").lower() in CUES else ""
            row.append((None if _plain(w) else [index.setdefault(f, len(index)) for f in features(w.strip(_EDGE), cue)], TAGS.index(tag)))
        rows.append(row)
    b, t, k = len(rows), max(map(len, rows)), len(TAGS)
    held = np.full((b, t, k), -50.0)
    held[:, :, 0] = 0.0
    gold = np.zeros((b, t), dtype=int)
    live = np.zeros((b, t), dtype=bool)
    at, of = [], []
    for i, row in enumerate(rows):
        for j, (found, tag) in enumerate(row):
            gold[i, j], live[i, j] = tag, True
            if found is not None:
                held[i, j] = 0.0
                at += found
                of += [i * t + j] * len(found)
    at, of = np.array(at), np.array(of)
    emit, pairs = np.zeros((len(index), k)), np.zeros((k, k))
    speed = [np.zeros_like(emit), np.zeros_like(pairs)]
    seen = np.eye(k)[gold]
    both = live[:, 1:]
    gold_pairs = np.einsum("btj,btk->jk", seen[:, :-1] * both[..., None], seen[:, 1:] * both[..., None])
    for step in range(steps):
        e = held.copy().reshape(b * t, k)
        np.add.at(e, of, emit[at])
        e = e.reshape(b, t, k)
        fore, hind = np.zeros((b, t, k)), np.zeros((b, t, k))
        fore[:, 0] = e[:, 0]
        for j in range(1, t):
            fore[:, j] = e[:, j] + np.logaddexp.reduce(fore[:, j - 1][:, :, None] + pairs, axis=1)
        for j in range(t - 2, -1, -1):
            hind[:, j] = np.logaddexp.reduce(pairs + (e[:, j + 1] + hind[:, j + 1])[:, None, :], axis=2)
        whole = np.logaddexp.reduce(fore[:, -1], axis=1)
        one = np.exp(fore + hind - whole[:, None, None])
        two = np.exp(fore[:, :-1, :, None] + pairs + (e[:, 1:] + hind[:, 1:])[:, :, None, :] - whole[:, None, None, None])
        grad = np.zeros_like(emit)
        np.add.at(grad, at, (seen - one).reshape(b * t, k)[of])
        grads = [grad / b - decay * emit, (gold_pairs - (two * both[..., None, None]).sum(axis=(0, 1))) / b - decay * pairs]
        for weight, g, v in zip((emit, pairs), grads, speed, strict=True):
            v *= 0.9
            v += 0.1 * g * g
            weight += rate * g / (np.sqrt(v / (1 - 0.9 ** (step + 1))) + 1e-6)
    return Field(index, emit, pairs)


def _read_words(text: str):
    """Begin and end of every word with a mark, each found from its first mark, so that no character is looked at often."""
    end = 0
    while (m := _MARK.search(text, end)) is not None:
        begin = m.start()
        while begin > end and text[begin - 1] not in _SPACES:
            begin -= 1
        space = _SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        yield begin, end


def _read_runs(text: str) -> list[list[tuple[int, int, str]]]:
    """Runs of neighbouring words that the field reads: (begin, end, cue before)."""
    runs: list = []
    end_before = -1
    for start, stop in _read_words(text):
        word = text[start:stop]
        left = len(word) - len(word.lstrip(_EDGE))
        core = word.strip(_EDGE)
        begin = start + left
        gap = text[end_before:start] if end_before >= 0 and start - end_before < 8 else "x"
        cue = ""
        if gap.strip(" \t\n\x0b\x0c\r"):
            before = _WORD_BEFORE.search(text, max(0, start - 16), start)
            cue = before[1].lower() if before and before[1].lower() in CUES else ""
            runs.append([])
        if not runs:
            runs.append([])
        runs[-1].append((begin, begin + len(core), cue))
        end_before = stop
    return runs


def find(many: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """Per text its base spans and all spans, base and added."""
    base = [base_spans(t) for t in many]
    runs, where = [], []
    for i, text in enumerate(many):
        for run in _read_runs(text):
            runs.append([field.scores(text[b:e], cue) for b, e, cue in run])
            where.append((i, run))
    added: list[list[Span]] = [[] for _ in many]
    for tags, (i, run) in zip(field.viterbi(runs), where, strict=True):
        k = 0
        while k < len(tags):
            n = k + 1
            while n < len(tags) and tags[n] == tags[k]:
                n += 1
            if tags[k] and run[n - 1][1] > run[k][0]:
                added[i].append((run[k][0], run[n - 1][1], TAGS[tags[k]]))
            k = n
    out = []
    for own, more in zip(base, added, strict=True):
        if more:
            reach, k, kept = sorted((s[0], s[1]) for s in own), 0, []
            furthest = 0
            for s in sorted(more):
                while k < len(reach) and reach[k][0] < s[1]:
                    furthest = max(furthest, reach[k][1])
                    k += 1
                if furthest <= s[0]:
                    kept.append(s)
            out.append((own, sorted([*own, *kept], key=_order)))
        else:
            out.append((own, own))
    return out


def shown(spans: list[Span]) -> str:
    return ",".join([f"{k}:{b}:{e}" for b, e, k in spans])


def spans(df: DataFrame, text: str = "text", out: str = "spans", field: Field | None = None) -> DataFrame:
    """Add all spans of every whole text as an array of (begin, end, kind)."""
    from pyspark.sql import types as T

    held = field or train()
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"{out} array<struct<begin:int,end:int,kind:string>>").fields])

    def make():
        def one(batch):
            got = find(texts(batch.column(text)), held)
            col = pa.array([[{"begin": b, "end": e, "kind": k} for b, e, k in every] for _, every in got], pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])))
            return pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), col], names=[*(f.name for f in kept), out])

        return one

    return per_batch(df, make, schema)


def redacted(text: str, every: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    out, at = [], 0
    for b, e, k in every:
        if b >= at:
            out += [text[at:b], f"[{k.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]])


def redact(df: DataFrame, field: Field | None = None) -> DataFrame:
    """Documents with personal data replaced in their texts and n_chars brought up to date; null texts stay null."""
    from pyspark.sql import types as T

    held = field or train()
    names = df.columns
    schema = T.StructType(df.schema.fields)

    def make():
        def one(batch):
            given = batch.column("text").to_pylist()
            new = [redacted(t or "", f[1]) for t, f in zip(given, find([t or "" for t in given], held), strict=True)]
            cols = {n: batch.column(n) for n in names}
            cols["text"] = pa.array([None if t is None else n for t, n in zip(given, new, strict=True)], pa.string())
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(n) for n in new], pa.int64()).cast(cols["n_chars"].type)
            return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

        return one

    return per_batch(df, make, schema)


def span_digests(df: DataFrame, field: Field | None = None) -> DataFrame:
    """Per document the counts of base spans per kind, their digest, and all spans as text."""
    held = field or train()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def make():
        def one(batch):
            rows = []
            for own, every in find(texts(batch.column("text")), held):
                kinds = [s[2] for s in own]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(shown(own).encode()).hexdigest(), shown(every)))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4]), pa.array(cols[5], pa.string())], names=names)

        return one

    kind = df.schema["doc_id"].dataType.simpleString()
    return per_batch(df.select("doc_id", "text"), make, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
