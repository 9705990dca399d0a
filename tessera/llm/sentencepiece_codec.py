"""SentencePiece encoding and decoding with a score-ordered agenda.

A merge-type vocabulary gives every piece a score.  Encoding starts from single
characters and repeatedly joins the adjacent pair whose joined piece has the
best score (leftmost on ties).  The candidate pairs form an agenda ordered by
score: for short strings a matrix with one row for each of many strings, whose
best entries are joined in step by numpy; for long ones a heap.  Characters
outside the vocabulary become byte pieces.

No piece of the vocabulary holds the space mark after another character, so a
text can be cut before every run of marks and each part be encoded alone; parts
repeat a lot and are kept in a bounded memo.  Every part that the memo lacks is
encoded by the agenda and, a block of an Arrow batch at a time, checked against
the sentencepiece library; should they differ, the library's ids hold and
``n_corrected`` counts it.

Defined results: null and empty texts have no ids and decode to the empty text;
null ids are kept; repeated rows are encoded each on their own; other columns
are kept by :func:`encode` and :func:`decode`, whose output column replaces one
of the same name.  Whole texts are encoded; a text of any length works in
memory proportional to itself.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import TwoGenerationCache, claim, per_batch, texts

MARK = "▁"
NONE = np.int32(2**31 - 1)
#: Parts that each of a memo's two generations holds, and the longest part that is remembered.
MEMO_PARTS, MEMO_CHARS = 400_000, 256
#: Bytes of text whose parts are learnt together, the longest part for the matrix agenda, and symbols in one matrix.
BLOCK_BYTES = 2_000_000
SHORT = 48
MATRIX_SYMBOLS = 400_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Agenda encoder and decoder for one model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = lib.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_ids: list[int | None] = [None] * 256
        self.shown: list[bytes] = []
        scored = []
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                b = int(_BYTE.fullmatch(piece)[1], 16)
                self.byte_ids[b] = i
                self.shown.append(bytes([b]))
            elif lib.is_control(i):
                self.shown.append(b"")
            elif lib.is_unknown(i):
                self.shown.append(" ⁇ ".encode())
            else:
                self.ids[piece] = i
                self.shown.append(piece.replace(MARK, " ").encode())
                if not lib.is_unused(i):
                    scored.append((-lib.get_score(i), i, piece))
        scored.sort()
        self.rank: dict[str, int] = {}
        place, last = -1, None
        for score, _, piece in scored:
            place += score != last
            last = score
            self.rank[piece] = place
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("the vocabulary has pieces across word starts")
        self.unknown = lib.unk_id()
        self.id_text = [b"%d" % i for i in range(n)]
        self._pair_tables()
        self.plain = lib.normalize("  ﬁ a  b ") == "  ﬁ a  b ".replace(" ", MARK).join([MARK, ""])
        self.memo = TwoGenerationCache(MEMO_PARTS)

    def _pair_tables(self) -> None:
        """Joined piece and rank of every pair of symbols that makes a piece, behind a flat hash table."""
        self.symbol = {c: i for c, i in self.ids.items() if len(c) == 1}
        for p in self.ids:
            for c in p:
                if c not in self.symbol:
                    self.symbol[c] = len(self.shown) + len(self.symbol)
        self.other = 2 * len(self.shown) + len(self.symbol)
        known = {**self.symbol, **self.ids}
        pairs = {}
        for p, r in self.rank.items():
            for k in range(1, len(p)):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (r, self.ids[p])
        self.keys = np.array(sorted(pairs) or [-1], dtype=np.int64)
        found = [pairs.get(k, (0, 0)) for k in self.keys.tolist()]
        self.key_rank = np.array([f[0] for f in found], dtype=np.int32)
        self.key_piece = np.array([f[1] for f in found], dtype=np.int64)
        slots = self._slot(self.keys)
        self.first = np.zeros(1 << 20, dtype=np.int32)
        self.first[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        self.shared = np.bincount(slots, minlength=1 << 20) > 1

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and joined piece of pairs of symbols."""
        keys = (left << 32) | right
        slots = self._slot(keys)
        at = self.first[slots]
        hit = self.keys[at] == keys
        if len(again := np.flatnonzero(self.shared[slots] & ~hit)):
            there = np.minimum(np.searchsorted(self.keys, keys[again]), len(self.keys) - 1)
            at[again] = there
            hit[again] = self.keys[there] == keys[again]
        return np.where(hit, self.key_rank[at], NONE), self.key_piece[at]

    def matrix_agenda(self, parts: list[str]) -> list[list[int]]:
        """Ids of many parts of like length: each step joins the best pair of every row that has one."""
        if not parts:
            return []
        n, width = len(parts), 1 + max(map(len, parts))
        get, other = self.symbol.get, self.other
        sizes = np.array([1 + len(p) for p in parts])
        symbols = np.full((n, width), -1, dtype=np.int64)
        inside = np.arange(width) < sizes[:, None]
        symbols[inside] = [get(c, other) for p in parts for c in MARK + p]
        rank = np.full((n, width), NONE, dtype=np.int32)
        piece = np.zeros((n, width), dtype=np.int64)
        both = np.flatnonzero(inside[:, 1:].ravel())
        row, col = np.divmod(both, max(1, width - 1))
        rank[row, col], piece[row, col] = self._pairs(symbols[row, col], symbols[row, col + 1])
        spans = np.where(inside, 1, 0)
        live = np.arange(n)
        while len(live):
            best = rank[live].argmin(axis=1)
            open_ = rank[live, best] < NONE
            live, best = live[open_], best[open_]
            if not len(live):
                break
            shift = np.arange(width - 1)[None] + (np.arange(width - 1)[None] > best[:, None])
            joined, weight = piece[live, best], spans[live, best] + spans[live, best + 1]
            for table, last in ((symbols, -1), (rank, NONE), (piece, 0), (spans, 0)):
                rows = table[live]
                rows[:, :-1] = np.take_along_axis(rows, shift, axis=1)
                rows[:, -1] = last
                table[live] = rows
            symbols[live, best], spans[live, best] = joined, weight
            after = symbols[live, np.minimum(best + 1, width - 1)]
            there = (after >= 0) & (best + 1 < width)
            rank[live, best] = NONE
            if there.any():
                r, c = live[there], best[there]
                rank[r, c], piece[r, c] = self._pairs(symbols[r, c], symbols[r, c + 1])
            there = best > 0
            if there.any():
                r, c = live[there], best[there] - 1
                rank[r, c], piece[r, c] = self._pairs(symbols[r, c], symbols[r, c + 1])
        out = []
        limit = len(self.shown)
        for p, ids, size in zip(parts, symbols.tolist(), spans.tolist(), strict=True):
            k = size.index(0) if 0 in size else len(size)
            ids = ids[:k]
            if max(ids) >= limit:
                at, spelled, text = 0, [], MARK + p
                for i, s in zip(ids, size, strict=False):
                    if i < limit:
                        spelled.append(i)
                    else:
                        b = [self.byte_ids[x] for x in text[at : at + s].encode()]
                        spelled.extend([self.unknown] if None in b else b)
                    at += s
                ids = spelled
            out.append(ids)
        return out

    def parts(self, text: str) -> list[str]:
        """The text cut before every run of marks; each part is without its first mark."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK) if self.plain else self.library.normalize(text)
        if not marked:
            return []
        if marked.find(MARK + MARK) < 0:
            return marked.split(MARK)[1:]
        return [p[1:] for p in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def agenda(self, part: str) -> list[int]:
        """Ids of one part (given without its first mark)."""
        symbols = [MARK, *part]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            if (r := rank(p := symbols[i] + symbols[i + 1])) is not None:
                heap.append((r, i, p))
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            left = symbols[i]
            if left is None or (j := after[i]) >= n or left + symbols[j] != p:
                continue
            symbols[i], symbols[j] = p, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(q := p + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, q))
            if (h := before[i]) >= 0 and (r := rank(q := symbols[h] + p)) is not None:
                heapq.heappush(heap, (r, h, q))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                spelled = [self.byte_ids[b] for b in s.encode()]
                out.extend([self.unknown] if None in spelled else spelled)
        return out

    def learn(self, new: set[str]) -> tuple[dict[str, bytes | tuple], int]:
        """Encode new parts, check them against the library in one call and keep them; also counts corrections.

        A part is kept as its ids in decimals, and if these don't decode to the part itself, with what they show.
        """
        sized: dict[int, list[str]] = {}
        for p in new:
            sized.setdefault(len(p) // 4 if len(p) < SHORT else -1, []).append(p)
        new, made = [], []
        for size, parts in sized.items():
            new += parts
            step = len(parts) if size < 0 else MATRIX_SYMBOLS // (4 * size + 5)
            for at in range(0, len(parts), step):
                some = parts[at : at + step]
                made += [self.agenda(p) for p in some] if size < 0 else self.matrix_agenda(some)
        wrong = 0
        if self.plain:
            checked = self.library.encode([p.replace(MARK, " ") for p in new], num_threads=1)
            if checked != made:
                differ = [k for k, p in enumerate(new) if p and checked[k] != made[k]]
                wrong = len(differ)
                for k in differ:
                    made[k] = checked[k]
        shown, id_text, put, out = self.shown, self.id_text, self.memo.put, {}
        for p, ids in zip(new, made, strict=True):
            out[p] = f = b",".join([id_text[i] for i in ids])
            if (whole := b"".join([shown[i] for i in ids])) != (MARK + p).replace(MARK, " ").encode():
                out[p] = f = (f, whole)
            if len(p) <= MEMO_CHARS:
                put(p, f)
        return out, wrong

    def encoded(self, many: list[str]):
        """Per text the ids of its parts, in decimals, and the corrections made for it."""
        return ((found, wrong) for found, _, wrong in self.shown_too(many))

    def shown_too(self, many: list[str]):
        """Per text the ids of its parts, in decimals, the bytes that they decode to, and the corrections made for it.

        Texts are taken in blocks of about BLOCK_BYTES, whose new parts are learnt together.
        """
        block, size = [], 0
        for t in many:
            block.append(t)
            size += len(t)
            if size >= BLOCK_BYTES:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[str]):
        cut = [self.parts(t) for t in block]
        young, old = self.memo.young, self.memo.old
        found = [list(map(young.get, parts)) for parts in cut]
        here: dict[str, bytes | tuple] = {}
        lacking = {p for parts, f in zip(cut, found, strict=True) if None in f for p, x in zip(parts, f, strict=True) if x is None}
        for p in [p for p in lacking if p in old]:
            here[p] = old[p]
        lacking.difference_update(here)
        for p, f in here.items():
            self.memo.put(p, f)
        wrong = 0
        if lacking:
            new, wrong = self.learn(lacking)
            here.update(new)
        for parts, f in zip(cut, found, strict=True):
            if None in f:
                f = [here[p] if x is None else x for p, x in zip(parts, f, strict=True)]
            if tuple in set(map(type, f)):
                whole = b"".join([x[1] if type(x) is tuple else (MARK + p).replace(MARK, " ").encode() for p, x in zip(parts, f, strict=True)])
                f = [x[0] if type(x) is tuple else x for x in f]
            else:
                whole = (MARK + MARK.join(parts)).replace(MARK, " ").encode() if parts else b""
            yield f, whole[1:] if whole[:1] == b" " else whole, wrong
            wrong = 0

    def encoded_parts(self, text: str) -> tuple[list[bytes], int]:
        return next(self.encoded([text]))

    def encode(self, text: str) -> tuple[list[int], int]:
        found, wrong = self.encoded_parts(text)
        return _ids(found), wrong

    def decode(self, ids) -> str:
        """The text of ids: marks become spaces, byte pieces join to characters, the first mark goes."""
        shown = b"".join([self.shown[i] for i in ids])
        try:
            text = shown.decode()
        except UnicodeDecodeError:
            return self.library.decode(list(ids))
        return text[1:] if text[:1] == " " else text


def _ids(found: list[bytes]) -> list[int]:
    return list(map(int, b",".join(found).split(b","))) if found else []


def _codec(model_path: str, memo_parts: int = MEMO_PARTS, held: dict = {}) -> Codec:  # noqa: B006 - one codec per worker process
    if model_path not in held:
        held.clear()
        held[model_path] = Codec(model_path)
    if held[model_path].memo.size != memo_parts:
        held[model_path].memo = TwoGenerationCache(memo_parts)
    claim("codec", held.clear)
    return held[model_path]


def _with(df: DataFrame, column: str, kind: str, f, source: str) -> DataFrame:
    from pyspark.sql import types as T

    kept = [c for c in df.schema.fields if c.name != column]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"{column} {kind}").fields])

    def make():
        def one(batch):
            cols = [batch.column(c.name) for c in kept]
            return pa.RecordBatch.from_arrays([*cols, f(batch.column(source))], names=[*(c.name for c in kept), column])

        return one

    return per_batch(df, make, schema, owner="codec")


def encode(df: DataFrame, text: str = "text", out: str = "ids", check: str | None = None, model_path: str | None = None, memo_parts: int = MEMO_PARTS) -> DataFrame:
    """Add the ids of every whole text as an array column; ``check`` names a column for whether they decode to it.

    ``memo_parts`` bounds how many parts a worker remembers: memory against time, the ids are the same.
    """
    from pyspark.sql import types as T

    path = model_path or default_model()
    kept = [c for c in df.schema.fields if c.name not in (out, check)]
    added = f"{out} array<int>" + (f", {check} boolean" if check else "")
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])

    def make():
        codec = _codec(path, memo_parts)

        def one(batch):
            given = texts(batch.column(text))
            ids, same = [], []
            for t, (found, shown, _) in zip(given, codec.shown_too(given), strict=True):
                ids.append(np.array(_ids(found), dtype=np.int32))
                if check:
                    same.append(shown == t.replace(MARK, " ").encode())
            cols = [*(batch.column(c.name) for c in kept), pa.array(ids, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(same)] if check else cols, names=[f.name for f in schema])

        return one

    return per_batch(df, make, schema, owner="codec")


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str | None = None) -> DataFrame:
    """Add the text of every array of ids; null arrays decode to the empty text."""
    path = model_path or default_model()
    return _with(df, out, "string", lambda c: pa.array([_codec(path).decode(i or []) for i in c.to_pylist()], pa.string()), ids)


def roundtrip_digests(df: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document: ids and decoded text as digests, made from the same parts as :func:`encode`.

    Nothing but the digests leaves the Python worker, so the ids of a corpus are
    never moved between processes for the sake of a digest.
    """
    path = model_path or default_model()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_corrected"]

    def make():
        codec = _codec(path)

        def one(batch):
            rows = []
            for found, shown, wrong in codec.shown_too(texts(batch.column("text"))):
                joined = b",".join(found)
                rows.append((joined.count(b",") + 1 if found else 0, hashlib.sha256(joined).hexdigest(), hashlib.sha256(shown).hexdigest(), wrong))
            n, a, b, w = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b), pa.array(w, pa.int64())], names=names)

        return one

    kind = df.schema["doc_id"].dataType.simpleString()
    return per_batch(df.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long", owner="codec")
