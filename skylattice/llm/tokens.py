"""Tokenizing whole texts inside tasks, fast enough for a corpus.

Texts repeat their words, so a slice of texts is cut into pieces with array operations, each distinct piece goes through
the tokenizer once, and ids are gathered back. Texts with anything unusual (rare scripts, combining marks, special
strings) go to the tokenizer whole. Both ways give the ids that the library gives.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa

from .common import code_points, distinct_spans, expand

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Distinct pieces, and their letters, that a worker remembers before it starts afresh: about 90 MB.
MEMO_PIECES, MEMO_LETTERS = 400_000, 12_000_000


class Memo:
    """Values of fixed or varying length by piece, kept by a worker between slices and tasks. Pieces are told apart by
    their letters, not by a hash."""

    def __init__(self, limit: int = MEMO_PIECES, letters: int = MEMO_LETTERS):
        self.limit, self.letters = limit, letters
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = self.held = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def slots(self, points: np.ndarray, begin: np.ndarray, end: np.ndarray, make) -> np.ndarray:
        """The slot of each piece, a span of code points; make(piece) gives the values of one that is new."""
        first, back = distinct_spans(points, begin, end)
        text = points.tobytes().decode("utf-32-le", "surrogatepass")
        pieces = [text[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.at) + len(pieces) > self.limit or self.held > self.letters:
            self.clear()
        get = self.at.get
        slot = np.array([get(p, -1) for p in pieces], np.int64)
        new = np.flatnonzero(slot < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            values = [make(p) for p in fresh]
            size = np.fromiter(map(len, values), np.int64, len(values))
            flat = np.array([x for v in values for x in v], np.uint32)
            base = len(self.at)
            self.flat = _grow(self.flat, self.used + len(flat))
            self.start, self.size = _grow(self.start, base + len(new)), _grow(self.size, base + len(new))
            self.flat[self.used : self.used + len(flat)] = flat
            self.start[base : base + len(new)] = self.used + np.cumsum(size) - size
            self.size[base : base + len(new)] = size
            self.used += len(flat)
            self.held += sum(map(len, fresh))
            slot[new] = base + np.arange(len(new))
            self.at.update(zip(fresh, slot[new].tolist(), strict=True))
        return slot[back]


def _grow(x: np.ndarray, n: int) -> np.ndarray:
    if n <= len(x):
        return x
    out = np.zeros(max(n, 2 * len(x)), x.dtype)
    out[: len(x)] = x
    return out


# ---------------------------------------------------------------- word-end BPE of the tokenizers library

#: Blocks whose letters, case and composition don't depend on the Unicode version.
PLAIN_BLOCKS = ((0x20, 0x52F), (0x2010, 0x205E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))
#: Code points with the property White_Space below U+0530, and some of those above.
WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0)
GAP, LETTER, NUMBER, OTHER, ODD = 0, 1, 2, 3, 4


@lru_cache(1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(0x110001, ODD, np.uint8), np.arange(0x110001, dtype=np.uint32)
    for low, high in PLAIN_BLOCKS:
        for c in range(low, high + 1):
            s = chr(c)
            if unicodedata.category(s) in ("Cn", "Cc", "Cs", "Co", "Zs", "Zl", "Zp") or unicodedata.combining(s):
                continue
            small = s.lower()
            if unicodedata.normalize("NFC", s) != s or len(small) != 1 or unicodedata.normalize("NFC", small) != small:
                continue
            kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(s)[0], OTHER)
            lower[c] = ord(small)
    kind[list(WHITE)] = GAP
    return kind, lower


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


class WordIds:
    """Ids of texts by a byte-level BPE with word ends, as Tokenizer.encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.memo = Memo()
        self.special = sorted(x.content for x in self.tokenizer.get_added_tokens_decoder().values())

    def _piece(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offsets of each; a null text has none."""
        points, at = code_points(texts)
        kinds, lowers = _classes()
        kind = kinds[points]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(at, np.flatnonzero(kind == ODD), "right") - 1] = True
        if len(points):
            whole = points.tobytes().decode("utf-32-le")
            for mark in self.special:
                i = whole.find(mark)
                while i >= 0:
                    odd[np.searchsorted(at, i, "right") - 1] = True
                    i = whole.find(mark, i + 1)
        if odd.any():  # those are emptied here and get their ids from the library below
            kind = kind.copy()
            kind[expand(at[:-1][odd], np.diff(at)[odd])] = GAP
        begin, end = self._pieces(points, at, kind)
        count = np.diff(np.searchsorted(begin, at))
        small = lowers[points]
        letters, ids_of = byte_letters(), self._piece

        def make(piece: str) -> list[int]:
            return ids_of(piece if piece.isascii() else "".join([letters[b] for b in piece.encode("utf-8")]))

        slot = self.memo.slots(small, begin, end, make) if len(begin) else np.zeros(0, np.int64)
        size = self.memo.size[slot]
        out = self.memo.flat[expand(self.memo.start[slot], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        starts = total[np.concatenate([[0], np.cumsum(count)])]
        if not odd.any():
            return out, starts
        parts, n = [], np.diff(starts)
        for i in range(len(texts)):
            parts.append(self._whole(texts[i].as_py()) if odd[i] else out[starts[i] : starts[i + 1]])
            n[i] = len(parts[-1])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])

    @staticmethod
    def _pieces(points: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letter runs, single digits, runs of other signs, and the English contractions."""
        n = len(points)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = np.zeros(n + 3, bool)
        first[at] = True
        change = np.ones(n, bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        change |= first[:n]
        begin = change & (kind != GAP)
        quote = np.flatnonzero((points == 39) & begin)
        if len(quote):
            low = np.concatenate([_classes()[1][points], np.zeros(3, np.uint32)])
            a, b = low[quote + 1], low[quote + 2]
            inside1, inside2 = ~first[quote + 1], ~first[quote + 1] & ~first[quote + 2]
            two = inside2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
            one = inside1 & np.isin(a, [115, 116, 109, 100])
            begin[quote[one | two] + 1] = False
            after = np.where(two, 3, 2) + quote
            ok = (one | two) & (after < n)
            ok[ok] = kind[after[ok]] != GAP
            begin[after[ok]] = True
        start = np.flatnonzero(begin)
        stop = np.append(start[1:], n)
        # a piece ends at the next one, the next gap or the next text
        breaks = np.flatnonzero((kind == GAP) | (first[:n]))
        follow = np.append(breaks, n)[np.searchsorted(breaks, start, "right")]
        return start, np.minimum(stop, follow)


@lru_cache(4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


# ---------------------------------------------------------------- counting merges of a piece vocabulary

MARK = 0x2581


def _small(c: str) -> int:
    return 1023 if ord(c) == MARK else ord(c) if ord(c) < 1023 else 0


class MergeCounter:
    """How many ids a BPE vocabulary with byte fallback gives, by merging alone: no ids are made."""

    def __init__(self, path: str):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        for i in range(library.get_piece_size()):
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i)):
                self.rank[library.id_to_piece(i)] = -library.get_score(i)
        if any(chr(MARK) in p.lstrip(chr(MARK)) for p in self.rank):
            raise ValueError("a piece spans words: texts can't be counted word by word")
        self.known = {p for p in self.rank if len(p) == 1}
        near = np.zeros((1024, 1024), bool)
        for p in self.rank:
            for a, b in zip(p, p[1:]):  # noqa: B905
                near[_small(a), _small(b)] = True
        near[0], near[:, 0] = True, True  # of all other characters nothing is known: no cut there
        self.near = near.ravel()
        self.memo = Memo()

    def count(self, piece: str) -> int:
        """Pops the lowest-rank adjacent pair from a heap, leftmost first, until none is left.

        Symbols are linked by their places: `after[i]` is where the symbol at i ends and the next begins, 0 once it is
        merged away; `before[i]` is where the symbol to its left begins. A popped pair is stale when either symbol has
        changed since. The count is the symbols at first minus the merges; a lone character outside the vocabulary
        stands for its UTF-8 bytes.
        """
        rank = self.rank.get
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, i, j, k = heappop(heap)
            if after[i] != j or after[j] != k:
                continue
            after[i], after[j] = k, 0
            before[k] = i
            merges += 1
            if k < n and (r := rank(piece[i : after[k]])) is not None:
                heappush(heap, (r, i, k, after[k]))
            h = before[i]
            if h >= 0 and (r := rank(piece[h:k])) is not None:
                heappush(heap, (r, h, i, k))
        count = n - merges
        if not self.known.issuperset(piece):
            count += sum(len(piece[i].encode("utf-8")) - 1 for i in range(n) if after[i] == i + 1 and piece[i] not in self.known)
        return count

    def counts(self, texts: pa.Array) -> np.ndarray:
        points, at = code_points(texts)
        return self._counts(points, at)

    def _counts(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        size = np.diff(at)
        full = size > 0
        # each text gets a mark before it; spaces are marks
        lead = at[:-1][full]
        points = np.where(points == 32, np.uint32(MARK), points)
        marked = np.insert(points, lead, MARK)
        marks = marked == MARK
        # no symbol can hold two neighbours that no piece has side by side, so texts are cut there
        code = np.where(marked < 1023, marked, np.uint32(0))
        code[marks] = 1023
        begin = np.ones(len(marked), bool)
        begin[1:] = ~self.near[code[:-1] * np.uint32(1024) + code[1:]]
        begin[lead + np.arange(len(lead))] = True
        start = np.flatnonzero(begin)
        end = np.append(start[1:], len(marked))
        out = np.zeros(len(size), np.int64)
        if not len(start):
            return out
        slot = self.memo.slots(marked, start, end, lambda piece: (self.count(piece),))
        value = self.memo.flat[self.memo.start[slot]].astype(np.int64)
        first = np.searchsorted(start, lead + np.arange(len(lead)))
        out[full] = np.add.reduceat(value, first)
        return out


@lru_cache(4)
def merge_counter(path: str) -> MergeCounter:
    return MergeCounter(path)
