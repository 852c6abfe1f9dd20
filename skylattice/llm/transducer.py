"""BPE encoding by a streaming transducer with bounded lookahead, and decoding by an incremental byte-to-text machine.

The merge list itself says how far ahead a text can matter. Whether the rule (u, v) joins a place depends on what stands to
the right only if a token at the right edge of v, while v is still being built, can be taken away by an earlier rule (s, w);
whether that one applies depends again on the right edge of w, under rules that are earlier still. Ranks fall along such a
chain, so the longest one is found rule by rule in the order of the list. A token that ends further from the end of what has
been read than this lookahead can't change any more and is emitted; what follows is encoded as if the text began there, which
is exact where every rule joins tokens that earlier rules make.
"""

from __future__ import annotations

import codecs
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import fresh, text_slices, tidy
from .tokens import WordIds, byte_letters

#: Symbols of a word that are read at a time, and ids that are decoded at a time.
STEP, DECODE_STEP = 4096, 1 << 16
#: Letters of a text that are encoded at a time; it is cut where two words are apart.
TEXT_STEP = 1 << 20


class _Reach:
    """The furthest reach of a token's rules below a rank; rules come in order of rank."""

    def __init__(self) -> None:
        self.ranks: list[int] = []
        self.most: list[int] = []

    def add(self, rank: int, reach: int) -> None:
        self.ranks.append(rank)
        self.most.append(max(reach, self.most[-1] if self.most else 0))

    def below(self, rank: int) -> int:
        k = bisect_left(self.ranks, rank)
        return self.most[k - 1] if k else 0


class MergeList:
    """The rules of a byte-level BPE with word ends, in order of rank, and how far ahead they reach."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.made = {a + b: r for r, (a, b) in enumerate(self.rules)}
        if len(self.made) < len(self.rules) or any(self.made.get(x, -1) >= r for r, rule in enumerate(self.rules) for x in rule):
            raise ValueError("a rule joins tokens that no earlier rule makes, or two make the same: such a list can't be streamed")
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in enumerate(self.rules)}
        self.joined = [vocab[a + b] for a, b in self.rules]
        self.inner = {c: vocab[c] for c in byte_letters()}
        self.last = {c: vocab[c + end] for c in byte_letters()}
        self.lookahead = self._lookahead(end)

    def _lookahead(self, end: str) -> int:
        """Symbols to the right of a place that can decide whether a rule joins it."""
        size = {x: len(x.removesuffix(end) if end else x) for x in {*self.made, *(y for rule in self.rules for y in rule)}}
        by_left: dict[str, _Reach] = {}
        by_right: dict[str, _Reach] = {}
        reach: list[int] = []
        none = _Reach()
        for r, (u, v) in enumerate(self.rules):
            far = reach[self.made[u]] - size[v] if u in self.made else 0
            token, until = v, r  # the right edge of v while v is built: tokens that an earlier rule can take away
            while True:
                far = max(far, by_left.get(token, none).below(until))
                if token not in self.made:
                    break
                until = self.made[token]
                far = max(far, reach[until])
                token = self.rules[until][1]
            token, until = u, r  # the left edge of u: what takes it away may itself depend on the right
            while True:
                far = max(far, by_right.get(token, none).below(until) - (size[u] - size[token]) - size[v])
                if token not in self.made:
                    break
                until = self.made[token]
                token = self.rules[until][0]
            reach.append(far)
            by_left.setdefault(u, _Reach()).add(r, size[v] + far)
            by_right.setdefault(v, _Reach()).add(r, far)
        return max((size[v] + far for (_, v), far in zip(self.rules, reach, strict=True)), default=0)

    def merged(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """The tokens of these symbols and where each ends: the lowest rank first, of equal ones the leftmost."""
        n, rank, joined = len(symbols), self.rank.get, self.joined
        token, after, before = [*symbols, -1], list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, token[i], token[i + 1]) for i in range(n - 1) if (r := rank((token[i], token[i + 1]))) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            if token[i] != a:
                continue
            j = after[i]
            if token[j] != b:
                continue
            k = after[i] = after[j]
            token[i], token[j] = joined[r], -1
            before[k] = i
            if k < n and (r := rank((token[i], token[k]))) is not None:
                heappush(heap, (r, i, token[i], token[k]))
            h = before[i]
            if h >= 0 and (r := rank((token[h], token[i]))) is not None:
                heappush(heap, (r, h, token[h], token[i]))
        kept = [i for i in range(n) if token[i] >= 0]
        return [token[i] for i in kept], [after[i] for i in kept]

    def symbols(self, word: str) -> Iterator[int]:
        """A word's symbols; word: one letter for each byte."""
        inner = self.inner
        for c in islice(word, len(word) - 1):
            yield inner[c]
        yield self.last[word[-1]]

    def stream(self, symbols: Iterable[int], step: int = STEP) -> Iterator[list[int]]:
        """Tokens as soon as they are stable; no more than step + lookahead symbols are held, and those of a token."""
        source, held = iter(symbols), []
        while True:
            read = list(islice(source, step))
            held += read
            tokens, ends = self.merged(held)
            if len(read) < step:
                yield tokens
                return
            stable = bisect_left(ends, len(held) - self.lookahead + 1)
            if stable:
                yield tokens[:stable]
                held = held[ends[stable - 1] :]

    def ids(self, word: str) -> list[int]:
        if len(word) <= STEP:
            return self.merged(list(self.symbols(word)))[0]
        return [x for some in self.stream(self.symbols(word)) for x in some]


class StreamingIds(WordIds):
    """Ids of texts as Tokenizer.encode(text, add_special_tokens=False) gives them, merged by the transducer.

    Texts of the usual scripts are cut into words with array operations. Of others the library's normalizer and splitter
    give the words, and special strings are taken out before; the merges are the transducer's in either case.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.merges = MergeList(path)
        found = {x.content: i for i, x in self.tokenizer.get_added_tokens_decoder().items()}
        self.special_ids = found
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None

    def _piece(self, letters: str) -> list[int]:
        return self.merges.ids(letters)

    def _whole(self, text: str) -> np.ndarray:
        out: list[int] = []
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special_ids:
                out.append(self.special_ids[part])
            elif part:
                for word, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    out += self.merges.ids(word)
        return np.array(out, np.uint32)


@lru_cache(2)
def streaming_ids(path: str) -> StreamingIds:
    return StreamingIds(path)


def _windows(text: str, step: int = TEXT_STEP) -> Iterator[str]:
    """A text in windows of about `step` letters, cut after a space that stands between two ASCII letters: no word, special
    string or composed letter crosses such a place."""
    at = 0
    cut = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
    while len(text) - at > step and (m := cut.search(text, at + step)):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array of int) and n_tokens (long) instead of `text`.

    A null text counts as empty and has no ids. Repeated rows give repeated results, an empty table an empty one. A very
    long text is read in windows between words and a very long word in steps, so beyond the text and its ids a task holds
    no more for it. Of columns named like the new ones the new ones stay. Each row stands alone: no shuffle, and a lost task
    is run again.
    """
    kept = [c for c in docs.columns if c != text and c.lower() not in (ids.lower(), "n_tokens")]
    hold = fresh(docs, "_text")
    source = docs.select(*kept, docs[text].alias(hold))

    def run(batches):
        encoder = streaming_ids(tokenizer)
        for batch in text_slices(batches, hold):
            texts = batch.column(hold)
            if batch.num_rows == 1 and len(long := texts[0].as_py() or "") > TEXT_STEP:
                flat = np.concatenate([encoder.ids(pa.array([part]))[0] for part in _windows(long)])
                at = np.array([0, len(flat)])
            else:
                flat, at = encoder.ids(texts)
            found = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], found, pa.array(np.diff(at))], names=[*kept, ids, "n_tokens"])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.select(*kept).dtypes], f"`{ids}` array<int>", "n_tokens long"])
    return source.mapInArrow(tidy(run), schema)


class TextMachine:
    """Turns ids into text piece by piece: bytes go into an incremental UTF-8 decoder, which keeps the start of a letter
    until its last byte comes; malformed bytes become U+FFFD.

    form "library": tokens as the library's decode(ids, skip_special_tokens=False) shows them, whose file names no decoder:
    a letter for each byte and the word-end mark, with one space between tokens. form "text": the bytes that the letters
    stand for, and a space after each word.
    """

    def __init__(self, path: str, form: str = "library"):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if data.get("decoder") is not None and form == "library":
            raise ValueError("the tokenizer names a decoder of its own")
        end = data["model"].get("end_of_word_suffix") or ""
        special = {x["content"] for x in data["added_tokens"]}
        names = {i: t for t, i in data["model"]["vocab"].items()} | {x["id"]: x["content"] for x in data["added_tokens"]}
        byte = {c: bytes([b]) for b, c in enumerate(byte_letters())}

        def shown(token: str) -> bytes:
            if form == "library":
                return b" " + token.encode("utf-8")
            if token in special:
                return token.encode("utf-8") + b" "
            word = bool(end) and token.endswith(end)
            return b"".join([byte[c] for c in token.removesuffix(end if word else "")]) + b" " * word

        self.bytes = [shown(names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.lead = form == "library"

    def feed(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """The text of lists of ids, list by list; no more than one list and a part of a letter is held."""
        utf8, own, lead = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes, self.lead
        for some in ids:
            raw = b"".join([own[i] for i in some])
            if lead and raw:  # a space stands between tokens, not before the first
                raw, lead = raw[1:], False
            yield utf8.decode(raw)
        yield utf8.decode(b"", True)


@lru_cache(2)
def text_machine(path: str, form: str) -> TextMachine:
    return TextMachine(path, form)


def decode(rows: DataFrame, tokenizer: str, *, ids: str = "ids", text: str = "text", form: str = "library") -> DataFrame:
    """rows with `text`, decoded from the array `ids`; form: see TextMachine.

    Null or empty ids give an empty text, ids that the vocabulary doesn't have are an error. Repeated rows give repeated
    results, an empty table an empty one; a very long list is decoded in steps. A column of rows named `text` is replaced.
    """
    kept = [c for c in rows.columns if c.lower() != text.lower()]

    def run(batches):
        machine = text_machine(tokenizer, form)
        for batch in batches:
            column = batch.column(ids)
            flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            at = at - at[0]
            out = ["".join(machine.feed(flat[i : min(i + DECODE_STEP, b)].tolist() for i in range(a, b, DECODE_STEP))) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(out, pa.string())], names=[*kept, text])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*kept).dtypes], f"`{text}` string"])
    return rows.mapInArrow(tidy(run), schema)
