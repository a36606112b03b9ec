"""BPE encoding and decoding as streaming transducers.

The encoder reads a text piece by piece and holds a bounded buffer. How far the
text to the right can still change a token is a property of the merge list, the
sufficient lookahead: tokens that end at least that many symbols before the end
of what has been read are stable and are emitted. The decoder is a state
machine from ids to text that holds at most an unfinished character.

Reads tokenizer files of the kind: NFC, white space to one space, lower case;
a splitting expression whose matches are the words; byte-level symbols; merges
by rank, with a suffix on the last symbol of a word. Special tokens found in
the raw text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import codecs
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from machinepulse.llm.common import bounded_batches

_PIECE = 1 << 16
_CACHE = 150_000
_NEVER = 1 << 60


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Tokens:
    """The tokens of a tokenizer file by id."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = spec["model"]["vocab"]
        self.tokens = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self._prepare(spec, ids)

    def _prepare(self, spec: dict, ids: dict[str, int]) -> None:
        """What encoding needs beside the tokens."""

    @staticmethod
    def _check(spec: dict) -> None:
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        steps = spec["pre_tokenizer"]["pretokenizers"]
        model = spec["model"]
        if (
            kinds != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in steps] != ["Split", "ByteLevel"]
            or steps[0]["behavior"] != "Removed"
            or not steps[0]["invert"]
            or steps[1]["add_prefix_space"]
            or steps[1]["use_regex"]
            or model["type"] != "BPE"
            or not model["end_of_word_suffix"]
            or spec["decoder"] is not None
        ):
            raise ValueError("a tokenizer file of another kind")


class Vocabulary(Tokens):
    """Merges, ids and the sufficient lookahead of one tokenizer file."""

    def _prepare(self, spec: dict, ids: dict[str, int]) -> None:
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(split)
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = (
            regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        )
        characters = byte_characters()
        self.inner = [ids[c] for c in characters]
        self.final = [ids[c + self.suffix] for c in characters]
        self.ranks = {(ids[a], ids[b]): rank for rank, (a, b) in enumerate(merges)}
        self.by_rank = [ids[a + b] for a, b in merges]
        if len(set(self.by_rank)) != len(merges):
            # The order of merging and the lookahead rest on this.
            raise ValueError("two merges of the file make the same token")
        self.lookahead = self._sufficient_lookahead(ids, merges)

    def _sufficient_lookahead(self, ids: dict[str, int], merges: list[tuple[str, str]]) -> int:
        """Symbols after which the text to the right cannot change a token any more.

        Compare two words that begin alike, merging in order of rank. Their
        states agree left of a frontier, at first the end of the common part.
        A merge (e, x) moves it left over e if x begins at the frontier in one
        word only. After it has moved over c, what begins there begins with c,
        so the next merge to move it is an (e, x) of later rank where x begins
        with c. The longest such chain, in symbols, is the furthest it gets;
        one more symbol is needed because the last one of a word differs.
        """
        size = {t: len(t.removesuffix(self.suffix)) for t in ids}
        reach: dict[str, int] = {}  # by left part of a merge seen so far
        furthest = 0
        for left, right in merges:
            before = max((reach.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
            moved = size[left] + before
            reach[left] = max(reach.get(left, 0), moved)
            furthest = max(furthest, moved)
        return furthest + 1

    def merge(self, parts: list[int]) -> list[int]:
        """Apply the merges by rank, equal ranks from the left."""
        if len(parts) > 48:
            return self._merge_long(parts)
        get, results = self.ranks.get, self.by_rank
        ranks = [get(pair, _NEVER) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NEVER:
                break
            i = ranks.index(best)
            parts[i] = results[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), _NEVER)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs and linked neighbours, for long buffers."""
        ranks, results, n = self.ranks, self.by_rank, len(parts)
        parts, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks
        ]
        heapify(heap)
        while heap:
            rank, i, pair = heappop(heap)
            j = after[i] if parts[i] >= 0 else n
            if j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = results[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for left, right in ((before[i], i), (i, k)):
                if left >= 0 and right < n:
                    made = (parts[left], parts[right])
                    if made in ranks:
                        heappush(heap, (ranks[made], left, made))
        return [p for p in parts if p >= 0]

    def word(self, word: str) -> list[int]:
        """Ids of one whole word of bounded length."""
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.final[raw[-1]]
        return self.merge(parts)


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class OpenWord:
    """A word of unknown length: symbols in, stable tokens out, bounded buffer."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.raw = bytearray()
        self.limit = max(512, 4 * vocab.lookahead)

    def feed(self, piece: str) -> Iterator[list[int]]:
        data = piece.encode("utf-8")
        at = 0
        while at < len(data):
            taken = self.limit - len(self.raw)
            self.raw += data[at : at + taken]
            at += taken
            if len(self.raw) >= self.limit:
                yield self._stable()

    def _stable(self) -> list[int]:
        vocab, end, out = self.vocab, 0, []
        sure = len(self.raw) - vocab.lookahead
        for token in vocab.merge([vocab.inner[b] for b in self.raw]):
            size = len(vocab.tokens[token])
            if end + size > sure:
                break
            end += size
            out.append(token)
        # Tokens that follow a stable one are those of the rest by itself,
        # because tokens stand side by side only if they would in their own.
        del self.raw[:end]
        return out

    def finish(self) -> list[int]:
        if not self.raw:
            return []
        parts = [self.vocab.inner[b] for b in self.raw]
        parts[-1] = self.vocab.final[self.raw[-1]]
        return self.vocab.merge(parts)


class Encoder:
    """Text to ids, packed as little-endian unsigned 32-bit integers.

    Memory beside the text is bounded: a piece of the text, a cache of words
    with a fixed number of entries, and the buffer of an open word.
    """

    def __init__(self, vocab: Vocabulary, piece: int = _PIECE) -> None:
        self.vocab = vocab
        self.piece = piece
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> Iterator[bytes]:
        at = 0
        if self.vocab.special_pattern:
            for match in self.vocab.special_pattern.finditer(text):
                yield from self._segment(text, at, match.start())
                yield struct.pack("<I", self.vocab.special[match.group()])
                at = match.end()
        yield from self._segment(text, at, len(text))

    def _segment(self, text: str, at: int, end: int) -> Iterator[bytes]:
        while at < end:
            cut = end
            if end - at > self.piece:
                cut = max(text.rfind(c, at + 1, at + self.piece) for c in " \n")
                if cut < 0:
                    # No white space in a whole piece: words may be longer than it.
                    stop = _next_space(text, at, end)
                    yield from self._unbroken(text, at, stop)
                    at = stop
                    continue
            yield self._words(self.vocab.words.findall(_normal(text[at:cut])))
            at = cut

    def _words(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) > _CACHE:
            known.clear()
        out = []
        for word in words:
            packed = known.get(word)
            if packed is None:
                ids = self.vocab.word(word)
                packed = struct.pack(f"<{len(ids)}I", *ids)
                if len(word) <= 64:
                    known[word] = packed
            out.append(packed)
        return b"".join(out)

    def _unbroken(self, text: str, at: int, end: int) -> Iterator[bytes]:
        """A stretch without white space, longer than a piece."""
        vocab, carry, open_word, kind = self.vocab, "", None, None
        while at < end:
            cut = _safe_cut(text, min(at + self.piece, end), end)
            data = carry + _normal(text[at:cut])
            at, carry, start = cut, "", 0
            if open_word:
                run = kind.match(data)
                start = run.end() if run else 0
                for ids in open_word.feed(data[:start]):
                    yield _packed(ids)
                if start == len(data) and at < end:
                    continue
                yield _packed(open_word.finish())
                open_word = None
            found = [m.span() for m in vocab.words.finditer(data, start)]
            if at < end and found:
                # The last word may go on; a lone apostrophe before it may belong to it.
                keep = len(found) - 1
                if keep and data[slice(*found[keep - 1])] == "'":
                    keep -= 1
                first, last = found[keep][0], found[-1]
                if keep == len(found) - 1 and last[1] - last[0] > 4096:
                    run = data[slice(*last)]
                    kind = _LETTERS if _LETTERS.match(run) else _OTHERS
                    open_word = OpenWord(vocab)
                else:
                    carry = data[first:]
                yield self._words([data[a:b] for a, b in found[:keep]])
                if open_word:
                    for ids in open_word.feed(data[slice(*last)]):
                        yield _packed(ids)
                continue
            yield self._words([data[a:b] for a, b in found])
        if open_word:
            yield _packed(open_word.finish())


_LETTERS = regex.compile(r"[\p{L}]+")
_OTHERS = regex.compile(r"[^\s\p{L}\p{N}]+")
_SPACE = regex.compile(r"[ \n]")
_SPACES = regex.compile(r"\s+")


def _normal(text: str) -> str:
    """NFC, white space to one space, lower case letter by letter (no final sigma)."""
    composed = unicodedata.normalize("NFC", text)
    return _SPACES.sub(" ", composed).replace("Σ", "σ").lower()


def _next_space(text: str, at: int, end: int) -> int:
    found = _SPACE.search(text, at + 1, end)
    return found.start() if found else end


def _safe_cut(text: str, at: int, end: int) -> int:
    """The first place from at on where no composition can cross.

    Marks and the Korean vowel and final letters compose with what is before
    them; a stretch of nothing else stays in one piece.
    """
    while at < end and (
        unicodedata.category(text[at])[0] == "M" or 0x1161 <= ord(text[at]) <= 0x11C2
    ):
        at += 1
    return at


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """Ids to text, piece by piece.

    plain=False gives what the library's decode gives for a file without
    decoder: the token strings with a space between them. plain=True turns
    symbols back into bytes, word ends into spaces, and bytes into characters;
    the state is the unfinished character.
    """

    def __init__(self, vocab: Tokens, plain: bool = False) -> None:
        self.plain = plain
        self.restart()
        if plain:
            place = {c: b for b, c in enumerate(byte_characters())}
            special = set(vocab.special.values())
            self.table = {
                i: (t + " ").encode()
                if i in special
                else bytes(place[c] for c in t.removesuffix(vocab.suffix))
                + b" " * t.endswith(vocab.suffix)
                for i, t in vocab.tokens.items()
            }
        else:
            self.table = vocab.tokens

    def restart(self) -> None:
        """Forget the text so far."""
        self.started = False
        self.text = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        table = self.table
        if self.plain:
            return self.text.decode(b"".join([table[i] for i in ids]))
        if not ids:
            return ""
        joined = " ".join([table[i] for i in ids])
        joined, self.started = (" " + joined if self.started else joined), True
        return joined

    def finish(self) -> str:
        return self.text.decode(b"", True) if self.plain else ""


def encode(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> DataFrame:
    """docs with a binary column name: ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids. A column called name is replaced. The
    file at path must be readable at that path on every executor.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Of one task: what a cache of words saves, the next task earns again, and
        # a worker that goes on to other work does not carry it along.
        encoder = Encoder(vocabulary(path))
        for batch in batches:
            yield pd.Series([b"".join(encoder.encode(t)) if t else b"" for t in batch], dtype=object)

    return docs.withColumn(name, ids(F.col(text)))


def decode(
    docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded", plain: bool = False
) -> DataFrame:
    """docs with a string column name, the text of the packed ids; null ids count as none."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Decoder(Tokens(path), plain)
        for batch in batches:
            out = []
            for packed in batch:
                machine.restart()
                numbers = np.frombuffer(packed or b"", "<u4")
                pieces = [
                    machine.feed(numbers[i : i + _PIECE].tolist())
                    for i in range(0, len(numbers), _PIECE)
                ]
                out.append("".join([*pieces, machine.finish()]))
            yield pd.Series(out, dtype=object)

    return docs.withColumn(name, decoded(F.col(ids)))
