"""BPE as a streaming transducer with bounded lookahead, and its decoder.

The transducer reads symbols one by one. For each prefix it knows the last token of that prefix's encoding: the one token
ending there whose pair with the token before it encodes to itself. These tokens form a tree of back pointers. Whatever
follows, the final encoding passes through one of the last positions that a longest token can reach back to, so the tokens
up to the common ancestor of these positions are stable: they are emitted and forgotten.

How much may ever be held back follows from the merge list. Two texts that agree on a prefix can only differ left of its
end through merges, taken in the order of the list; each rule moves the first difference to the left once, by the length
of its right side at most. The sum of these lengths is a sufficient lookahead, so what is held is bounded; in fact stability
comes after a few symbols. Every token comes out of the transducer, and every text out of the decoder, a machine that holds the
bytes of an unfinished character. What they made of a word of up to SHORT symbols is remembered in a table of fixed size, for the next
time it comes. A text is taken in stretches, and a longer word symbol by symbol; beside the row's text nothing is held whole but the longest piece without white space.

Defined results: a null text is empty: no tokens; repeated rows have equal results; strings of special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import regex
import tokenizers
from pyspark.sql import DataFrame

from lexloom.llm.common import per_row

SHORT = 48  # symbols of a word that is remembered
STRETCH = 1 << 16  # code points of a text at a time
STEPS = 400_000  # prefixes of words that are remembered
#: The vocabulary's pattern, its mark for the end of a word, and the white space that its pattern knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
ODD = "\x1c\x1d\x1e\x1f"  # blank to str.split() alone


def byte_marks() -> list[str]:
    """A printable character for each byte: itself if it is one in Latin-1, else the next one from U+0100 on."""
    out, spare = [], 256
    for b in range(256):
        own = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255
        out.append(chr(b if own else spare))
        spare += not own
    return out


class Vocabulary:
    def __init__(self, merges: list[tuple[str, str]], ids: dict[str, int], end: str = END):
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.ids, self.end = ids, end
        self.names = {i: t for t, i in ids.items()}
        byte = {c: b for b, c in enumerate(byte_marks())}
        ended = lambda t: bool(end) and t.endswith(end)
        self.bytes = {i: bytes(byte.get(c, 63) for c in (t[: -len(end)] if ended(t) else t)) + b" " * ended(t) for t, i in ids.items()}
        self.spoken = {i: t.encode() for t, i in ids.items()}
        self.longest = max((len(self.symbols(t)) for t in ids), default=1)
        self.lookahead = sum(len(self.symbols(b)) for _, b in merges) + self.longest
        self.whole: dict[int, bool] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}  # (prefix, symbol) -> last token, prefix: what the transducer found at the beginning of words
        self.size = {i: len(self.symbols(t)) for t, i in ids.items()}
        self.suffixes: dict = {}  # symbol -> the same for the symbol before it; under None the token that these symbols are
        for t, i in ids.items():
            at = self.suffixes
            for x in reversed(self.symbols(t)):
                at = at.setdefault(x, {})
            at[None] = i

    def symbols(self, token: str) -> list[str]:
        """The symbols that a token is made of; the end of a word belongs to its last symbol."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def encode(self, parts: list[str]) -> list[str]:
        """All symbols at once: of the neighbours the pair that stands first in the list is merged, the leftmost first, again and again."""
        rank, none = self.ranks.get, 1 << 60
        parts = list(parts)
        found = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(found):
                found[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def holds(self, a: int, b: int) -> bool:
        """Whether the text of the tokens a and b encodes to a and b; a is -1 at the beginning."""
        key = a << 32 | b
        found = self.whole.get(key)
        if found is None:
            if len(self.whole) > 400_000:
                self.whole.clear()
            x, y = self.names.get(a), self.names[b]
            own = self.symbols(y)
            found = self.whole[key] = self.encode([*self.symbols(x), *own]) == [x, y] if x else self.encode(own) == [y]
        return found


class Transducer:
    """Symbols in, ids of tokens out as soon as nothing that follows can change them."""

    def __init__(self, vocabulary: Vocabulary, every: int = 32):
        self.v, self.every = vocabulary, every
        self.symbols: list[str] = []  # since the last emitted token
        self.last: list[int] = [-1]  # last[i]: last token of the first i symbols
        self.held: str | None = None
        self.most = 0

    def _next(self, symbol: str) -> None:
        """Adds the symbol, and the last token of the prefix that ends with it."""
        symbols, last, whole, holds = self.symbols, self.last, self.v.whole, self.v.holds
        symbols.append(symbol)
        at, i = self.v.suffixes, len(symbols)
        while i:
            i -= 1
            at = at.get(symbols[i])
            if at is None:
                break
            token = at.get(None)
            if token is not None:
                found = whole.get(last[i] << 32 | token)
                if holds(last[i], token) if found is None else found:
                    last.append(token)
                    return
        raise ValueError(f"no token ends with {symbol!r}")

    def word(self, symbols: list[str]) -> list[int]:
        """A whole short word from its beginning. Prefixes that other words had are not found again, but looked up."""
        steps, last, node, end = self.v.steps, self.last, 0, symbols.pop()
        get = steps.get
        for symbol in symbols:
            known = get((node, symbol))
            if known is None:
                break
            last.append(known[0])
            node = known[1]
        n = len(last) - 1
        self.symbols = symbols[:n]
        for symbol in symbols[n:]:
            self._next(symbol)
            if len(steps) < STEPS:
                new = len(steps) + 1
                steps[node, symbol] = last[-1], new
                node = new
            else:
                steps.clear()
                node = -1  # of no word
        self._next(end + self.v.end)
        return self.finish()

    def _upto(self, end: int) -> list[int]:
        out = []
        while end:
            out.append(self.last[end])
            end -= self.v.size[self.last[end]]
        return out[::-1]

    def _stable(self) -> list[int]:
        n = len(self.symbols)
        self.most = max(self.most, n)
        alive = set(range(max(0, n - self.v.longest + 1), n + 1))
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(top - self.v.size[self.last[top]])
        (end,) = alive
        if n - end > self.v.lookahead:
            raise AssertionError("the lookahead was not sufficient")
        out = self._upto(end)
        if end:
            self.symbols, self.last = self.symbols[end:], [-1, *self.last[end + 1 :]]
        return out

    def feed(self, symbols: Iterable[str]) -> list[int]:
        out = []
        for s in symbols:
            if self.held is not None:
                self._next(self.held)
                if len(self.symbols) % self.every == 0:
                    out += self._stable()
            self.held = s
        return out

    def finish(self) -> list[int]:
        """Ends the word."""
        if self.held is not None:
            self._next(self.held + self.v.end)
        out = self._upto(len(self.symbols))
        self.symbols, self.last, self.held = [], [-1], None
        return out


class Decoder:
    """Token by token back to text: a token's bytes go in, and whole characters come out; those of an unfinished one are held.

    named: as a library decodes a vocabulary that comes without a decoder: tokens by their names, with one space between them."""

    def __init__(self, vocabulary: Vocabulary, named: bool = False):
        self.bytes, self.named = (vocabulary.spoken if named else vocabulary.bytes), named
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, token_id: int) -> str:
        return self.feed_all([token_id])

    def feed_all(self, ids: list[int]) -> str:
        data = (b" " if self.named else b"").join([self.bytes.get(i, b"") for i in ids])
        out = self.state.decode(b" " + data if self.named and self.begun and ids else data)
        self.begun = self.begun or bool(ids)
        return out

    def finish(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


class Coder:
    """Whole texts. Pieces between white space are independent: neither normalisation nor a token crosses it."""

    def __init__(self, vocabulary: Vocabulary, most: int = 200_000):
        self.v, self.most, self.marks = vocabulary, most, byte_marks()
        self.pattern, self.blank, self.odd = regex.compile(PATTERN), re.compile(f"[{BLANKS}]+"), re.compile(f"[{ODD}]")
        self.transducer, self.decoder = Transducer(vocabulary), Decoder(vocabulary, named=True)
        self.numbers = {i: str(i) for i in vocabulary.names}
        self.known: dict[str, tuple[int, str, str]] = {}  # by word; new and old: by piece
        self.new: dict[str, tuple[int, str, str]] = {}
        self.old: dict[str, tuple[int, str, str]] = {}

    def words(self, piece: str) -> Iterator[str]:
        if piece.isascii():
            piece = piece.lower()
        elif any([c > "\u0240" and unicodedata.category(c) == "Cn" for c in piece]):  # newer than Python's tables: by the library's
            found = tokenizers.pre_tokenizers.Split(tokenizers.Regex(PATTERN), "removed", invert=True)
            yield from [w for w, _ in found.pre_tokenize_str(tokenizers.normalizers.Sequence([tokenizers.normalizers.NFC(), tokenizers.normalizers.Lowercase()]).normalize_str(piece))]
            return
        else:
            piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()  # letter by letter: no final sigma
        for m in self.pattern.finditer(piece):
            yield m[0]

    def word(self, word: str) -> Iterator[int]:
        """The word's ids, as they become stable."""
        t, marks = self.transducer, self.marks
        for at in range(0, len(word), 1024):
            yield from t.feed("".join([marks[b] for b in word[at : at + 1024].encode("utf-8", "replace")]))
        yield from t.finish()

    def __call__(self, text: str | None) -> list[int]:
        return [i for pieces in self.stretches(text or "") for p in pieces for w in self.words(p) for i in self.word(w)]

    def _said(self, ids: list[int]) -> tuple[int, str, str]:
        """How many ids, the ids, and the text that they decode to."""
        numbers = self.numbers
        return len(ids), " ".join([numbers[i] for i in ids]), self.decoder.feed_all(ids) + self.decoder.finish()

    def _word(self, word: str) -> tuple[int, str, str]:
        """Of a short word."""
        got = self.known.get(word)
        if got is None:
            marks = self.marks
            got = self._said(self.transducer.word([marks[b] for b in word.encode("utf-8", "replace")]))
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[word] = got
        return got

    def _met(self, piece: str) -> tuple:
        """Of a short piece; () of a longer one."""
        if len(piece) > SHORT:
            return ()
        got = self.old.get(piece)
        if got is None:
            each = [self._word(w) for w in (self.pattern.findall(piece.lower()) if piece.isascii() else self.words(piece))]
            got = each[0] if len(each) == 1 else (sum([x[0] for x in each]), " ".join([x[1] for x in each if x[0]]), " ".join([x[2] for x in each if x[0]]))
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[piece] = got
        return got

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The pieces between white space, a stretch of the text at a time."""
        odd, at = bool(self.odd.search(text)), 0
        while at < len(text):
            cut = self.blank.search(text, at + STRETCH)
            part = text[at : cut.start() if cut else len(text)]
            at += len(part) or 1
            yield list(filter(None, self.blank.split(part))) if odd else part.split()

    def _long(self, piece: str) -> Iterator[tuple[int, str, str]]:
        """Of a longer piece, word by word, and of a long word a run of tokens at a time."""
        for w in self.words(piece):
            if len(w) <= SHORT:
                yield self._word(w)
                continue
            ids = self.word(w)
            while some := list(islice(ids, 1024)):
                yield self._said(some)

    def _parts(self, text: str) -> Iterator[list[tuple[int, str, str]]]:
        met = self._met
        for pieces in self.stretches(text):
            for at in range(0, len(pieces), 4096):
                of, some = self.new.get, pieces[at : at + 4096]
                got = [of(p) or met(p) for p in some]
                if () not in got:
                    yield got
                    continue
                for p, x in zip(some, got, strict=True):
                    if x:
                        yield [x]
                    else:
                        yield from ([y] for y in self._long(p))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of tokens; SHA-256 of the ids, and of the text that they decode to."""
        n, ids, decoded, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
        for got in self._parts(text or ""):
            got = [x for x in got if x[0]]
            if got:
                n += sum([x[0] for x in got])
                ids.update(gap + " ".join([x[1] for x in got]).encode())
                decoded.update(gap + " ".join([x[2] for x in got]).encode())
                gap = b" "
        return n, ids.hexdigest(), decoded.hexdigest()


@lru_cache(maxsize=1)
def coder(path: str) -> Coder:
    """Made once a worker, so what one task has met helps the next. Its tables hold no cycles: the collector need not look through them so often."""
    out = Coder(vocabulary(path))
    gc.freeze()
    gc.set_threshold(200_000, 20, 50)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    return Vocabulary([tuple(m) for m in model["merges"]], model["vocab"], model["end_of_word_suffix"] or "")


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256."""
    return per_row(docs, [text_col], [id_col], "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda: coder(path).digests)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids, and the text that they decode to."""

    def make():
        encode = coder(path)

        def both(text):
            ids, decoder = encode(text), Decoder(encode.v)
            return ids, "".join([*map(decoder.feed, ids)]) + decoder.finish()

        return both

    return per_row(docs, [text_col], [id_col], "ids array<int>, decoded string", make)
