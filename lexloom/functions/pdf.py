"""Text of PDF files: the object table, compressed streams and the text operators, with the standard library.

Read: objects in the file and in object streams, Flate-compressed and plain content, pages in their tree's order, fonts with a
map to Unicode and else the Windows Latin encoding. Not read, and an error: encrypted files, files without pages or without text (scans).
A stream is inflated up to a fixed size, so a small file can't fill a task's memory.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

MOST = 64 << 20  # bytes of an inflated stream
MOST_VALUE = 1 << 20  # bytes of an object but its stream
DEPTH = 50  # of the page tree
SPACES = b"\x00\t\n\x0c\r "
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]+|%[^\r\n]*|(?P<name>/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<text>\()|(?P<word>[^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|.", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Ref(int):
    """The number of another object."""


class Name(str):
    pass


class Word(bytes):
    """An operator or keyword, not a string."""


def literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins behind a bracket, and where it ends."""
    out, deep = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            e = data[at : at + 1]
            octal = re.match(rb"[0-7]{1,3}", data[at : at + 3])
            if octal:
                out.append(int(octal[0], 8) & 255)
                at += len(octal[0])
            else:
                at += 2 if data[at : at + 2] == b"\r\n" else 1
                out += b"" if e in (b"\r", b"\n") else ESCAPES.get(e, e)
            continue
        deep += (c == b"(") - (c == b")")
        if not deep:
            break
        out += c
    return bytes(out), at


def parsed(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values one after the other, with where they end: numbers, names, strings, lists, dictionaries; words are bytes."""
    stack: list[list] = []
    while at < len(data):
        m = TOKEN.match(data, at)
        at = m.end()
        if m["open"]:
            stack.append([m["open"]])
            continue
        if m["close"]:
            if not stack:
                continue
            kind, *items = stack.pop()
            value: object = items
            if kind == b"<<":
                value = {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif m["text"]:
            value, at = literal(data, at)
        elif m["hex"]:
            digits = re.sub(rb"\s", b"", m["hex"][1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m["name"]:
            value = Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m["name"][1:].decode("latin-1")))
        elif m["word"]:
            word = m["word"]
            value = float(word) if b"." in word and re.fullmatch(rb"[+-]?\d*\.\d*", word) and word.strip(b"+-.") else int(word) if re.fullmatch(rb"[+-]?\d+", word) else Word(word)
        else:
            continue
        if stack:
            top = stack[-1]
            if isinstance(value, Word) and value == b"R" and len(top) > 2 and isinstance(top[-1], int) and isinstance(top[-2], int):
                top.pop()
                value = Ref(top.pop())
            top.append(value)
        else:
            yield value, at


def inflated(data: bytes) -> bytes:
    machine = zlib.decompressobj()
    try:
        out = machine.decompress(data, MOST)
    except zlib.error as e:
        raise ValueError(f"a broken stream: {e}") from None
    if machine.unconsumed_tail:
        raise ValueError("a stream is too large")
    return out


class Pdf:
    def __init__(self, data: bytes):
        if not data[:1024].lstrip().startswith(b"%PDF"):
            raise ValueError("not a PDF")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("an encrypted PDF")
        self.data, self.values, self.streams = data, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d+)[ \r\n\t]+\d+[ \r\n\t]+obj\b", data):  # later ones replace earlier ones, as an updated file has it
            for value, end in parsed(data[m.end() : m.end() + MOST_VALUE]):
                self.values[int(m[1])] = value
                head = re.compile(rb"[\s]*stream\r?\n").match(data, m.end() + end)
                if head and isinstance(value, dict):
                    self.streams[int(m[1])] = head.end()
                break
        for n in list(self.streams):
            own = self.values[n]
            if own.get("Type") == "ObjStm":
                body, first = self.stream(n), self.get(own.get("First"))
                numbers = [int(x) for x in body[:first].split()]
                for k, at in zip(numbers[::2], numbers[1::2], strict=False):
                    for value, _ in parsed(body[first + at :]):
                        self.values.setdefault(k, value)
                        break

    def get(self, x, deep: int = 0):
        """A value, through references."""
        while isinstance(x, Ref) and deep < DEPTH:
            x, deep = self.values.get(int(x)), deep + 1
        return x

    def stream(self, n: int) -> bytes:
        own, at = self.values[n], self.streams[n]
        size = self.get(own.get("Length"))
        if not isinstance(size, int) or not re.match(rb"\s*endstream", self.data[at + size : at + size + 20]):
            size = self.data.find(b"endstream", at) - at
            if size < 0:
                raise ValueError("a stream breaks off")
        data = self.data[at : at + size]
        kinds = self.get(own.get("Filter")) or []
        for kind in kinds if isinstance(kinds, list) else [kinds]:
            if self.get(kind) not in ("FlateDecode", "Fl"):
                raise ValueError(f"no reader for {kind}")
            data = inflated(data)
        return data

    def pages(self) -> Iterator[dict]:
        roots = [v for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo = [(self.get(r.get("Pages")), {}, 0) for r in roots[-1:]]
        if not todo:
            todo = [(v, {}, 0) for v in self.values.values() if isinstance(v, dict) and v.get("Type") == "Page"][::-1]
        seen = set()
        while todo:
            node, above, deep = todo.pop()
            if not isinstance(node, dict) or id(node) in seen or deep > DEPTH:
                continue
            seen.add(id(node))
            own = {"Resources": node.get("Resources", above.get("Resources"))}
            if "Kids" in node:
                todo += [(self.get(k), own, deep + 1) for k in (self.get(node["Kids"]) or [])[::-1]]
            else:
                yield node | own

    def fonts(self, page: dict) -> dict[str, dict]:
        """Of each font of a page how to read its strings: bytes a code, and codes to text."""
        out = {}
        held = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        for name, ref in held.items():
            font = self.get(ref) or {}
            cmap = font.get("ToUnicode")
            codes = unicode_map(self.stream(int(cmap))) if isinstance(cmap, Ref) and int(cmap) in self.streams else {}
            out[name] = {"width": 2 if font.get("Subtype") == "Type0" else 1, "codes": codes}
        return out

    def text(self) -> str:
        out = []
        for page in self.pages():
            refs = page.get("Contents")
            refs = refs if isinstance(refs, Ref) and int(refs) in self.streams else self.get(refs)
            parts = [self.stream(int(r)) for r in (refs if isinstance(refs, list) else [refs]) if isinstance(r, Ref) and int(r) in self.streams]
            out.append(shown(b"\n".join(parts), self.fonts(page)))
        if not out:
            raise ValueError("no pages")
        return "\n\n".join(x for x in out if x)


def unicode_map(data: bytes) -> dict[int, str]:
    out, held = {}, []
    of = lambda b: b.decode("utf-16-be", "replace")
    for value, _ in parsed(data):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == b"endbfchar":
            out |= {int.from_bytes(a, "big"): of(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(b, bytes)}
        elif value == b"endbfrange":
            for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                for k in range(lo, min(hi, lo + 0xFFFF) + 1):
                    if isinstance(to, list):
                        out |= {k: of(to[k - lo])} if k - lo < len(to) else {}
                    else:
                        base = of(to)
                        out[k] = base[:-1] + chr(min(ord(base[-1]) + k - lo, 0x10FFFF)) if base else ""
        held = []
    return out


def shown(content: bytes, fonts: dict[str, dict]) -> str:
    """What the text operators of a page show; a move down is a line end, a wide gap a blank."""
    font, held, lines, line, height = {"width": 1, "codes": {}}, [], [], [], None

    def read(s: bytes) -> str:
        if font["width"] == 1 and not font["codes"]:
            return s.decode("cp1252", "replace")
        codes = [int.from_bytes(s[i : i + font["width"]], "big") for i in range(0, len(s), font["width"])]
        plain = (lambda k: bytes([k]).decode("cp1252", "replace")) if font["width"] == 1 else (lambda k: "")
        return "".join(font["codes"].get(k) if k in font["codes"] else plain(k) for k in codes)

    def end() -> None:
        if line:
            lines.append("".join(line))
            line.clear()

    for value, _ in parsed(content):
        if not isinstance(value, Word):
            held.append(value)
            continue
        if value == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2], font) if isinstance(held[-2], str) else font
        elif value in (b"T*", b"ET"):
            end()
        elif value in (b"Td", b"TD") and len(held) > 1 and held[-1]:
            end()
        elif value == b"Tm" and len(held) > 5:
            if height is not None and held[-1] != height:
                end()
            height = held[-1]
        elif value in (b"Tj", b"'", b'"') and held and isinstance(held[-1], bytes):
            if value != b"Tj":
                end()
            line.append(read(held[-1]))
        elif value == b"TJ" and held and isinstance(held[-1], list):
            for x in held[-1]:
                if isinstance(x, bytes):
                    line.append(read(x))
                elif isinstance(x, int | float) and x < -200 and line and not line[-1].endswith(" "):
                    line.append(" ")
        held = []
    end()
    return "\n".join(x.rstrip() for x in lines).strip()


def read(data: bytes) -> str:
    """The text of a PDF's pages, an empty line between them."""
    try:
        text = Pdf(data).text()
    except (AttributeError, TypeError, KeyError, IndexError, OverflowError) as e:  # values of another kind than they should be
        raise ValueError(f"a broken PDF: {e}") from None
    if not text.strip():
        raise ValueError("a PDF without text")
    return text
