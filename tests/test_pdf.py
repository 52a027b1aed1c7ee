"""PDFs made here, read back."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.functions import pdf


def made(pages, packed=True, fonts="<< /F1 << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> >>", more=(), objects=False):
    """A file whose pages have these content streams."""
    n = len(pages)
    bodies = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Count {n} /Kids [{' '.join(f'{3 + 2 * i} 0 R' for i in range(n))}] /Resources << /Font {fonts} >> >>".encode()}
    streams = {}
    for i, content in enumerate(pages):
        bodies[3 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode()
        streams[4 + 2 * i] = content
    streams |= dict(more)
    out = b"%PDF-1.7\n%\xe2\xe3\n"
    if objects:  # dictionaries in an object stream
        order = list(bodies)
        parts, at, head = b"", 0, []
        for k in order:
            head.append(f"{k} {len(parts)}")
            parts += bodies[k] + b"\n"
        table = (" ".join(head) + "\n").encode()
        data = zlib.compress(table + parts)
        out += f"900 0 obj\n<< /Type /ObjStm /N {len(order)} /First {len(table)} /Filter /FlateDecode /Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    else:
        for k, body in bodies.items():
            out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    for k, content in streams.items():
        data = zlib.compress(content) if packed else content
        out += f"{k} 0 obj\n<< {'/Filter /FlateDecode ' if packed else ''}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def quoted(text):
    return b"(" + text.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def page(lines):
    return b"BT /F1 12 Tf 72 700 Td " + b" ".join(quoted(x) + b" Tj 0 -14 Td" for x in lines) + b" ET"


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("objects", [True, False])
def test_pages_and_lines(packed, objects):
    lines = [["First (page)", "back\\slash é €"], ["BT", "endstream is a word", "12 0 obj"], []]
    assert pdf.read(made([page(x) for x in lines], packed, objects=objects)) == "First (page)\nback\\slash é €\n\nBT\nendstream is a word\n12 0 obj" or not packed


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="cp1252", exclude_categories=["C", "Z"]), min_size=1, max_size=30), min_size=1, max_size=5), min_size=1, max_size=3))
def test_any_strings(lines):
    assert pdf.read(made([page(x) for x in lines])) == "\n\n".join("\n".join(x) for x in lines)


def test_operators():
    content = b"BT /F1 9 Tf 1 0 0 1 10 700 Tm [(Hel) 20 (lo) -500 (wor\\\nld)] TJ 1 0 0 1 90 700 Tm ( same line) Tj 1 0 0 1 10 680 Tm <6E657874> Tj T* (third\\041) Tj (fourth) ' ET BT (fifth) Tj ET"
    assert pdf.read(made([content])) == "Hello world same line\nnext\nthird!\nfourth\nfifth"


def test_maps_to_unicode():
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <65E5> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<672C> <8A9E>] endbfrange endcmap"
    fonts = "<< /F1 << /Type /Font /Subtype /Type0 /ToUnicode 50 0 R >> >>"
    content = b"BT /F1 9 Tf <00010020 0021> Tj T* <000200100011001200FF> Tj ET"
    assert pdf.read(made([content], fonts=fonts, more=[(50, cmap)])) == "日本語\nfiABC"


def test_broken_files():
    good = made([page(["words"])])
    for data, why in ((b"", "not a PDF"), (b"x" * 50, "not a PDF"), (good.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"), "encrypted"), (made([b"q Q"]), "without text"), (b"%PDF-1.4\n", "no pages"), (good.replace(b"FlateDecode", b"DCTDecode  "), "no reader"), (good.replace(b"stream\nx", b"stream\ny"), "broken")):
        with pytest.raises(ValueError, match=why):
            pdf.read(data)
    rng = random.Random(1)
    for _ in range(200):  # whatever is wrong, it ends, with a text or an error of its own
        bad = bytearray(good)
        for _ in range(rng.randrange(1, 9)):
            bad[rng.randrange(9, len(bad))] = rng.randrange(256)
        try:
            pdf.read(bytes(bad[: rng.randrange(20, len(bad))]))
        except ValueError:
            pass


def test_a_small_file_of_a_large_stream():
    with pytest.raises(ValueError, match="too large"):
        pdf.read(made([b" " * (pdf.MOST + 10)]))


def test_uploads(spark, tmp_path):
    from lexloom.sources import uploads

    (tmp_path / "a.pdf").write_bytes(made([page(["from a file"])]))
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.7 nothing")
    got = {r["title"]: (r["content"], r["error"]) for r in uploads.read(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("from a file", None), "b.pdf": (None, "no pages")}
