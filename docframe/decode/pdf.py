"""PDF files whose pages carry an invisible text layer: a code for each different character, in order of first use."""

from __future__ import annotations

import zlib


def codes_of(pages: list[list[tuple[float, float, float, str]]]) -> dict[str, int]:
    """Code of each character of the pages' (x, y, size, text) items, from 1 on."""
    out: dict[str, int] = {}
    for page in pages:
        for *_, text in page:
            for c in text:
                out.setdefault(c, len(out) + 1)
    return out


def _utf16(c: str) -> str:
    return c.encode("utf-16-be", "surrogatepass").hex().upper()


def _character_map(codes: dict[str, int]) -> bytes:
    """The map from codes to Unicode, a hundred entries at a time."""
    rows = [f"<{k:04X}> <{_utf16(c)}>" for c, k in codes.items()]
    parts = [rows[k : k + 100] for k in range(0, len(rows), 100)]
    body = "".join(f"{len(p)} beginbfchar\n" + "\n".join(p) + "\nendbfchar\n" for p in parts)
    return (
        "/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def\n"
        "/CMapName /T def /CMapType 2 def 1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + body + "endcmap CMapName currentdict /CMap defineresource pop end end"
    ).encode("ascii")


def text_pdf(pages: list[list[tuple[float, float, float, str]]], width: float = 595.3, height: float = 841.9, title: str = "") -> bytes:
    """A PDF of these pages; x and y in points from the upper left, invisible text that can be found and copied."""
    codes = codes_of(pages)
    objects: list[bytes] = []

    def put(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(content: bytes) -> bytes:
        packed = zlib.compress(content)
        return b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"

    catalog, tree = put(b""), put(b"")
    to_unicode = put(stream(_character_map(codes)))
    descriptor = put(b"<< /Type /FontDescriptor /FontName /Text /Flags 4 /FontBBox [0 -200 1000 900] /ItalicAngle 0 /Ascent 900 /Descent -200 /CapHeight 700 /StemV 80 >>")
    inner = put(b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Text /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 1000 /FontDescriptor %d 0 R >>" % descriptor)
    font = put(b"<< /Type /Font /Subtype /Type0 /BaseFont /Text /Encoding /Identity-H /DescendantFonts [%d 0 R] /ToUnicode %d 0 R >>" % (inner, to_unicode))
    kids = []
    for page in pages:
        lines = [f"/F {size:g} Tf 1 0 0 1 {x:g} {height - y:g} Tm <{''.join(f'{codes[c]:04X}' for c in text)}> Tj" for x, y, size, text in page if text]
        content = put(stream(("BT 3 Tr\n" + "\n".join(lines) + "\nET").encode("ascii")))
        kids.append(put(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 %g %g] /Resources << /Font << /F %d 0 R >> >> /Contents %d 0 R >>" % (tree, width, height, font, content)))
    objects[catalog - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    info = put(f"<< /Title <FEFF{_utf16(title)}> >>".encode("ascii"))
    out, places = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, catalog, info, start)
