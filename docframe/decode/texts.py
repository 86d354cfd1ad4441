"""Other text files: plain text of unknown encoding, RTF, and the word parts of DOCX, read and written."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from docframe.decode.errors import Corrupt, TooLarge

# Encodings tried in turn; RTF destinations without text; the word-processing name space.
ENCODINGS = ("utf-8-sig", "cp932", "euc_jp", "utf-16-le")
UNSHOWN = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr listtable listoverridetable rsidtbl generator themedata colorschememapping datastore latentstyles xmlnstbl mmathPr bkmkstart bkmkend fldinst".split())
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BREAKS = {"par": "\n", "line": "\n", "row": "\n", "page": "\n", "cell": "\t", "tab": "\t"}
_RTF = re.compile(r"(?P<open>\{)|(?P<close>\})|\\(?P<word>[A-Za-z]+)(?P<n>-?\d+)? ?|\\'(?P<hex>[0-9A-Fa-f]{2})|\\(?P<sign>[^A-Za-z])|(?P<plain>[^\\{}\r\n]+)|[\r\n]+|\\", re.S)


def plain_text(data: bytes) -> str:
    """The text in the first encoding that fits all of it, else with replacement characters."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("cp932", "replace")


def rtf_text(data: bytes) -> str:
    """What an RTF file shows: paragraphs, code-page bytes, Unicode characters; destinations without text are skipped."""
    source = data.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", source)
    encoding = {None: "cp932", "65001": "utf-8"}.get(page and page[1]) or f"cp{page[1]}"
    out: list[str] = []
    raw = bytearray()
    groups: list[tuple[int, bool]] = []  # fallback length and whether the group is hidden
    fallback, hidden, drop = 1, False, 0

    def put(text: str) -> None:
        if raw:
            try:
                out.append(raw.decode(encoding, "replace"))
            except LookupError:
                out.append(raw.decode("cp1252", "replace"))
            raw.clear()
        out.append(text)

    for m in _RTF.finditer(source):
        if m["open"]:
            groups.append((fallback, hidden))
        elif m["close"]:
            fallback, hidden = groups.pop() if groups else (1, False)
        elif m["word"] in UNSHOWN or m["sign"] == "*":
            hidden = True
        elif hidden:
            continue
        elif m["hex"] or m["plain"]:
            content = bytes([int(m["hex"], 16)]) if m["hex"] else m["plain"].encode("latin-1")
            raw += content[drop:]
            drop = max(0, drop - len(content))
        elif m["word"] == "uc":
            fallback = int(m["n"] or 1)
        elif m["word"] == "u" and m["n"]:
            put(chr(int(m["n"]) % 0x10000))
            drop = fallback
        elif m["word"] in BREAKS:
            put(BREAKS[m["word"]])
        elif m["sign"]:
            put({"~": " ", "\n": "\n", "\r": "\n"}.get(m["sign"], m["sign"] if m["sign"] in "\\{}" else ""))
    put("")
    text = "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def docx_characters(data: bytes, most: int = 64 << 20) -> list[tuple[str, dict[str, str]]]:
    """(character, properties of its run) in order; a paragraph ends with a line feed."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if z.getinfo("word/document.xml").file_size > most:
                raise TooLarge("the document part is too long")
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise Corrupt(str(e)) from None
    out = []
    for para in root.iter(f"{W}p"):
        for run in para.iter(f"{W}r"):
            props = {p.tag.removeprefix(W): p.get(f"{W}val", "1") for p in run.findall(f"{W}rPr/*")}
            for part in run:
                text = {f"{W}t": part.text or "", f"{W}tab": "\t", f"{W}br": "\n"}.get(part.tag, "")
                out += [(c, props) for c in text]
        out.append(("\n", {}))
    return out


def docx(paragraphs: list[tuple[str, bool]]) -> bytes:
    """A DOCX file of (text, page break before) paragraphs."""
    bad = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")
    body = []
    for text, broken in paragraphs:
        runs = "<w:r><w:tab/></w:r>".join(f'<w:r><w:t xml:space="preserve">{escape(bad.sub("", part))}</w:t></w:r>' for part in text.split("\t"))
        body.append(f"<w:p>{'<w:pPr><w:pageBreakBefore/></w:pPr>' if broken else ''}{runs}</w:p>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'{head}<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(body)}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            z.writestr(zipfile.ZipInfo(name), content)
    return out.getvalue()


def rtf(text: str) -> bytes:
    """The text as an RTF file: paragraphs, tabs, and other than ASCII characters as Unicode words."""
    out = ["{\\rtf1\\ansi\\uc0 "]
    for c in text:
        if c in "\\{}":
            out.append(f"\\{c}")
        elif c in "\n\t":
            out.append("\\par " if c == "\n" else "\\tab ")
        elif " " <= c <= "~":
            out.append(c)
        else:
            raw = c.encode("utf-16-le", "surrogatepass")
            out += [f"\\u{int.from_bytes(raw[k : k + 2], 'little', signed=True)} " for k in range(0, len(raw), 2)]
    return "".join([*out, "}"]).encode("ascii")
