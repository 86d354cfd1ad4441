"""What kind of file some bytes are, by signature and, in containers, by stream names."""

from __future__ import annotations

from docframe.decode.container import is_container, open_container
from docframe.decode.errors import DecodeError

# Labels by stream name and by first bytes.
BY_STREAM = (("/DocumentText", "jtd"), ("/JSCompDocument", "jttc"), ("/WordDocument", "doc"), ("/Workbook", "xls"), ("/Book", "xls"), ("/PowerPoint Document", "ppt"), ("/FileHeader", "hwp"))
BY_START = ((b"{\\rtf", "rtf"), (b"%PDF", "pdf"), (b"PK\x03\x04", "zip"))
IMAGES = (b"\x89PNG", b"\xff\xd8\xff", b"GIF8")


def file_kind(data: bytes) -> str:
    if not data:
        return "empty"
    if is_container(data):
        try:
            c = open_container(data)
        except DecodeError:
            return "cfb_damaged"
        paths = [e.path for e in c.entries]
        for path, kind in BY_STREAM[:-1]:
            if path in paths:
                return kind
        if BY_STREAM[-1][0] in paths or any("Hwp" in p for p in paths):
            return "hwp"
        if any("JSRV" in p for p in paths):
            return "js_other"
        return "cfb_damaged" if c.warnings or len(paths) <= 1 else "cfb_other"
    for start, kind in BY_START:
        if data.startswith(start):
            return kind
    if len(data) > 7 and data[2:4] == b"-l" and data[6:7] == b"-":
        return "lzh"
    if data.startswith(IMAGES):
        return "image"
    head = data[:512].lower()
    if b"<html" in head or b"<!doctype html" in head:
        return "html"
    return "unknown" if any(b < 0x20 and b not in (9, 10, 13, 26) for b in head) else "text"
