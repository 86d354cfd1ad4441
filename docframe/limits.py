"""Limits on what one file may cost; a file beyond one becomes an error row."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Limits:
    # Defaults of each limit.
    max_bytes: int = 256 * 1024 * 1024
    max_text_units: int = 8_000_000
    max_sheets: int = 64
    max_pages: int = 2_000
    max_expand: int = 4
    max_style_entries: int = 2_000_000

    @classmethod
    def from_json(cls, text: str) -> Limits:
        """Limits by camelCase keys; a missing, zero or non-numeric value leaves the default."""
        try:
            given = json.loads(text)
        except ValueError:
            given = {}
        given = given if isinstance(given, dict) else {}
        out = {}
        for f in fields(cls):
            first, *rest = f.name.split("_")
            value = given.get(first + "".join(x.capitalize() for x in rest))
            if isinstance(value, int | float) and not isinstance(value, bool) and value > 0:
                out[f.name] = int(value)
        return cls(**out)
