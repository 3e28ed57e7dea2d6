"""The index lookup: ``FIND attribute = value``."""

from __future__ import annotations

import re

ATTRIBUTES = ("record_id", "type", "trust_state", "relation", "logical_id")
_FIND = re.compile(rf"find\s+({'|'.join(ATTRIBUTES)})\s*=\s*(.+)", re.IGNORECASE | re.DOTALL)


def parse(text: str) -> tuple[str, str] | None:
    """Attribute and value without quotes, or None for any other text."""
    found = _FIND.fullmatch(text.strip())
    if not found:
        return None
    value = found[2].strip()
    for quote in "\"'":
        value = value.strip(quote)
    return found[1].lower(), value
