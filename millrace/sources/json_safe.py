"""JSON from pages and bodies that may be anything: what can't be read is nothing, what is written is JSON."""

from __future__ import annotations

import json
import math
import re

#: Levels that a value may have; a deeper one counts as malformed.
DEEP = 200
_LONE = re.compile("[\ud800-\udfff]")


def _number(text: str) -> float | None:
    value = float(text)
    return value if math.isfinite(value) else None


_READER = json.JSONDecoder(parse_constant=lambda _: None, parse_float=_number)
_WRITERS = {compact: json.JSONEncoder(sort_keys=True, separators=(",", ":") if compact else None, ensure_ascii=False) for compact in (True, False)}


def within(value) -> bool:
    """Iterative, so that depth costs no stack."""
    front = [value]
    for _ in range(DEEP):
        front = [y for x in front if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not front:
            return True
    return False


def loads(text: str | None):
    """The value of a JSON text; None for what is none, is deeper than DEEP or is null.  NaN,
    infinities and numbers beyond a double are null, halves of surrogate pairs U+FFFD."""
    try:
        value = _READER.decode(text) if text else None
    except (ValueError, RecursionError):
        return None
    if not within(value):
        return None
    if text and "\\ud" in text.lower():  # an escape may be half of a pair
        value = json.loads(_LONE.sub("\ufffd", json.dumps(value, ensure_ascii=False)))
    return value


def dumps(value, compact: bool = True) -> str:
    """Canonical JSON: keys sorted, no spaces; halves of surrogate pairs become U+FFFD."""
    return _LONE.sub("�", _WRITERS[compact].encode(value))
