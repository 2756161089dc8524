"""Shell-style name patterns as anchored regular expressions.

'*' and '?' stop at '/', classes are '[a-z]' or '[^a-z]', '\\' takes the next
character literally, and the whole text has to match. A malformed pattern
matches nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ITEM = r"(?:\\.|[^\\\-\]])"
_TOKEN = re.compile(
    rf"(?P<star>\*+)|(?P<one>\?)|\[(?P<neg>\^?+)(?P<set>(?:{_ITEM}(?:-{_ITEM})?)+)\]"
    r"|\\(?P<esc>.)|(?P<lit>[^\\\[])",
    re.DOTALL,
)
_RANGE = re.compile(rf"(?P<lo>{_ITEM})(?:-(?P<hi>{_ITEM}))?", re.DOTALL)


def _quoted(ch: str) -> str:
    return ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch


def _char_class(negated: bool, body: str) -> str:
    pieces = []
    for m in _RANGE.finditer(body):
        lo = m["lo"][-1]
        hi = (m["hi"] or m["lo"])[-1]
        if lo <= hi:
            pieces.append(_quoted(lo) if lo == hi else f"{_quoted(lo)}-{_quoted(hi)}")
    if not pieces:
        return r"[\s\S]" if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(pieces)}]"


def glob_regex(pattern: str) -> str | None:
    """The regular expression of a pattern, or None when it is malformed."""
    out, at = [], 0
    while at < len(pattern):
        m = _TOKEN.match(pattern, at)
        if m is None:
            return None
        at = m.end()
        if m["star"]:
            out.append("[^/]*")
        elif m["one"]:
            out.append("[^/]")
        elif m["set"]:
            out.append(_char_class(bool(m["neg"]), m["set"]))
        else:
            out.append(_quoted(m["esc"] or m["lit"]))
    return r"\A" + "".join(out) + r"\z"


def matches_glob(text: Column, pattern: str) -> Column:
    regex = glob_regex(pattern)
    return F.lit(False) if regex is None else text.rlike(regex)
