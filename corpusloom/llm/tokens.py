"""Tokens for packing and mixing: runs of characters other than blank, tab, LF, CR.

``cuts`` splits a text before given tokens so that the parts joined give the
text again: white space stays with the part before it, and what precedes the
first token with the first part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

TOKEN_RE = "[^ \\t\\n\\r]+"
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 13, 32]] = True


def count_tokens(text: str | Column) -> Column:
    """Number of tokens; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_RE)), F.lit(0))


def cuts(text: str, at: list[int]) -> list[str]:
    """Parts of ``text`` beginning at the tokens ``at`` (ascending; the first part begins at 0)."""
    raw = text.encode("utf-8", "surrogatepass")
    blank = _BLANK[np.frombuffer(raw, dtype=np.uint8)]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    edges = [0, *(int(begin[i]) for i in at[1:]), len(raw)]
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges, edges[1:])]


def parts(text: str, ranges: list[tuple[int, int]]) -> list[str]:
    """The text of each range of tokens ``first, end``, cut as ``cuts`` does."""
    raw = text.encode("utf-8", "surrogatepass")
    blank = _BLANK[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.append(np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])), len(raw))
    edge[0] = 0
    return [raw[edge[a] : edge[z]].decode("utf-8", "surrogatepass") for a, z in ranges]
