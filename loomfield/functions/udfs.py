"""What built-in functions can't say, as Arrow-batched functions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(DoubleType())
def gestalt_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters of matching blocks over both lengths; not symmetric."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


# Fixed value: an adjacent repeat of a run of words.
ADJACENT = re.compile(r"\b(\w[\w /()&-]{0,80}?)\s+\1\b", re.IGNORECASE)


def settled(text: str) -> str:
    """One blank between words, and adjacent repeats gone until there is none."""
    text, n = " ".join(text.split()), 1
    while n:
        text, n = ADJACENT.subn(r"\1", text)
    return text


def without_repeats(text: str, least: int = 2, most: int = 6) -> str:
    """Later exact repeats of a phrase of `least` to `most` words go, long ones first."""
    words, seen, out, at = text.split(), set(), [], 0
    keys = [w.lower() for w in words]
    while at < len(words):
        top = min(most, len(words) - at)
        n = next((n for n in range(top, least - 1, -1) if tuple(keys[at : at + n]) in seen), 0)
        if n:
            at += n
            continue
        seen.update(tuple(keys[at : at + n]) for n in range(least, top + 1))
        out.append(words[at])
        at += 1
    return " ".join(out)


@F.pandas_udf(StringType())
def drop_repeated_phrases(c: pd.Series) -> pd.Series:
    return c.map(lambda t: None if t is None else without_repeats(settled(t)))
