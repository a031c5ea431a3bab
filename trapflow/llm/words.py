"""Words of a text as comparable tokens."""

from __future__ import annotations

import re
import unicodedata

_APOSTROPHES = re.compile("['‘’ʼ＇`´­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words in order, without case, punctuation and layout; an apostrophe joins its word."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _WORD.findall(_APOSTROPHES.sub("", text).casefold())
