"""Cutting texts into the pieces that byte pair merges stay within."""

from __future__ import annotations

import re

import regex

# White space as Unicode defines it; Python's own class has four control characters more.
_LATIN_SPACE = r"\t-\r \x85\xa0"
_LATIN_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_LATIN_NUMBER = "0-9²³¹¼-¾"


class Splitter:
    """``findall`` of a pattern written with ``\\p{L}``, ``\\p{N}`` and ``\\s``.

    Texts within Latin-1, by far the most here, take an equal pattern of the
    standard library, which is three times as fast.
    """

    def __init__(self, pattern: str):
        whole = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self._any = regex.compile(whole).findall
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_LATIN_SPACE}{_LATIN_LETTER}{_LATIN_NUMBER}]")
        for old, new in (
            (r"\p{L}", f"[{_LATIN_LETTER}]"),
            (r"\p{N}", f"[{_LATIN_NUMBER}]"),
            (r"\s", f"[{_LATIN_SPACE}]"),
            (r"\S", f"[^{_LATIN_SPACE}]"),
        ):
            latin = latin.replace(old, new)
        self._latin = re.compile(latin).findall

    def __call__(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self._latin(text)
