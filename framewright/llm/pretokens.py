"""Splitting a text into the matches of the byte-level tokenizers' pattern, with Python's own engine where that is exact."""

from __future__ import annotations

import re

import regex

#: The same matches as public_tokenizers.PATTERN wherever no character of UNSURE occurs: there \w without \d and _ is \p{L}, \d is \p{N}.
FAST = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Controls that Python counts as space, numbers that are no digits, and everything but Latin, Greek, Cyrillic and punctuation.
UNSURE = re.compile("[\x1c-\x1f²³¹¼-¾԰-῿⁰-\U0010ffff]")

#: The same matches, faster, wherever no character of BEYOND occurs: those of UNSURE, and letters that LATIN doesn't list.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?[^\s\d{LETTERS}]+|\s+(?!\S)|\s+")
BEYOND = re.compile("[\x1c-\x1f²³¹¼-¾ɐ-\u1fff⁰-\U0010ffff]")


def plain(text: str) -> bool:
    """Whether FAST matches as the pattern does."""
    return UNSURE.search(text) is None


def matches(text: str) -> list[str] | None:
    """The text's matches of the pattern by Python's own engine; None where that might give others."""
    if BEYOND.search(text) is None:
        return LATIN.findall(text)
    return FAST.findall(text) if plain(text) else None


def splitter(pattern: str):
    """A function from a text to its matches of `pattern`, the byte-level tokenizers' own."""
    exact = regex.compile(pattern).findall
    return lambda text: FAST.findall(text) if plain(text) else exact(text)
