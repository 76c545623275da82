"""Words and sentences of dirty text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
# Characters that show nothing (soft hyphen, zero width and direction marks, variation selectors).
_UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
_BROKEN = re.compile(r"(?<=[^\W_])[-‐¬][ \t]*\n[ \t]*(?=[^\W_])")
_RUN = re.compile(r"[^\W_]+")


def _tag(m: re.Match) -> str:
    """An inline tag within a word leaves it whole; others part words."""
    return "" if m[0].lower().strip("</>").split(" ")[0] in ("b", "i", "em", "strong", "span", "u", "s", "sub", "sup", "mark", "small", "font", "a") else " "


_BLOCKS = frozenset("p div section article header footer main nav aside ul ol li dl dt dd table thead tbody tr td th blockquote pre hr h1 h2 h3 h4 h5 h6".split())


def _block(m: re.Match) -> str:
    """A tag of a block ends the paragraph, a line break the line; others as _tag."""
    name = m[0].lower().strip("</>").split()[0]
    return "\n\n" if name in _BLOCKS else "\n" if name == "br" else _tag(m)


def plain(text: str, tag: Callable[[re.Match], str] = _tag) -> str:
    """Text without tags and invisible characters, in compatibility form, with line feeds alone; tag() stands for each tag."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    if "<" in text:
        text = _TAG.sub(tag, text)
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits without regard to case, compatibility forms, invisible characters, tags and punctuation;
    a word divided by a hyphen at the end of a line is whole."""
    text = plain(text)
    if "\n" in text:
        text = _BROKEN.sub("", text)
    return _RUN.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text.casefold()))


_FENCE = re.compile(r"^[ \t>]*(```|~~~).*?(?:^[ \t>]*\1[^\n]*$|\Z)", re.S | re.M)
_PARTS = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[*+#-]|\d+[.)])[ \t])")
_MARK = re.compile(r"^[ \t>]*(?:[*+-]|\d+[.)])[ \t]+")
_HEAD = re.compile(r"^[ \t>]*#{1,6}(?:[ \t][^\n]*)?$", re.M)
# Text behind comment marks: a heading of the first level is not followed by another in the next line.
_COMMENT = re.compile(r"^[ \t>]*#[ \t]+[^\n]*(?:\n[ \t>]*#[ \t]+[^\n]*)+", re.M)
_COMMENT_MARK = re.compile(r"^[ \t>]*#[ \t]+", re.M)
_STOP = re.compile(r"(?<=[.!?。])\s+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[str]:
    """The sentences of a marked-up text in lower case; no headings, no code blocks, no lines without an end of a sentence.
    A heading is its own line alone, also directly above text; of several lines in a row behind `# ` the text counts.
    A text in which nothing ends like a sentence is read by lines."""
    text = plain(text, _block)
    if "#" in text:
        text = _COMMENT.sub(lambda m: _COMMENT_MARK.sub("", m[0]), text)
    text = _BROKEN.sub("", text)
    text = _FENCE.sub("\n\n", text).lower()
    if "#" in text:
        text = _HEAD.sub("", text)
    every: list[str] = []
    for part in _PARTS.split(text):
        part = part.strip()
        if not part:
            continue
        part = " ".join(_MARK.sub("", part).split())
        every += [x for x in _STOP.split(part) if _RUN.search(x)]
    ended = [x for x in every if x.rstrip("\"')*_` ").endswith((".", "!", "?", "。"))]
    return ended or every


def terms(sentence: str) -> list[str]:
    """The distinct words of two letters or more, sorted."""
    return sorted(set(_WORD.findall(sentence)))
