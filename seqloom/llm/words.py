"""Words of a text with the usual disguises undone."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters of other scripts that look like Latin ones, undone only where a word mixes both.
LOOKALIKES = str.maketrans("аеорсухіѕјкмтнвԁɡαοερν", "aeopcyxisjkmthbdgaoepv")
#: Digits and signs read as letters inside a word.
LEET = str.maketrans("0134578@$!", "oieastbasi")
#: Stands for a word of which only some letters are shown.
MASKED = "\x00"
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿̀-ͯ]")
_MASK = re.compile(r"(?<![^\W_])[^\W\d_](?:\*+|#+|-{2,}|_{2,}|\.{3,})[^\W\d_]?(?![^\W_])")
_LETTERS = re.compile(r"[^\W\d_](?:([.\-_*])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_PART = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")
_RUN = re.compile(r"(.)\1+")
_LATIN = re.compile("[a-z]")


@lru_cache(1 << 16)
def plain(word: str) -> str:
    """One word in lower case without accents, look-alikes, digits for letters and repeated letters.

    Of a run of one letter one is left, or two where the word would have fewer
    than three letters, which are words of their own ("ass" and "as").
    """
    if word.isascii():
        word = word.lower()
    else:
        word = _HIDDEN.sub("", unicodedata.normalize("NFKD", word)).casefold()
        if _LATIN.search(word):
            word = word.translate(LOOKALIKES)
    if not word.isalpha() and _LATIN.search(word):
        word = word.translate(LEET)
    elif word.isdigit():
        return "9"
    once = _RUN.sub(r"\1", word)
    return once if len(once) > 2 else _RUN.sub(r"\1\1", word)


def words_of(token: str) -> list[str]:
    """Words of a piece of text without white space: names in code are split, masked words become ``MASKED``."""
    if not token.isascii():
        token = _HIDDEN.sub("", unicodedata.normalize("NFKC", token))
    if token.isdigit():
        return ["9"]
    if "*" in token or "#" in token or "--" in token or "__" in token or "..." in token:
        token = _MASK.sub(f" {MASKED} ", token)
    if len(token) > 6 and (token.count(".") > 2 or token.count("_") > 2 or token.count("-") > 2 or token.count("*") > 2):
        token = _LETTERS.sub(lambda m: m[0].replace(m[1], ""), token)
    out = []
    for piece in token.split() if MASKED in token else (token,):
        if piece == MASKED:
            out.append(MASKED)
            continue
        for part in _PART.findall(piece):
            if part.islower() or part.isupper() or part.isdigit():
                out.append(plain(part))
            else:
                out += map(plain, _CAMEL.split(part))
    return [w for w in out if w]
