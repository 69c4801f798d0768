"""Normalisation shared by the text operators."""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like Latin ones.
_LOOKALIKE = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
_FOLD = str.maketrans(_LOOKALIKE)
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:[a-z]{2,8}|#\d{1,6});")
_BROKEN = re.compile("[Â-ô][\u0080-¿Œ-œŠ-šŸŽžƒˆ˜–-™]{1,3}")
_IN_NUMBER = re.compile(r"(?<=\d)[.,](?=\d)")
_CJK = "㐀-䶿一-鿿豈-﫿぀-ヿ가-힯"
WORD = re.compile(rf"[{_CJK}]|[^\W_{_CJK}]+")


def _mend(m: re.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        return m.group()


def normalise(text: str) -> str:
    """Lower case without markup, invisible characters, look-alike letters and broken encodings."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        text = unicodedata.normalize("NFKC", _BROKEN.sub(_mend, text)).casefold()
        if not text.isascii():
            text = text.translate(_FOLD)
    else:
        text = text.lower()
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return text


def words(text: str) -> list[str]:
    """Words of a text, each Chinese character one of its own; a number is one word with or without its separators."""
    return WORD.findall(_IN_NUMBER.sub("", normalise(text)))
