"""Characters that look the same or show nothing: one table for problems 7 and 8."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Letters of other scripts and phonetic letters that look like a Latin letter.
LOOK_ALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "ρ": "p", "υ": "u",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "ѵ": "v", "Ү": "Y", "ү": "y", "Ӏ": "I", "ӏ": "l", "Һ": "H",
    # Armenian
    "օ": "o", "Օ": "O", "ս": "u", "հ": "h", "ո": "n", "Տ": "S", "ց": "g", "զ": "q", "ԍ": "G", "յ": "j",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Latin outside the alphabet
    "ɑ": "a", "ɡ": "g", "ı": "i", "ʏ": "Y", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "ɩ": "i", "ȷ": "j",
}

#: Letters that look like more than one letter; the words around tell which.
AMBIGUOUS = {"\u04c0": ("I", "l"), "\u04cf": ("l", "I"), "\u01c0": ("\u01c0", "l", "I"), "\u03c5": ("u", "v"), "\u0269": ("i", "l")}

_IGNORABLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
_SILENT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x84\x86-\x9f]")


@lru_cache(1 << 14)
def ignorable(ch: str) -> bool:
    """Whether a character shows nothing and takes no room."""
    return bool(_IGNORABLE.match(ch) or _SILENT.match(ch)) or unicodedata.category(ch) == "Cf"


@lru_cache(1 << 14)
def shape(ch: str) -> str:
    """What a character looks like: width and presentation forms, spaces and look-alikes brought to one."""
    if ignorable(ch):
        return ""
    wide = unicodedata.normalize("NFKC", ch) if not unicodedata.combining(ch) else ch
    if wide != ch:
        return "".join(map(shape, wide))
    if unicodedata.category(ch) == "Zs":
        return " "
    return LOOK_ALIKES.get(ch, ch)


def looks(ch: str) -> tuple[str, ...]:
    """All that a character may look like, the table's shape first."""
    return AMBIGUOUS.get(ch) or (shape(ch),)


#: One letter for all that an ambiguous letter may look like.
_COARSE = str.maketrans({"I": "l", "i": "l", "\u01c0": "l", "v": "u"})


def coarse(text: str) -> str:
    """Equal for all texts that may look the same, also by an ambiguous letter; some others are equal too."""
    return skeleton(text).translate(_COARSE)


class _Shapes(dict):
    """Table for ``str.translate`` that fills itself with the shapes of the characters it meets."""

    def __missing__(self, code: int) -> str:
        self[code] = shape(chr(code))
        return self[code]


class _Folds(dict):
    """The same without accents."""

    def __missing__(self, code: int) -> str:
        self[code] = "".join(c for c in unicodedata.normalize("NFD", shape(chr(code))) if not unicodedata.combining(c))
        return self[code]


_SHAPES, _FOLDS = _Shapes(), _Folds()


def skeleton(text: str) -> str:
    """The table's form: equal for two texts exactly if they look the same.

    Letter case, accents, digits, words, line breaks and the number of blanks stay; only the
    spelling of what is seen changes.  The form is its own form.
    """
    if text.isascii() and not _SILENT.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_SHAPES))


_WORD = re.compile(r"[^\W_]+")


def folded_words(text: str | None) -> list[str]:
    """Words up to letter case, punctuation, layout, accents and look-alike characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFD", text).translate(_FOLDS)
    return _WORD.findall(text.lower())
