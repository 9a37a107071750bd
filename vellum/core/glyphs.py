"""Glyph names of the Latin base encodings, from Python's codecs and Unicode's own names; the others are in symbolic.py.

A letter's glyph is its base letter and its accent's glyph name; only what no rule names is listed.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Glyph names of characters that no rule gives.
NAMES = {
    " ": "space", "!": "exclam", '"': "quotedbl", "#": "numbersign", "$": "dollar", "%": "percent", "&": "ampersand", "'": "quotesingle",
    "(": "parenleft", ")": "parenright", "*": "asterisk", "+": "plus", ",": "comma", "-": "hyphen", ".": "period", "/": "slash",
    ":": "colon", ";": "semicolon", "<": "less", "=": "equal", ">": "greater", "?": "question", "@": "at", "[": "bracketleft",
    "\\": "backslash", "]": "bracketright", "^": "asciicircum", "_": "underscore", "`": "grave", "{": "braceleft", "|": "bar",
    "}": "braceright", "~": "asciitilde", "€": "Euro", "‚": "quotesinglbase", "ƒ": "florin", "„": "quotedblbase", "…": "ellipsis",
    "†": "dagger", "‡": "daggerdbl", "ˆ": "circumflex", "‰": "perthousand", "‹": "guilsinglleft", "Œ": "OE", "‘": "quoteleft",
    "’": "quoteright", "“": "quotedblleft", "”": "quotedblright", "•": "bullet", "–": "endash", "—": "emdash", "˜": "tilde",
    "™": "trademark", "›": "guilsinglright", "œ": "oe", "¡": "exclamdown", "¢": "cent", "£": "sterling", "¤": "currency", "¥": "yen",
    "¦": "brokenbar", "§": "section", "¨": "dieresis", "©": "copyright", "ª": "ordfeminine", "«": "guillemotleft", "¬": "logicalnot",
    "®": "registered", "¯": "macron", "°": "degree", "±": "plusminus", "²": "twosuperior", "³": "threesuperior", "´": "acute",
    "µ": "mu", "¶": "paragraph", "·": "periodcentered", "¸": "cedilla", "¹": "onesuperior", "º": "ordmasculine", "»": "guillemotright",
    "¼": "onequarter", "½": "onehalf", "¾": "threequarters", "¿": "questiondown", "Æ": "AE", "æ": "ae", "Ð": "Eth", "ð": "eth",
    "×": "multiply", "÷": "divide", "Ø": "Oslash", "ø": "oslash", "Þ": "Thorn", "þ": "thorn", "ß": "germandbls", "ı": "dotlessi",
    "≠": "notequal", "∞": "infinity", "≤": "lessequal", "≥": "greaterequal", "∂": "partialdiff", "∑": "summation", "∏": "product",
    "π": "pi", "∫": "integral", "Ω": "Omega", "√": "radical", "≈": "approxequal", "∆": "Delta", "◊": "lozenge", "⁄": "fraction",
    "ﬁ": "fi", "ﬂ": "fl", "": "apple", "˘": "breve", "˙": "dotaccent", "˚": "ring", "˝": "hungarumlaut", "˛": "ogonek",
    "ˇ": "caron", "Ł": "Lslash", "ł": "lslash", "−": "minus",
}
_ACCENTS = {0x300: "grave", 0x301: "acute", 0x302: "circumflex", 0x303: "tilde", 0x308: "dieresis", 0x30A: "ring", 0x30C: "caron", 0x327: "cedilla"}
#: The standard encoding above ASCII, and where it differs below.
STANDARD = {
    0x27: "’", 0x60: "‘", 0xA1: "¡", 0xA2: "¢", 0xA3: "£", 0xA4: "⁄", 0xA5: "¥", 0xA6: "ƒ", 0xA7: "§", 0xA8: "¤", 0xA9: "'", 0xAA: "“",
    0xAB: "«", 0xAC: "‹", 0xAD: "›", 0xAE: "ﬁ", 0xAF: "ﬂ", 0xB1: "–", 0xB2: "†", 0xB3: "‡", 0xB4: "·", 0xB6: "¶", 0xB7: "•", 0xB8: "‚",
    0xB9: "„", 0xBA: "”", 0xBB: "»", 0xBC: "…", 0xBD: "‰", 0xBF: "¿", 0xC1: "`", 0xC2: "´", 0xC3: "ˆ", 0xC4: "˜", 0xC5: "¯", 0xC6: "˘",
    0xC7: "˙", 0xC8: "¨", 0xCA: "˚", 0xCB: "¸", 0xCD: "˝", 0xCE: "˛", 0xCF: "ˇ", 0xD0: "—", 0xE1: "Æ", 0xE3: "ª", 0xE8: "Ł", 0xE9: "Ø",
    0xEA: "Œ", 0xEB: "º", 0xF1: "æ", 0xF5: "ı", 0xF8: "ł", 0xF9: "ø", 0xFA: "œ", 0xFB: "ß",
}


def glyph_name(c: str) -> str | None:
    if c in NAMES:
        return NAMES[c]
    if c.isascii() and c.isalpha():
        return c
    if c.isdigit() and c.isascii():
        return unicodedata.name(c).split()[1].lower()
    parts = unicodedata.normalize("NFD", c)
    if len(parts) == 2 and ord(parts[1]) in _ACCENTS:
        return parts[0] + _ACCENTS[ord(parts[1])]
    words = unicodedata.name(c, "").split()
    if words[:1] == ["GREEK"] and len(words) == 4:
        return words[3].capitalize() if words[1] == "CAPITAL" else words[3].lower()
    return None


@lru_cache(None)
def encoding(name: str) -> dict[int, str]:
    """code -> glyph name of a base encoding; empty for other names."""
    from .symbolic import TABLES, codes

    if name in TABLES:
        return codes(TABLES[name])
    out: dict[int, str] = {}
    for code in range(32, 256):
        if name == "WinAnsiEncoding":
            c = bytes([code]).decode("cp1252", "ignore") or "•"
            c = {0x7F: "•", 0xA0: " ", 0xAD: "-"}.get(code, c)
        elif name == "MacRomanEncoding":
            c = bytes([code]).decode("mac_roman")
            c = {0xCA: " ", 0xDB: "¤"}.get(code, c)
        elif name == "StandardEncoding":
            c = STANDARD.get(code) or (chr(code) if code < 127 else "")
        else:
            return {}
        if c and (g := glyph_name(c)):
            out[code] = g
    return out
