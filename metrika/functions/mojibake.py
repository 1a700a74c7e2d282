"""Repair of texts whose UTF-8 was read as Latin-1 or Windows-1252, once or several times. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Windows-1252 for the bytes 0x80 to 0x9F; five bytes have none.
CP1252 = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ",
    0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
#: Times that a text may have been read wrongly.
DEPTH = 3


def _read(first: int, last: int) -> str:
    """A class of the characters that bytes first..last become under either encoding."""
    also = "".join(f"\\x{{{ord(c):X}}}" for b, c in CP1252.items() if first <= b <= last)
    return f"[\\x{{{first:X}}}-\\x{{{last:X}}}{also}]"


_TAIL = _read(0x80, 0xBF)
#: A tail that is no guillemet, which may close a word in capitals.
_LETTER = "[" + _read(0x80, 0xAA)[1:-1] + _read(0xAC, 0xBA)[1:-1] + _read(0xBC, 0xBF)[1:-1] + "]"
#: Runs that are UTF-8 of Latin letters and signs, of two or more Greek or Cyrillic letters, or of general punctuation, euro and trade mark.
RUN = (
    f"(?:\\x{{C2}}{_TAIL}|\\x{{C3}}{_TAIL}|[\\x{{C4}}\\x{{C5}}]{_LETTER}"
    f"|\\x{{E2}}{_read(0x80, 0x80)}{_read(0x90, 0xBA)}|\\x{{E2}}{_read(0x82, 0x82)}\\x{{AC}}|\\x{{E2}}{_read(0x84, 0x84)}\\x{{A2}}"
    f"|(?:[\\x{{CE}}-\\x{{D3}}]{_TAIL}){{2,}})+"
)


def repaired(text: Column) -> Column:
    """The text with runs of wrongly read UTF-8 read rightly, up to DEPTH times over.

    Only runs that turn into letters and signs that texts hold are touched, so a
    capital before a guillemet stays. A null is null, an empty text empty; texts
    without such runs come back as they are, and other parts of a text with them.
    """
    for _ in range(DEPTH):
        # Each reading is a value of its own, made once.
        text = F.element_at(F.transform(F.array(text), _once), 1)
    return text


def _once(text: Column) -> Column:
    special = "".join(CP1252.values())
    plain = "".join(map(chr, CP1252))
    read = lambda r: F.decode(F.encode(F.translate(r, special, plain), "ISO-8859-1"), "UTF-8")
    runs = F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), read)
    between = F.split(text, RUN, -1)
    joined = F.array_join(F.zip_with(between, F.array_append(runs, F.lit("")), lambda b, r: F.concat(b, r)), "")
    return F.when(text.rlike(RUN), joined).otherwise(text)
