"""Text scalar functions: cleaning, dashes, token patterns, stress marks. Built-in functions only, but for `cleaned`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entities and characters that cleaning replaces, in order.
REPLACEMENTS = [
    ("\r\n", "\n"), ("\r", "\n"), ("&eacute", "é"), ("&hyphen;", "-"), ("&sblank;", "--"), ("&mdash;", " -- "),
    ("&ndash;", " - "), ("&longs;", "s"), ("&wblank", " -- "), ("\u2223", ""), ("\u2014", " -- "), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&lsquo;", "‘’"), ("&rsquo;", "’"), ("&indent;", "     "), ("&amp;", "&"), ("&euml;", "ë"),
    ("&uuml;", "ü"), ("&auml;", "ä"),
]
#: Phrase separators that can be tokens (curly quotes are not in the token range).
SEPARATORS = ',:;–—()[].!?"'
SEPARATOR_CLASS = r'[,:;–—()\[\].!?"]'
WORD = r"[\p{L}\p{N}_']+"
#: White space that a token carries in front; \x01 stands for characters that are no token.
BLANK = "[ \\n\u0085\u00a0\u1680\u2000-\u200a\\x01]"
TOKEN = rf"{BLANK}*(?:{WORD}|[!-—–])"


def clean_text(text: Column) -> Column:
    """Line ends, entities and long dashes; curly quotes straightened."""
    for old, new in REPLACEMENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    # Not F.translate, which looks up every character in a map.
    for old, new in zip("‘’“”", "''\"\"", strict=True):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalize_dashes(text: Column) -> Column:
    """Two or more hyphens become a long dash."""
    return F.regexp_replace(text, "-{2,}", "—")


_DASHES = re.compile("-{2,}").sub


def cleaned(text: str) -> str:
    """`clean_text` and `normalize_dashes` of one text, for the passes that read whole texts in Python."""
    has_entities = "&" in text  # no replacement makes the first one
    for old, new in REPLACEMENTS:
        if has_entities or old[0] != "&":
            text = text.replace(old, new)
    for old, new in zip("‘’“”", "''\"\"", strict=True):
        text = text.replace(old, new)
    return _DASHES("—", text) if "--" in text else text


def token_array(text: Column) -> Column:
    """The tokens of a text in order, each with the white space before it; trailing white space is dropped."""
    found = F.regexp_extract_all(marked(normalize_dashes(text)), F.lit(TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit("\x01"), F.lit("")))


def marked(text: Column) -> Column:
    """\\x01 for every character that no token has."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_' -—–\n]", "\x01")


_TOKENS = re.compile(TOKEN.replace(WORD, r"[\w']+")).findall


def tokens_of(text: str) -> list[str]:
    """What `token_array` finds in one text that is `cleaned` and `marked`; \\w has the letters, numbers and the low line."""
    found = _TOKENS(text)
    return [t.replace("\x01", "") for t in found] if "\x01" in text else found


def is_punctuation(token: Column) -> Column:
    """1 if no character is a letter."""
    return F.when(token.rlike(r"\p{L}"), 0).otherwise(1)


def initial_whitespace(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*", 0)


def normalize_token(token: Column) -> Column:
    """Trimmed; inner white space becomes a hyphen."""
    return F.regexp_replace(F.regexp_replace(token, r"^\s+|\s+$", ""), r"\s+", "-")


def word_array(text: Column) -> Column:
    """The words (with a letter) of a text."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: w.rlike(r"\p{L}"))


def stress_class(ipa: Column) -> Column:
    """P for primary, S for secondary, U for none, '' for an empty syllable."""
    return (
        F.when(ipa == "", "")
        .when(ipa.contains("`"), "S")
        .when(ipa.contains("'"), "P")
        .otherwise("U")
    )


def format_syllable(ipa: Column) -> Column:
    """At most one stress mark, in front."""
    mark = F.when(ipa.contains("`"), "`").when(ipa.contains("'"), "'").otherwise("")
    return F.concat(mark, F.regexp_replace(ipa, "['`]", ""))


def attribute_string(**values: Column) -> Column:
    """`name=value` pairs joined by commas; nulls are left out."""
    pairs = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in values.items()]
    return F.concat_ws(", ", *pairs)


def stable_hash(*parts: Column, length: int = 16) -> Column:
    """A stable hexadecimal key of the parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length)


# Frequent short words by language, for the detector.
STOP_WORDS = {
    "de": ["der", "die", "und", "das", "mit", "ist", "den", "von", "ein", "nicht"],
    "en": ["the", "and", "of", "to", "in", "that", "is", "was", "for", "with"],
    "es": ["de", "la", "que", "el", "los", "las", "del", "por", "una", "y"],
    "fr": ["de", "la", "le", "et", "les", "des", "est", "pour", "dans", "une"],
}


def detect_language(text: Column) -> Column:
    """The language with the most stop words among the text's words, ties to the first by name; null without any."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda listed: lambda w: w.isin(listed)
    hits = {k: F.size(F.filter(words, among(v))) for k, v in sorted(STOP_WORDS.items())}
    best = F.greatest(*hits.values())
    out = None
    for k, n in hits.items():
        out = F.when(n == best, k) if out is None else out.when(n == best, k)
    return F.when(best > 0, out)
