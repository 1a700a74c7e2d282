"""The orthographic pronunciation provider: deterministic syllables and stress from spelling.

It stands in for a pronunciation dictionary and is not dictionary-accurate; a
`lexicon` table, where given, takes precedence (see operators.sylls). Syllables
are maximal spans of consonant letters followed by vowel letters, with trailing
consonants in the last. Polysyllables are stressed on every second syllable
from the first, but for a final one; monosyllables are stressed, function words
not, and ambiguous words have both forms, the unstressed first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüÿ"
CHUNK = f"[^{VOWELS}]*[{VOWELS}]+(?:[^{VOWELS}]+$)?"
# Monosyllabic function words, and words with a stressed and an unstressed form.
FUNCTION_WORDS = [
    "a", "an", "and", "as", "at", "but", "by", "for", "from", "he", "her", "him", "his", "i", "if", "in", "is", "it",
    "me", "my", "nor", "of", "on", "or", "our", "she", "so", "than", "that", "the", "their", "them", "they", "thou",
    "thy", "to", "us", "was", "we", "were", "with", "you", "your",
]
AMBIGUOUS_WORDS = [
    "all", "are", "be", "been", "can", "could", "did", "do", "does", "had", "has", "have", "how", "may", "might",
    "must", "no", "not", "now", "own", "shall", "should", "some", "then", "there", "these", "this", "those", "what",
    "when", "where", "which", "who", "whom", "why", "will", "would",
]


def syllables(word: Column) -> Column:
    """Lower-case syllable chunks; empty for a word without a vowel letter (no pronunciation)."""
    return F.regexp_extract_all(F.lower(word), F.lit(CHUNK), F.lit(0))


def heavy(chunk: Column) -> Column:
    """Ends in a consonant letter or has two vowel letters."""
    return chunk.rlike(f"[^{VOWELS}]$|[{VOWELS}]{{2}}")


def forms(word: Column, count: Column) -> Column:
    """Number of pronunciation variants: 0 without syllables, 2 for ambiguous monosyllables."""
    return F.when(count == 0, 0).when((count == 1) & F.lower(word).isin(AMBIGUOUS_WORDS), 2).otherwise(1)


def stressed(word: Column, count: Column, at: Column, form: Column) -> Column:
    """Whether syllable `at` (from 0) of variant `form` is stressed."""
    one = F.when(F.lower(word).isin(FUNCTION_WORDS), F.lit(False)).when(
        F.lower(word).isin(AMBIGUOUS_WORDS), form == 1
    ).otherwise(F.lit(True))
    many = (at % 2 == 0) & ((at == 0) | (at < count - 1))
    return F.when(count == 1, one).otherwise(many)


def rime(chunk: Column) -> Column:
    """A syllable chunk from its first vowel letter on."""
    return F.regexp_extract(chunk, f"[{VOWELS}].*$", 0)
