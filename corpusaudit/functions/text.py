"""Text columns: tokens, whitespace, normal form, byte limits and quotes.

Every function takes and returns a Column and stays in the JVM, but for ``nfc``, which Spark
has no built-in for.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A word is a run of letters and numbers, and keeps one straight or curly
# apostrophe where a letter or number stands on both sides of it.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"

# The 29 characters that count as white space.
WHITESPACE = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

# Characters that neither change under NFC nor combine with a neighbour: Latin and its
# extensions, base Cyrillic, general punctuation, currency, kana, CJK ideographs.
# ``tests/test_text.py`` checks every one of them against the Unicode tables.
NFC_INERT = (
    r"\x{0000}-\x{02FF}\x{0400}-\x{0481}\x{2010}-\x{2027}\x{2030}-\x{205E}"
    r"\x{20A0}-\x{20BF}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}"
)

SENTENCE_CONTEXT = 160


def words(text: Column) -> Column:
    """Every word of a text, in order and with repeats."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def nfc(text: Column) -> Column:
    """Unicode normal form C.

    A row made only of inert characters is passed to Python as NULL: the batch still crosses,
    the text does not. The tests run from cheap to dear: equal lengths in bytes and characters
    are plain ASCII, and a single range settles most of the rest.
    """
    needs = (
        (F.octet_length(text) != F.length(text))
        & text.rlike(r"[^\x{0000}-\x{02FF}]")
        & text.rlike(f"[^{NFC_INERT}]")
    )
    return F.coalesce(_nfc(F.when(needs, text)), text)


def collapse_whitespace(text: Column) -> Column:
    """Trim, and turn every run of white space into one space."""
    return F.trim(F.regexp_replace(text, WHITESPACE + "+", " "))


def remove_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, WHITESPACE + "+", "")


def strip_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WHITESPACE}+|{WHITESPACE}+\z", "")


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` occurs without overlap; NULL where either is absent or empty."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(
        (F.length(part) > 0) & (F.length(text) > 0), F.floor(gone / F.length(part))
    ).cast("bigint")


def glyph_count(text: Column, glyph: str) -> Column:
    """How often one character (or a fixed string) occurs."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(glyph), F.lit("")))
    return (gone / F.lit(len(glyph))).cast("bigint")


def codepoint(name: str) -> str:
    """``U+21A9`` -> the character; an unusable name -> an empty string."""
    if not name.upper().startswith("U+"):
        return ""
    try:
        return chr(int(name[2:], 16))
    except (ValueError, OverflowError):
        return ""


def truncate_bytes(text: Column, limit: int) -> Column:
    """The longest head of ``text`` that fits ``limit`` UTF-8 bytes and cuts no character.

    Works on the hex form of the first characters: where the byte behind the cut continues a
    character, that character's own bytes go too.
    """
    if limit <= 0:
        return F.left(text, F.lit(0))
    coded = F.hex(F.encode(F.left(text, F.lit(limit + 1)), "UTF-8"))
    cut = F.left(coded, F.lit(2 * limit))
    inside = F.substring(coded, 2 * limit + 1, 1).isin("8", "9", "A", "B")
    whole = F.regexp_extract(cut, r"^((?:..)*?)[C-F].(?:[89AB].){0,2}\z", 1)
    head = F.decode(F.unhex(F.when(inside, whole).otherwise(cut)), "UTF-8")
    return F.when(F.octet_length(text) <= limit, text).otherwise(head)


def sentence_around(text: Column, part: Column) -> Column:
    """The sentence around the first occurrence of ``part``, cut to 160 characters a side.

    A sentence ends at a line break, or at ``.``, ``!`` or ``?`` with white space or the end of
    the quoted window behind it. NULL where there is no occurrence.
    """
    at = F.instr(text, part)
    begin = F.greatest(at - F.lit(SENTENCE_CONTEXT), F.lit(1))
    # The first character of the match stays on while the opening is sought: a full stop right
    # before the match ends a sentence only if the match opens with white space.
    before = F.substring(text, begin, at - begin + 1)
    after = F.substring(text, at + F.length(part), F.lit(SENTENCE_CONTEXT))
    opened = F.regexp_replace(before, rf"(?s)^.*(?:\n|[.!?](?={WHITESPACE}))(?=.)", "")
    closed = F.regexp_extract(after, rf"(?s)^.*?(?:\n|[.!?](?={WHITESPACE}|\z))", 0)
    return F.when(
        (at > 0) & (F.length(part) > 0),
        collapse_whitespace(
            F.concat(
                F.left(opened, F.length(opened) - 1),
                part,
                F.when(F.length(closed) > 0, closed).otherwise(after),
            )
        ),
    )


def inline_label(src: Column, limit: int = 60) -> Column:
    """The bounded name of a reference: an inline one is its head and an ellipsis."""
    target = strip_whitespace(src)
    head = F.left(F.split_part(target, F.lit(","), F.lit(1)), F.lit(limit))
    return F.when(
        F.lower(target).startswith("data:"),
        F.concat(head, F.when(F.instr(target, F.lit(",")) > 0, F.lit(",…")).otherwise(F.lit(""))),
    ).otherwise(src)


def discarded_note_key(message: Column) -> Column:
    """The key of a note that a reader says was defined and never used, else NULL."""
    said = F.regexp_replace(message, rf"{WHITESPACE}+\z", "").rlike(r"(?s)but not used\.*\z")
    key = F.regexp_extract(message, r"(?s)^.*?Note with key '(.*?)' defined at ", 1)
    found = message.rlike(r"(?s)Note with key '.*?' defined at ")
    return F.when(said & found, key)
