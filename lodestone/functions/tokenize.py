"""Tokens of code and prose as Column expressions (no Python in the plan)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: character classes and patterns ---
HANGUL = "\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f"
KANA = "\u3040-\u309f\u30a0-\u30ff"
CJK = "\u4e00-\u9fff"
WORD_PATTERN = rf"([a-zA-Z0-9_\-]+|[{HANGUL}]+|[{KANA}]+|[{CJK}]+)"
CAMEL_PATTERN = r"([a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|[A-Z][a-z]+|[0-9]+)"
# --- end of fixed values ---


def _nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda p: p != "")


def words(text: Column) -> Column:
    """Runs of ASCII word characters, Hangul, kana or CJK; anything else, such
    as an accented letter, separates."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN), F.lit(1))


def split_identifier(word: Column) -> Column:
    """Parts of one identifier in lower case: by underscores if it has any,
    else by hyphens if it has any, else by changes of case."""
    parts = (
        F.when(F.contains(word, F.lit("_")), _nonempty(F.split(word, "_")))
        .when(F.contains(word, F.lit("-")), _nonempty(F.split(word, "-")))
        .otherwise(F.regexp_extract_all(word, F.lit(CAMEL_PATTERN), F.lit(1)))
    )
    return F.transform(parts, lambda p: F.lower(p))


#: Identifiers with an underscore or hyphen, whole.
_JOINED = r"(?<![a-zA-Z0-9])[a-zA-Z0-9]*+[_\-][a-zA-Z0-9_\-]*+"
#: Of other words, the parts of two characters or more between changes of case; runs of other scripts.
_PARTS = rf"[a-z]{{2,}}|[A-Z]{{2,}}(?=[A-Z][a-z]|(?![a-zA-Z0-9_\-]))|[A-Z][a-z]+|[0-9]{{2,}}|[{HANGUL}]+|[{KANA}]+|[{CJK}]+"
#: The same, where capitals before a digit are a part too.
_ALL_PARTS = _PARTS.replace("(?![a-zA-Z0-9_\\-])", "(?![a-zA-Z_\\-])")


def tokens(text: Column, capitals: bool = False) -> Column:
    """All tokens of a text; one-character ASCII tokens are dropped.  Capitals
    before a digit, as in ``ABC123``, are a token only if ``capitals`` is set.

    The same as ``split_identifier`` of all ``words``, in a few passes over the
    whole text and none over single words: found parts are put on a line each
    and made lower case together.  Where the text has underscores or hyphens,
    lines are also cut at underscores, those without any at hyphens.
    """
    text = F.coalesce(text, F.lit(""))
    parts = _ALL_PARTS if capitals else _PARTS
    lines = lambda pattern: F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "\n")
    simple = F.split(F.nullif(F.lower(lines(parts)), F.lit("")), "\n")
    # hyphens of lines with an underscore stay
    kept = F.regexp_replace(F.regexp_replace(lines(f"{_JOINED}|{parts}"), r"-(?=[^\n]*_)", "\x02"), r"(_[^\n\-]*|(?!\A)\G[^\n\-]*)-", "$1\x02")
    cut = F.lower(F.translate(kept, "_-\x02", "\n\n-"))
    joined = F.regexp_extract_all(cut, F.lit(r"[^\n]{2,}|[^\x00-\x7F]"), F.lit(0))
    return F.coalesce(F.when(F.contains(text, F.lit("_")) | F.contains(text, F.lit("-")), joined).otherwise(simple), F.array().cast("array<string>"))


def token_hash(token: Column) -> Column:
    """The first 32 bits of the token's SHA-256."""
    return F.conv(F.left(F.sha2(token, 256), F.lit(8)), 16, 10).cast("long")


def token_counts(text: Column, capitals: bool = False) -> tuple[Column, Column]:
    """The number of tokens and of distinct tokens."""
    found = tokens(text, capitals)
    return F.size(found), F.size(F.array_distinct(found))
