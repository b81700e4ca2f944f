"""Text cleaning as native column expressions.

Whitespace and word classes are spelled out so that Java regexes agree with
Python's Unicode-aware ``\\s`` and ``\\w``: ``(?U)`` widens ``\\s``, the four
ASCII separators U+001C..U+001F are added by hand, and a word character is a
letter, a number or an underscore (combining vowel signs are not).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import CODE_MIX_TOKENS, EMOJI_RANGES

SPACE = r"[\s\x{1C}-\x{1F}]"
NON_SPACE = r"[^\s\x{1C}-\x{1F}]"
WORD = r"[\p{L}\p{N}_]"
EMOJI = "[" + "".join(rf"\x{{{lo}}}-\x{{{hi}}}" for lo, hi in EMOJI_RANGES) + "]"
DEVANAGARI = r"[\x{900}-\x{97F}]"
# Line ends as str.splitlines sees them.
LINE_BREAK = r"\r\n|[\n\r\x{0B}\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return _sub(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def strip_urls(c: Column) -> Column:
    return _sub(c, rf"(?U)http{NON_SPACE}+|www{NON_SPACE}+", "")


def strip_mentions(c: Column) -> Column:
    return _sub(c, rf"@{WORD}+", "")


def unwrap_hashtags(c: Column) -> Column:
    return _sub(c, rf"#({WORD}+)", "$1")


def emoji(c: Column, keep: bool = False) -> Column:
    """Replace each emoji by a space, or by an ``<emoji>`` token."""
    return _sub(c, EMOJI, " <emoji> " if keep else " ")


def emphasis(c: Column, keep: bool = True) -> Column:
    """Turn runs of ``!`` and ``?`` into tokens, or into one space."""
    if not keep:
        return _sub(c, "[!?]+", " ")
    return _sub(_sub(c, "!+", " <excl> "), r"\?+", " <ques> ")


def collapse_runs(c: Column, max_repeat: int = 2) -> Column:
    """Shorten longer runs of one character to ``max_repeat`` of it."""
    return _sub(c, rf"(?d)(.)\1{{{max_repeat},}}", "$1" * max_repeat)


def collapse_vowels(c: Column) -> Column:
    return _sub(c, r"([aeiouAEIOU])\1+", "$1")


def charset(c: Column, profile: str = "social") -> Column:
    """Drop characters outside the profile's alphabet.

    ``social`` puts a space in their place and keeps Devanagari and the
    placeholder characters; ``basic`` keeps ASCII letters, digits and
    whitespace and joins what remains.
    """
    if profile == "social":
        return _sub(c, r"(?U)[^a-zA-Z0-9\s\x{1C}-\x{1F}\x{900}-\x{97F}<>_]", " ")
    if profile == "basic":
        return _sub(c, r"(?U)[^a-zA-Z0-9\s\x{1C}-\x{1F}]", "")
    raise ValueError(f"unknown cleaning profile {profile!r}")


def squash(c: Column) -> Column:
    """Lower-case, one space between words, none at the ends."""
    return F.trim(_sub(F.lower(c), rf"(?U){SPACE}+", " "))


def clean_steps(
    c: Column,
    keep_emojis: bool = False,
    normalize_repeated: bool = True,
    keep_emphasis: bool = True,
    profile: str = "social",
) -> Column:
    """The cleaner as it is defined, one step after the other."""
    c = unwrap_hashtags(strip_mentions(strip_urls(c)))
    if profile == "social":
        c = emphasis(emoji(c, keep_emojis), keep_emphasis)
        if normalize_repeated:
            c = collapse_vowels(collapse_runs(c))
    return F.coalesce(squash(charset(c, profile)), F.lit(""))


def clean_text(
    c: Column,
    keep_emojis: bool = False,
    normalize_repeated: bool = True,
    keep_emphasis: bool = True,
    profile: str = "social",
) -> Column:
    """The full cleaner; null becomes the empty string.

    Gives what :func:`clean_steps` gives with fewer regex passes: a removed
    mention never joins a ``#`` to a word, so both go in one pass; runs are
    maximal, so vowels and other characters shorten in one pass; tokens hold no
    runs, so they may come after it; an emoji that is not kept is dropped with
    the other foreign characters. ``c`` should be a column, as cheap tests on
    it skip passes.
    """
    if profile != "social":
        return clean_steps(c, keep_emojis, normalize_repeated, keep_emphasis, profile)
    has_url = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www"))
    x = F.when(has_url, strip_urls(c)).otherwise(c)
    has_tag = F.contains(c, F.lit("@")) | F.contains(c, F.lit("#"))
    x = F.when(has_tag, _sub(x, rf"@{WORD}+|#({WORD}+)", "$1")).otherwise(x)
    if keep_emojis:
        x = emoji(x, keep=True)
    if normalize_repeated:
        x = _sub(x, r"([aeiouAEIOU])\1+|([^\naeiouAEIOU])\2\2+", "$1$2$2")
        if keep_emphasis:  # at most two in a row are left: plain byte replacement
            for mark, token in (("!", " <excl> "), ("?", " <ques> ")):
                x = F.replace(F.replace(x, F.lit(mark * 2), F.lit(mark)), F.lit(mark), F.lit(token))
    elif keep_emphasis:
        x = emphasis(x)
    return F.coalesce(squash(charset(x)), F.lit(""))


def is_code_mixed(c: Column, tokens: Sequence[str] = CODE_MIX_TOKENS) -> Column:
    """True for any Devanagari letter, or a listed word next to an unlisted one.

    Both word tests are regex searches that stop at the first hit, so no token
    array is built for long posts.
    """
    low = F.lower(c)
    listed = "|".join(tokens)
    has_listed = F.rlike(low, F.lit(rf"(?<![a-z])(?:{listed})(?![a-z])"))
    has_other = F.rlike(low, F.lit(rf"(?<![a-z])(?!(?:{listed})(?![a-z]))[a-z]"))
    mixed = F.rlike(c, F.lit(DEVANAGARI)) | (has_listed & has_other)
    return F.coalesce(mixed, F.lit(False))


def text_key(c: Column) -> Column:
    """Key under which two posts count as the same text."""
    return _sub(F.lower(strip(F.coalesce(c, F.lit("")))), rf"(?U){SPACE}+", " ")


def is_blank(c: Column) -> Column:
    """True for null and whitespace-only text."""
    return ~F.coalesce(F.rlike(c, F.lit(rf"(?U){NON_SPACE}")), F.lit(False))


def preview(c: Column, n: int = 60) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def char_count(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(rf"(?U){NON_SPACE}+")), F.lit(0))
