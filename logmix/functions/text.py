"""Column functions for cleaning log text. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The results depend on these patterns and lists.
# A tag that nothing closes takes the rest of its line, which then has no match either, so a line is searched once, not from each tag.
STRONG_PATTERN = r"(?i)<strong[^>\n\r\u0085\u2028\u2029]*+>(.+?)</strong>|(<strong.*+)"
TOP_LEVEL_DOMAINS = "com|net|gov|org|edu|co|biz|tv|info"
PUNCTUATION_PATTERN = r"\p{Punct}"
DIGITS_PATTERN = r"\d+"
SPACES_PATTERN = r" +"
NAMED_ENTITIES = {"&lt;": "<", "&gt;": ">", "&amp;": "&", "&quot;": '"', "&apos;": "'"}

# An entity, or a run of text without one. A match never starts inside another, so one pass cannot unescape twice.
_ENTITY_OR_TEXT = r"&(?:lt|gt|amp|quot|apos|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&"
_WHITESPACE = "".join(chr(code) for code in range(0x21))


def _replace(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(replacement))


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def _unescape_token(token: Column) -> Column:
    digits = F.regexp_extract(token, r"^&#0*([0-9]{1,7});$", 1)
    decimal = F.when(digits != "", F.hex(digits.cast("bigint")))
    hexadecimal = F.upper(F.regexp_extract(token, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1))
    code = F.coalesce(decimal, F.when(hexadecimal != "", hexadecimal))
    padded = F.lpad(code, 6, "0")
    # Surrogates and numbers beyond the last code point are no characters: left as written.
    valid = (padded <= "10FFFF") & ~padded.between("00D800", "00DFFF")
    named = reduce(
        lambda chain, entity: chain.when(token == entity, F.lit(NAMED_ENTITIES[entity])),
        list(NAMED_ENTITIES)[1:],
        F.when(token == "&lt;", F.lit("<")),
    )
    numeric = token.startswith("&#") & valid
    return F.coalesce(named, F.when(numeric, _code_point(code)), token)


def unescape_xml(text: Column) -> Column:
    """Decode the five named XML entities and numeric ones, in a single pass."""
    tokens = F.regexp_extract_all(text, F.lit(_ENTITY_OR_TEXT), F.lit(0))
    decoded = F.array_join(
        F.transform(tokens, lambda t: F.when(t.startswith("&"), _unescape_token(t)).otherwise(t)), ""
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def strip_strong(text: Column) -> Column:
    """Drop ``<strong>`` tags and keep what they enclose."""
    return _replace(text, STRONG_PATTERN, "$1$2")


def strip_www(text: Column) -> Column:
    """``www.name.com`` becomes ``name``."""
    return _replace(text, rf"(?i)(www\.)(.+?)(\.({TOP_LEVEL_DOMAINS}))", "$2")


def strip_domain_suffix(text: Column) -> Column:
    """Drop every ``.com``-like suffix that follows at least one character.

    Looking back one character gives the same result as a lazy prefix would, in linear time.
    """
    return _replace(text, rf"(?i)(.)(\.({TOP_LEVEL_DOMAINS}))", "$1")


def strip_web_address(text: Column) -> Column:
    return strip_domain_suffix(strip_www(text))


def blank_symbols(text: Column) -> Column:
    """ASCII punctuation and digits become spaces; runs of spaces shrink to one."""
    blanked = _replace(_replace(text, PUNCTUATION_PATTERN, " "), DIGITS_PATTERN, " ")
    return _replace(blanked, SPACES_PATTERN, " ")


def normalize_text(text: Column) -> Column:
    """Lower-case, unescape, then strip markup, addresses, punctuation, digits and repeated spaces."""
    return blank_symbols(strip_web_address(strip_strong(unescape_xml(F.lower(text)))))


def join_fields(*fields: Column) -> Column:
    """Fields joined by TAB, with control characters and spaces trimmed off both ends of the line."""
    return F.btrim(F.concat_ws("\t", *[F.coalesce(f, F.lit("")) for f in fields]), F.lit(_WHITESPACE))


def split_lines(text: Column) -> Column:
    """The lines of a text as a text-file reader would see them: no line after a final line end, none in ''."""
    body = _replace(text, r"(?:\r\n|\r|\n)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n", -1))


def split_words(line: Column) -> Column:
    """Split on single spaces; trailing empty words are dropped, an empty line is one empty word."""
    trimmed = F.rtrim(line)
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, " ", -1))
    )
