"""Text as column expressions; Arrow UDFs only for Unicode folding and entities, which Spark has no functions for."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Characters of no width, and the line breaks of str.splitlines().
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
LINE_BREAKS = "[\n-\r\x1c-\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"

_NO_WIDTH = dict.fromkeys(map(ord, ZERO_WIDTH))
_ANY_NO_WIDTH = re.compile(f"[{ZERO_WIDTH}]")
_BAD_ESCAPE = re.compile("%(?![0-9A-Fa-f]{2})")


def _plain(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return text.translate(_NO_WIDTH) if _ANY_NO_WIDTH.search(text) else text


def _settled(text: str, step: Callable[[str], str], times: int) -> str:
    """``step`` applied until it changes nothing, ``times`` at most."""
    for _ in range(times):
        before, text = text, step(text)
        if text == before:
            break
    return text


def match_text(text: str) -> str:
    """Entities decoded twice at most, compatibility-composed, characters of no width gone."""
    return _plain(_settled(text, html.unescape, 2))


def unescaped(text: str) -> str:
    """Percent escapes decoded, as in paths; a text with a broken one stays."""
    return text if _BAD_ESCAPE.search(text) else unquote(text)


@lru_cache(maxsize=1 << 16)
def structured_key(key: str, passes: int = 2) -> str:
    """A JSON key as lower-case words joined by underscores, whatever its spelling or escapes."""
    key = _settled(_plain(html.unescape(key)), lambda k: k if unescaped(k) == k else _plain(html.unescape(unescaped(k))), passes)
    spaced = re.sub("([a-z0-9])([A-Z])", r"\1 \2", key)
    return "_".join(re.findall("[a-z0-9]+", spaced.casefold()))


def folded(text: str) -> str:
    """Full case folding of composed text: the key under which two paths collide."""
    return unicodedata.normalize("NFKC", text.replace("\\", "/")).casefold()


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _by_arrow(function: Callable[[str], str | None]) -> Callable[[Column], Column]:
    """A Python function of strings as a column function on Arrow batches; null stays null."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore").astype(object)

    return run


_match_text, _fold, _casefold, _unescape, _unquote = map(_by_arrow, (match_text, folded, str.casefold, html.unescape, unescaped))


def _where_needed(text: Column, needed: Column, by_python: Callable[[Column], Column], otherwise: Column) -> Column:
    """``by_python`` of the texts that need it, so that only these travel to Python."""
    return F.coalesce(by_python(F.when(needed, text)), otherwise)


def needs_normalising(text: Column) -> Column:
    """Whether ``normalise_match_text`` could change a text; ASCII without entities needs no Python."""
    return text.rlike("[&[^\\x00-\\x7f]]")


def normalise_match_text(text: Column) -> Column:
    return _where_needed(text, needs_normalising(text), _match_text, text)


@F.pandas_udf(StructType([StructField("plain", StringType()), StructField("cased", StringType())]))
def _match_forms(texts: pd.Series) -> pd.DataFrame:
    plain = texts.map(match_text, na_action="ignore").astype(object)
    return pd.DataFrame({"plain": plain, "cased": plain.map(str.casefold, na_action="ignore").astype(object)})


def match_forms(text: Column) -> Column:
    """``normalise_match_text`` as ``plain`` and its full case folding as ``cased``, by one visit to Python; null where a text needs none."""
    return _match_forms(F.when(needs_normalising(text), text))


def fold(text: Column) -> Column:
    return _where_needed(text, text.rlike("[^\\x00-\\x7f]"), _fold, F.lower(F.replace(text, F.lit("\\"), F.lit("/"))))


def case_folded(text: Column) -> Column:
    """Full case folding, in which a sharp s is two."""
    return _where_needed(text, text.rlike("[^\\x00-\\x7f]"), _casefold, F.lower(text))


def unescape_entities(text: Column) -> Column:
    return _where_needed(text, text.contains("&"), _unescape, text)


def unquote_text(text: Column) -> Column:
    """Percent escapes decoded, those that are not UTF-8 as replacement characters; broken ones leave a text as it is."""
    return _where_needed(text, text.contains("%"), _unquote, text)


def collapse_space(text: Column) -> Column:
    some = text.contains("  ") | text.rlike("(?U)[^\\S ]")  # most texts have nothing to collapse
    return F.trim(F.when(some, F.regexp_replace(text, "(?U)\\s+", " ")).otherwise(text))


def policy_key(text: Column) -> Column:
    return F.replace(F.lower(F.trim(text)), F.lit("-"), F.lit("_"))


def normal_email(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def normal_phone(text: Column) -> Column:
    """Digits with a plus; ten of them are a national number."""
    digits = F.regexp_replace(F.coalesce(text, F.lit("")), "\\D", "")
    return F.when(digits == "", "").when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(F.concat(F.lit("+"), digits))


def first_word(text: Column) -> Column:
    return F.split(F.trim(text), "\\s+", 2)[0]


def lines_of(text: Column) -> Column:
    """The lines of a text; a break at its end makes no further line, and an empty text has none."""
    return bound(F.split(text, LINE_BREAKS), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts))


def match_column(text: Column, pattern: str) -> Column:
    """1-based code point at which a pattern first matches; null without a match."""
    before = F.length(F.regexp_extract(text, f"(?s)^(.*?)(?:{pattern})", 1))
    return F.when(text.rlike(pattern), before + 1)
