"""URLs as column expressions: parts, report-safe and canonical forms, hosts."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from .text import bound, match_text, unescape_entities, unescaped, unquote_text

# What a URL looks like in text, and what may trail it there.
ABSOLUTE_URL = "(?i)https?://[^\\s\"'<>]+"
TRAILING = ".,);}>"
BAD_ESCAPE = "%(?![0-9A-Fa-f]{2})"
LOCAL_HOSTS = ("0.0.0.0", "127.0.0.1", "::1", "localhost")
LOCAL_SUFFIXES = (".corp", ".internal", ".lan", ".local")

#: scheme, userinfo with its @, host, port, path, query, fragment
PARTS = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*@)?(\\[[0-9A-Fa-f:.]*\\]|[^\\[\\]/?#:@]*)(?::([0-9]*))?((?![^/?#])[^?#]*)(?:\\?([^#]*))?(?:#(.*))?$"
_SEP = "\x00"
#: Which of several forms of one repository host and path are meant.
API_HOST, RAW_HOST, BRANCHED_HOST = "api.github.com", "raw.githubusercontent.com", "dev.azure.com"


def _at(p: Column, place: int) -> Column:
    return F.get(p, F.lit(place))


def _parts(url: Column) -> Column:
    """The groups of PARTS as an array, by one match; of one element if the URL has no such form."""
    return F.split(F.regexp_replace(url, f"(?s){PARTS}", _SEP.join(f"${g}" for g in range(1, 7))), _SEP)


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, f"(?s){PARTS}", group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def _host(p: Column) -> Column:
    return F.lower(F.translate(_at(p, 2), "[]", ""))


def host(url: Column) -> Column:
    return F.lower(F.translate(part(url, 3), "[]", ""))


def _authority(p: Column, keep_default: bool) -> Column:
    """Host with the port, unless that is the scheme's own (or zero)."""
    own = F.when(F.lower(_at(p, 0)) == "https", "443").otherwise("80")
    drop = _at(p, 3).isin("", "0") if keep_default else _at(p, 3).isin("", "0") | (_at(p, 3) == own)
    return F.concat(F.lower(_at(p, 2)), F.when(drop, "").otherwise(F.concat(F.lit(":"), _at(p, 3))))


def _or_empty(p: Column, made: Column) -> Column:
    return F.when(F.size(p) == 6, made).when(F.size(p) >= 0, "")


def display_url(url: Column) -> Column:
    """Without userinfo, query and fragment, fit for a report; empty for what is no URL."""
    return bound(_parts(url), lambda p: _or_empty(p, F.concat(F.lower(_at(p, 0)), F.lit("://"), _authority(p, True), F.when(_at(p, 4) == "", "/").otherwise(_at(p, 4)))))


def plain_canonical(url: Column) -> Column:
    """``canonical_url`` of a text whose entities are decoded."""

    def made(p: Column) -> Column:
        path = F.when(_at(p, 4).isin("", "/"), "/").otherwise(F.rtrim(_at(p, 4), F.lit("/")))
        return F.concat(F.lower(_at(p, 0)), F.lit("://"), _authority(p, False), path, F.when(_at(p, 5) == "", "").otherwise(F.concat(F.lit("?"), _at(p, 5))))

    return bound(_parts(F.trim(url)), lambda p: _or_empty(p, made(p)))


def canonical_url(url: Column) -> Column:
    """The form in which two spellings of one address are equal: entities decoded, the query kept; empty for what is no URL."""
    return plain_canonical(unescape_entities(F.trim(url)))


def origin(url: Column) -> Column:
    return bound(_parts(url), lambda p: _or_empty(p, F.concat(F.lower(_at(p, 0)), F.lit("://"), _authority(p, False))))


def percent_decode(text: Column) -> Column:
    """As in paths, so a plus stays a plus; null where an escape is broken or not UTF-8."""
    return F.when(~text.rlike(BAD_ESCAPE), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))


def link_error(url: Column) -> Column:
    """``invalid_link`` or ``credentialed_link``; null for a sound http(s) URL."""

    def error(p: Column) -> Column:
        bad = url.rlike(BAD_ESCAPE) | (F.size(p) != 6) | ~F.lower(_at(p, 0)).isin("http", "https") | (_host(p) == "") | _host(p).contains("%")
        return F.when(bad, "invalid_link").when(_at(p, 1) != "", "credentialed_link").when(bad_port(_at(p, 3)), "invalid_link")

    return bound(_parts(url), error)


def bad_port(port: Column) -> Column:
    return (F.length(F.ltrim(port, F.lit("0"))) > 5) | F.coalesce(port.try_cast("int") > 65535, F.lit(False))


def parses(url: Column) -> Column:
    """Whether a URL with an authority can be taken apart at all."""
    return bound(_parts(url), lambda p: (F.size(p) == 6) & ~bad_port(_at(p, 3)))


def repository_reference(url: Column) -> Column:
    """``(host, slug)`` of the repository that a URL (also ``git@host:path``) names; null if it names none.

    Trailing punctuation is dropped and the path decoded; the API's ``repos/`` and what stands between owner and
    name around ``_git`` are not part of the name.
    """
    url = F.rtrim(url, F.lit(TRAILING))
    by_mail = "(?is)^git@([^:]*):(.*)$"
    bare = lambda path: F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "[.]git$", "")

    def named(p: Column) -> Column:
        names = F.filter(F.split(percent_decode(_at(p, 4)), "/"), lambda x: x != "")
        names = F.when((_host(p) == API_HOST) & (F.get(names, F.lit(0)) == "repos"), F.slice(names, 2, F.greatest(F.size(names), F.lit(1)))).otherwise(names)
        at = F.array_position(names, "_git").cast("int")
        names = F.when((_host(p) == BRANCHED_HOST) & (at > 0), F.concat(F.slice(names, F.lit(1), at - 1), F.slice(names, at + 1, F.lit(1)))).otherwise(names)
        slug = F.regexp_replace(F.concat_ws("/", F.slice(names, 1, 2)), "[.]git$", "")
        return F.when((F.size(p) == 6) & (_host(p) != "") & (F.size(names) >= 2), F.struct(_host(p).alias("host"), slug.alias("slug")))

    mailed = F.struct(F.lower(F.regexp_extract(url, by_mail, 1)).alias("host"), bare(unquote_text(F.regexp_extract(url, by_mail, 2))).alias("slug"))
    absolute = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.when(url.rlike(by_mail), mailed).otherwise(bound(_parts(absolute), named))


def plain_slug(slug: str) -> str:
    """The form in which two spellings of an owner and name are equal."""
    return match_text(unescaped(slug)).strip().strip("/").removesuffix(".git").casefold()


def slug_key(slug: Column) -> Column:
    """``plain_slug`` of a column; only escapes, entities and non-ASCII need Python."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(slug), "^/+|/+$", ""), "[.]git$", "")
    return F.coalesce(_plain_slug(F.when(slug.rlike("[^\\x00-\\x7f]|[%&]"), slug)), F.lower(plain))


@F.pandas_udf(StringType())
def _plain_slug(slugs: pd.Series) -> pd.Series:
    return slugs.map(plain_slug, na_action="ignore").astype(object)


def needles(repository: str) -> tuple[str, ...]:
    """What a text that names a private repository holds, folded: the value itself, and its usual addresses."""
    value = repository.strip().rstrip("/")
    told = re.fullmatch(r"(?:[A-Za-z][\w+.-]*://[^/]+/+|git@[^:]*:/*|(?=[^/\s]+/[^/\s]+$))(.+?)(?:\.git)?", value)
    forms = ("https://github.com/{}", "http://github.com/{}", "ssh://git@github.com/{}", "git@github.com:{}") if told else ()
    return tuple(sorted({x.casefold() for x in (value, *(f.format(told[1].strip("/")) for f in forms)) if x}))


def repository_name(value: Column) -> Column:
    """OWNER/NAME, given as such or as a public address; null for anything else."""
    bare = lambda v: F.regexp_replace(F.regexp_replace(v, "[.]git$", ""), "^/+|/+$", "")
    given = bare(F.trim(value))
    ours = (host(given) == "github.com") & link_error(given).isNull()
    name = F.when(given.contains("://"), F.when(ours, F.regexp_replace(F.regexp_replace(part(given, 5), "^/+|/+$", ""), "[.]git$", ""))).otherwise(given)
    return F.when(name.rlike("^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), name)


def local_host(h: Column) -> Column:
    return h.isin(*LOCAL_HOSTS) | h.rlike(f"({'|'.join(s.replace('.', '[.]') for s in LOCAL_SUFFIXES)})$")


def _is_public(value: str | None) -> bool:
    if not value or value.lower() == "localhost":
        return False
    try:
        return ipaddress.ip_address(value).is_global
    except ValueError:
        return True


@F.pandas_udf(BooleanType())
def _public_address(hosts: pd.Series) -> pd.Series:
    return hosts.map(_is_public, na_action="ignore").astype(object)


def public_host(h: Column) -> Column:
    """Not this machine and, if an address, a globally routed one; only what looks like an address needs Python."""
    return F.coalesce(_public_address(F.when(h.rlike("^[0-9.]+$|:"), h)), ~h.isin("", "localhost"))


@F.pandas_udf(StringType())
def resolve(bases: pd.Series, links: pd.Series) -> pd.Series:
    """RFC 3986 resolution; null for what cannot be parsed."""

    def one(base: str, link: str) -> str | None:
        try:
            return urljoin(base, link)
        except ValueError:
            return None

    return pd.Series([None if b is None or v is None else one(b, v) for b, v in zip(bases, links, strict=True)], dtype=object)


def public_url(url: Column) -> Column:
    """Whether a URL may be probed and reported."""
    return F.coalesce(link_error(url).isNull(), F.lit(False)) & public_host(host(url))


def url_fingerprint(url: Column) -> Column:
    return F.sha2(url, 256)


def redacted_url(url: Column) -> Column:
    return F.concat(F.lit("redacted-url:"), F.substring(F.sha2(url, 256), 1, 16))


def text_urls(text: Column) -> Column:
    """Absolute URLs in a text, without the punctuation that trails them."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({ABSOLUTE_URL})"), 1), lambda u: F.rtrim(u, F.lit(TRAILING)))
