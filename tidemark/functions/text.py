"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import NAME_FILLER, TOKEN_FILLER


def html_strip(html: Column) -> Column:
    """Text of a page: scripts, styles and tags out, the common entities decoded, white space single."""
    x = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def canonical_url(url: Column) -> Column:
    """Lower-case host, no fragment, no utm parameters, the others sorted, no slash at the end."""
    plain = F.regexp_replace(url, r"#.*$", "")
    path = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), url_host(plain), F.regexp_replace(path, "/+$", ""), tail)


def significant_tokens(name: Column) -> Column:
    """The words of a company name that tell it from others."""
    words = F.split(F.trim(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]+", " ")), " +")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(NAME_FILLER)))


def names_agree(a: Column, b: Column) -> Column:
    """Whether one name's significant words are all among the other's; false if either has none."""
    x, y = significant_tokens(F.coalesce(a, F.lit(""))), significant_tokens(F.coalesce(b, F.lit("")))
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return (F.size(x) > 0) & (F.size(y) > 0) & inside


def short_hash(*parts: Column, n: int = 12) -> Column:
    """An id from the parts: the first ``n`` upper-case hex digits of their SHA-1."""
    return F.upper(F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, n))


def missing_to_null(text: Column) -> Column:
    """A number, or null for the tokens that stand for a missing value; other text raises under strict reading."""
    return F.when(F.trim(text).isin(".", ""), None).otherwise(text.try_cast("double"))


def redacted(text: Column) -> Column:
    """Without the values of api keys in it."""
    return F.regexp_replace(text, r"(?i)(api_key=)[^&\s]+", "$1***")


def ticker_token(name: Column) -> Column:
    """A short upper-case code for a company name: its first telling word, or all of them if that is short; UNK if none."""
    words = F.filter(F.split(F.upper(F.regexp_replace(name, "[^A-Za-z0-9 ]+", " ")), " +"), lambda w: (w != "") & ~w.isin(TOKEN_FILLER))
    token = F.when(F.length(F.element_at(words, 1)) >= 3, F.element_at(words, 1)).otherwise(F.array_join(words, ""))
    return F.when(F.size(words) > 0, F.substring(token, 1, 6)).otherwise("UNK")


def deal_code(target: Column, acquirer: Column, year: Column) -> Column:
    return F.concat(F.lit("DEAL-"), ticker_token(target), F.lit("-"), ticker_token(acquirer), F.lit("-"), year.cast("string"))
