"""What filings and providers say about a listing: tickers, issuer names, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tidemark.functions.text import names_agree

#: Where filings state a ticker or an exchange.
HEADER_TICKER, HEADER_EXCHANGE = r"(?i)<TICKER>\s*([A-Z][A-Z0-9.]{0,4})", r"(?i)<EXCHANGE>\s*([A-Za-z0-9 .\-]{2,40})"
#: The white space around a tagged ticker is what inline tags of reviewed filings have.
TAGGED_TICKER = r"(?i)dei:TradingSymbol[^>]*>\s*([A-Z][A-Z0-9.]{0,4})\s*<"
PARENTHESIS = r"(?i)\((?:NASDAQ|NYSE(?:\s+(?:American|MKT|Arca))?|AMEX|OTCQX|OTCQB|The Nasdaq(?: Capital| Global(?: Select)?)? Market|New York Stock Exchange)[:\s]+([A-Z][A-Z0-9.]{0,4})\)"
COVER_TICKER = r"\b([A-Z]{1,5})\s+(?:The\s+)?(?:NASDAQ|NYSE|New York Stock Exchange|Nasdaq Stock Market)\b"
EXCHANGE = r"(?i)(NASDAQ|NYSE|NYSE American|NYSE Arca|The Nasdaq Stock Market|New York Stock Exchange)"
#: Words that look like tickers and are none.
NO_TICKERS = (
    "NAME THE CLASS STOCK SHARE COMMON FORM ITEM DATE AND FOR FROM THIS THAT WITH NYSE NASDA AMEX EXCHA INDIC YORK TITLE EACH WHICH REGIS TABLE "
    "PAGE UNITED STATE COMMI UNDER SECUR"
).split()
NO_TAGS = ("ISO", "USD", "FORM")
#: Letters before a parenthesis in which the target's name must stand.
REACH = 50


def session_close(day: Column) -> Column:
    """16:00 of the day, New York time without a zone."""
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), F.lit(16), F.lit(0), F.lit(0))


def adjacent_ticker(plain: Column, target: Column) -> Column:
    """The ticker in parentheses behind most of the target's significant words; null if none or several tie.

    Names stand before their parenthesis, so nothing behind it counts: that would be the buyer's ticker.
    """
    from tidemark.functions import scan

    return F.arrow_udf(lambda texts, targets: scan.column(scan.adjacent, scan.NAME, texts, targets), "string")(plain, target)


def filing_identity(raw: Column, target: Column, filer_is_target: Column) -> Column:
    """Tickers that a filing states (header, tags, cover, next to the target's name) and the one that counts, with its
    place. A null filing states nothing."""
    from tidemark.functions import scan

    return F.arrow_udf(lambda raws, targets, filers: scan.column(scan.identity, scan.IDENTITY, raws, targets, filers), from_arrow_type(scan.IDENTITY))(raw, target, filer_is_target)


def issuer_name(*names: Column) -> Column:
    """The first name that isn't empty."""
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def listing_problems(name: Column, target: Column, start: Column, end: Column, announced: Column) -> Column:
    """Why a provider's series isn't shown to be the target's; an empty array if it is. An unknown end is open, an unknown start no proof."""
    covers = F.coalesce(start <= announced, F.lit(False)) & F.coalesce(end >= announced, F.lit(True))
    return F.array_compact(F.array(F.when(~names_agree(name, target), "issuer_name_disagrees"), F.when(~covers, "listing_does_not_cover_announcement")))


def chart_problems(name: Column, target: Column, first_trade: Column, announced: Column) -> Column:
    """The same for a chart's meta data, which has the first trade as epoch seconds; 0 counts as unknown."""
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.timestamp_seconds(F.nullif(first_trade, F.lit(0))).cast("timestamp_ntz")))
    return F.array_compact(F.array(F.when(~names_agree(name, target), "issuer_name_disagrees"), F.when(~F.coalesce(day <= announced, F.lit(False)), "first_trade_does_not_cover_announcement")))
