"""Deal terms and tickers out of filing text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type


def most_frequent(values: Column, larger: bool) -> Column:
    """The value that occurs most often in an array of numbers; of equally frequent ones the larger, or the smaller."""
    kinds = F.array_distinct(values)
    sign = 1 if larger else -1
    ranked = F.transform(kinds, lambda v: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (v * sign).alias("s"), v.alias("v")))
    return F.array_max(ranked)["v"]


#: How announcements state a price in cash.
CASH_PATTERNS = (
    r"(?i)\$\s*([0-9]+(?:\.[0-9]+)?)\s+in\s+(?:an\s+)?(?:all[- ])?cash\s+per\s+share",
    r"(?i)\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share\s+in\s+(?:an\s+)?(?:all[- ])?cash",
    r"(?i)(?:all[- ])?cash\s+transaction[^.]{0,40}\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
    r"(?i)acquire[sd]?[^.]{0,60}for\s+\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
    r"(?i)cash\s+consideration\s+of\s+\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
    r"(?i)per\s+share\s+merger\s+consideration\s+(?:of\s+)?\$\s*([0-9]+(?:\.[0-9]+)?)",
    r"(?i)merger\s+consideration\s+of\s+\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
    r"(?i)\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
)
#: How they state an exchange ratio.
RATIO_PATTERNS = (
    r"(?i)exchange\s+ratio\s+(?:of\s+)?([0-9]+(?:\.[0-9]+)?)",
    r"(?i)([0-9]+(?:\.[0-9]+)?)\s+shares?\s+of\s+[^.]{0,40}?common\s+stock\s+for\s+each",
    r"(?i)([0-9]+(?:\.[0-9]+)?)\s+of\s+a\s+share\s+of",
)
#: Who buys, and for how much, said from the target's side (name, price).
TARGET_SIDE_CASH = (
    r"(?i)(?:to be|will be)\s+acquired\s+by\s+((?:an?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{1,70}?)\s+for\s+\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share(?:\s+in\s+cash)?",
    r"(?i)acquired\s+by\s+((?:an?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{1,70}?)\s+for\s+(?:approximately\s+)?\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share(?:\s+in\s+(?:an\s+)?(?:all[- ])?cash)?",
    r"(?i)affiliates?\s+of\s+([A-Z][A-Za-z0-9&.,' \-]{1,50}?)\s+(?:\([^)]*\)\s*)?(?:under which|pursuant to which)?[^.]{0,80}?\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
    r"(?i)\b((?:The\s+)?Permira(?:\s+Funds)?|Canada Pension Plan Investment Board|Blackstone|KKR|Carlyle|Thoma Bravo|Vista Equity|Silver Lake|Apollo|Bain Capital|TPG|Warburg Pincus|Hellman\s*&\s*Friedman)\b[^.]{0,160}?\$\s*([0-9]+(?:\.[0-9]+)?)\s+per\s+share",
)
#: Who buys, in order of preference; the first is the target's side again.
ACQUIRED_BY = r"(?i)(?:to be|will be)\s+acquired\s+by\s+((?:an?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{1,70}?)(?:\s*\(|\s+for\s+|\s+in\s+a|\s*,)"
ACQUIRER_PATTERNS = (
    r"(?i)((?:An?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{2,70}?)\s*\((?:NYSE|NASDAQ|Nasdaq)[^)]*\)[^.]{0,120}?will acquire",
    r"(?i)will be acquired by\s+((?:an?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{2,70}?)(?:\s*\(|,|\.)",
    r"(?i)(?:acquired by|acquisition by|to be acquired by)\s+((?:an?\s+affiliate\s+of\s+)?[A-Z][A-Za-z0-9&.,' \-]{2,70}?)(?:\s*\(|,|\.)",
    r"(?i)([A-Z][A-Za-z0-9&.,' \-]{2,70}?)\s+would acquire",
    r"(?i)([A-Z][A-Za-z0-9&.,' \-]{2,70}?)\s+\((?:NYSE|NASDAQ|Nasdaq)[^)]*\)[^.]{0,80}?(?:to acquire|will acquire|has agreed to acquire)",
)
#: Mechanics that no fixed price or ratio represents.
MECHANICS = (
    r"(?i)(?:elect(?:ion)?\s+to\s+receive|holder(?:s)?\s+may\s+elect|proration\s+(?:factor|provisions|mechanics)|volume[- ]weighted\s+average\s+price|\bVWAP\b|"
    r"contingent\s+value\s+right|\bCVRs?\b|floating\s+exchange\s+ratio|collar\s+(?:mechanism|structure))"
)
CASH_WORDS, STOCK_WORDS = r"(?i)\b(?:all[- ]cash|in cash|cash consideration|cash transaction)\b", r"(?i)\b(?:exchange ratio|shares of [^.]{0,40}common stock for each)\b"
#: Names that stand for a role, not a company.
ROLES = ("purchaser", "buyer", "parent", "merger sub", "acquisition", "affiliate", "affiliates", "company", "the company", "a wholly-owned subsidiary", "wholly-owned subsidiary")


#: What is cut from a buyer's name, in this order; press releases glue it there.
NAME_RESIDUE = (
    (r"\S+@\S+", " "),
    (r"(?i)^\s*e-?mail\s*:\s*", ""),
    (r"(?i)^.*?\bled by\s+(.+)$", r"\1"),
    (r"(?i)^(?:and|or)\s+", ""),
    (r"(?i)^(?:an?\s+)?affiliate\s+of\s+", ""),
    (r"(?i)\s+for\s+\$\s*[0-9].*$", ""),
    (r"\s*\([^)]*\)\s*$", ""),
    (r"(?i)^.*?\bfunds?\s+advised\s+by\s+(.+)$", r"\1"),
    (r"(?i)\s+(?:will|to|for approximately|pursuant|has agreed|,?\s*which|in\s+20\d{2})\b.*$", ""),
)
#: More places where a buyer is named: who acquires, the parties of an agreement, quoted roles, roles in
#: parentheses, and the wording of communications about a pending deal; and what isn't a buyer there.
ACQUIRES = r"(?i)(?:affiliate of\s+)?([A-Z][^,]{2,70}?)(?:\s*\([^)]+\))?\s+(?:will acquire|to acquire|has agreed to acquire)"
AMONG = r"(?i)(?:Agreement and Plan of Merger|Merger Agreement)[^.]{0,80}?(?:by and )?among\s+([^,]{3,80}),"
QUOTED_ROLE = r"\b(?:Parent|Purchaser|Buyer)\s*[\"“]([A-Z][^\"”]{2,70})[\"”]"
ROLE_BEHIND = r"\b([A-Z][A-Za-z0-9&.,' \-]{2,60}?)\s*\(\"?(?:Parent|Purchaser|Buyer)\"?\)"
PENDING = r"(?i)(?:proposed|pending)\s+(?:acquisition|merger)\s+(?:of|with)\s+[^.]{0,40}?\s+by\s+([A-Z][A-Za-z0-9&.,' \-]{2,70}?)(?:\s*\(|,|\.)"
SHELLS = (
    "parent", "purchaser", "buyer", "holdings", "holding", "inc", "corp", "corporation", "company", "ltd", "llc", "lp", "plc", "group", "partners", "acquisition", "acquireco", "merger", "merger sub", "newco", "unk",
    "the buyer consortium", "buyer consortium", "the consortium", "consortium", "acquisition sub", "the company", "investor group",
)
SHELL_STARTS, AMONG_SHELLS, INTENT = ("parent ", "purchaser ", "buyer ", "the company"), ("parent", "purchaser", "buyer", "the company"), r"(?i)\b(desires?|intends?|proposes?)\b"
#: Letters of a document in which terms, buyers, and parties and roles of an agreement are looked for.
HEAD, BUYER_HEAD, PARTY_HEAD = 20_000, 24_000, 40_000

def deal_terms(text: Column, head: int = HEAD) -> Column:
    """Prices, ratios, the buyer and what the first ``head`` letters say about the terms; for ``decided_terms``.

    A price said from the target's side decides; else prices and ratios are gathered by all patterns and the most
    frequent one counts (of equally frequent ones the higher price, the lower ratio), if few enough are named. A null
    text says nothing.
    """
    from tidemark.functions import scan

    return F.arrow_udf(lambda texts: scan.column(scan.terms, scan.TERMS, texts, head=head), from_arrow_type(scan.TERMS))(text)


def buyer_candidates(text: Column, buyer_head: int = BUYER_HEAD, party_head: int = PARTY_HEAD) -> Column:
    """All names of buyers in a text, cleaned, each once, in order of preference: said from the target's side, as the
    acquirer, as who acquires, as party of the agreement, by role, in communications about a pending deal."""
    from tidemark.functions import scan

    return F.arrow_udf(lambda texts: scan.column(scan.buyers, scan.NAMES, texts, buyer_head=buyer_head, party_head=party_head), "array<string>")(text)


def decided_terms(found: Column) -> Column:
    """What ``deal_terms`` found as one deal's terms; ``found`` is a column of its result."""
    cash, ratio, says_stock = found["cash"], found["ratio"], found["says_stock"]
    says_cash = found["cash_words"] | ((F.size(cash) > 0) & found["names_cash"])
    n_cash, n_ratio = F.size(F.array_distinct(cash)), F.size(F.array_distinct(ratio))
    price, rate = most_frequent(cash, True), most_frequent(ratio, False)
    mixed, all_cash = (n_cash > 0) & (n_ratio > 0) & says_cash & says_stock, (n_cash > 0) & says_cash & ~says_stock
    stock = (n_ratio > 0) & ~says_cash & (says_stock | (n_cash == 0))
    direct = found["direct"].isNotNull()
    reason = (
        F.when(found["unsupported"], "unsupported_mechanics")
        .when(direct, None)
        .when(mixed, F.when((n_cash > 3) | (n_ratio > 3), "ambiguous_mixed_terms"))
        .when(all_cash, F.when(n_cash > 4, "too_many_cash_prices"))
        .when(stock, F.when(n_cash > 0, "ambiguous_cash_and_ratio").when(n_ratio > 3, "ambiguous_ratios"))
        .otherwise("not_mapped")
    )
    kind = F.when(reason.isNull(), F.when(direct, "cash").when(mixed, "mixed").when(all_cash, "cash").otherwise("stock"))
    return F.struct(
        kind.alias("consideration_type"),
        F.when(direct & kind.isNotNull(), found["direct"]["price"]).when(kind.isin("cash", "mixed"), price).alias("offer_price"),
        F.when(kind == "mixed", rate).when(kind == "stock", F.array_min(ratio)).alias("exchange_ratio"),
        F.when(~found["unsupported"], F.when(direct, found["direct"]["name"]).otherwise(found["acquirer"])).alias("acquirer"),
        reason.alias("reason"),
    )
