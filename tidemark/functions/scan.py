"""What single texts say, one pass a text: the helpers behind the columns of ``extract`` and ``listing``.

One automaton finds all trigger words of a text; a pattern is tried only where a trigger of its own stands, at it or in
the stretch before it that the pattern can reach. Patterns that begin with digits or a parenthesis need no trigger. Case,
white space and word boundaries are those of ASCII.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache, lru_cache

import pyarrow as pa

from tidemark.config import NAME_FILLER
from tidemark.functions import extract, listing

EXCHANGES = ("(nyse", "(nasdaq")
SPONSORS = ("permira", "canada pension", "blackstone", "kkr", "carlyle", "thoma bravo", "vista equity", "silver lake", "apollo", "bain capital", "tpg", "warburg pincus", "hellman")
SIDES = (("to be", "will be"), ("acquired",), ("affiliate",), SPONSORS)
ENDS = ("will acquire", "to acquire", "has agreed to acquire")
MECHANICS = ("elect", "holder", "proration", "volume", "vwap", "contingent", "cvr", "floating", "collar")
CASH_WORDS = ("all-cash", "all cash", "in cash", "cash consideration", "cash transaction")
STOCK_WORDS = ("exchange ratio", "shares of")
ROLES = tuple(f"({quote}{role}" for quote in ("", '"') for role in ("parent", "purchaser", "buyer"))
#: The triggers of each pattern of prices and ratios; None: it begins with digits.
CASH = (("$",), ("$",), ("cash",), ("acquire",), ("cash",), ("per",), ("merger",), ("$",))
RATIO = (("exchange",), None, None)
NAME, FLAG = pa.string(), pa.bool_()
NAMES, NUMBERS = pa.list_(NAME), pa.list_(pa.float64())
TERMS = pa.struct([("unsupported", FLAG), ("direct", pa.struct([("name", NAME), ("price", pa.float64())])), ("cash", NUMBERS), ("ratio", NUMBERS), ("acquirer", NAME), ("cash_words", FLAG), ("names_cash", FLAG), ("says_stock", FLAG)])
IDENTITY = pa.struct([("historical_ticker", NAME), ("exchange", NAME), ("evidence_location", NAME), ("header_ticker", NAME), ("dei_tickers", NAMES), ("cover_ticker", NAME), ("name_adjacent_ticker", NAME), ("n_parenthetical", pa.int32())])
#: Letters that a buyer's name can take before a trigger, with the words that may lead it.
REACH = 110


@cache
def automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for words in (*SIDES, EXCHANGES, ENDS, MECHANICS, CASH_WORDS, STOCK_WORDS, ROLES, *CASH, *filter(None, RATIO), ("acquired by", "acquisition by", "would acquire", "agreement and plan of merger", "merger agreement", "parent", "purchaser", "buyer", "proposed", "pending")):
        for word in words:
            machine.add_word(word, word)
    machine.make_automaton()
    return machine


@cache
def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.ASCII)


class Text:
    """A text and where its trigger words stand."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.at: dict[str, list[int]] = defaultdict(list)
        lowered = text.lower()
        if len(lowered) != len(text):
            lowered = "".join(c.lower() if c.isascii() else c for c in text)
        self.lowered = lowered
        for end, word in automaton().iter(lowered):
            self.at[word].append(end - len(word) + 1)

    def places(self, words: tuple[str, ...]) -> list[int]:
        return self.at[words[0]] if len(words) == 1 else sorted({p for w in words for p in self.at[w]})

    def matches(self, pattern: str, words: tuple[str, ...] | None) -> Iterator[re.Match]:
        """All matches of a pattern that begins with one of its triggers."""
        if words is None:
            yield from compiled(pattern).finditer(self.text)
            return
        end = 0
        for p in self.places(words):
            if p >= end and (m := compiled(pattern).match(self.text, p)):
                yield m
                end = m.end()

    def first(self, pattern: str, words: tuple[str, ...]) -> re.Match | None:
        return next(self.matches(pattern, words), None)

    def has(self, pattern: str, words: tuple[str, ...]) -> bool:
        return self.first(pattern, words) is not None

    def before(self, pattern: str, words: tuple[str, ...], reach: int = REACH, behind: int = 0, needs: tuple[str, ...] = ("",)) -> Iterator[re.Match]:
        """All matches of a pattern that leads up to its trigger from at most ``reach`` letters before the white space
        there. If the trigger opens a parenthesis, ``behind`` letters after that one closes belong to the pattern too, and one of ``needs`` stands there."""
        text, end = self.text, 0
        for p in self.places(words):
            if p < end:
                continue
            start = p
            while start and text[start - 1] in " \t\n\r\f\v":
                start -= 1
            if start and text[start - 1] == ")":  # a note in parentheses may stand between
                opened = text.find("(", text.rfind(")", 0, start - 1) + 1, start)
                start = opened if opened >= 0 else start
                while start and text[start - 1] in " \t\n\r\f\v":
                    start -= 1
            stop = text.find(")", p) + 1 + behind if text[p] == "(" else p + max(map(len, words))
            if stop > p and any(x in self.lowered[p:stop] for x in needs) and (m := compiled(pattern).search(text, max(end, start - reach), min(stop, len(text)))):
                yield m
                end = m.end()


def tidy(name: str, around: str = " ,.;") -> str:
    return compiled(r"\s+").sub(" ", name).strip(around)


def cleaned(raw: str | None) -> str | None:
    """A buyer's name without what press releases glue to it; None if no name of 3 to 80 letters remains."""
    name = tidy(raw or "")
    for pattern, put in extract.NAME_RESIDUE:
        name = tidy(compiled(pattern).sub(put, name))
    if not 3 <= len(name) <= 80 or name.lower() in extract.ROLES:
        return None
    return compiled(r"(?i)\s+AFFILIATE\s*$").sub("", name).strip(" ") or None


def rounded(x: float, digits: int) -> float:
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def sides(t: Text) -> Iterator[tuple[str | None, str | None]]:
    """By each pattern of the target's side the buyer and the price, as they stand there."""
    for pattern, words in zip(extract.TARGET_SIDE_CASH[:3], SIDES):
        m = t.first(pattern, words)
        yield (m[1], m[2]) if m else (None, None)
    pattern = compiled(extract.TARGET_SIDE_CASH[3])
    for p in t.places(SPONSORS):
        lead = compiled(r"(?i)the\s+$").search(t.text, max(0, p - 20), p) if t.text[p : p + 7].lower() == "permira" else None
        m = (lead and pattern.match(t.text, lead.start())) or pattern.match(t.text, p)
        if m:
            yield m[1], m[2]
            return
    yield None, None


def acquirers(t: Text) -> Iterator[str | None]:
    """The buyer's name by each of the acquirer patterns, as it stands there."""
    listed, will_be, by, would, listed_too = extract.ACQUIRER_PATTERNS
    for m in (
        next(t.before(listed, EXCHANGES, behind=120 + len("will acquire"), needs=ENDS[:1]), None),
        t.first(will_be, ("will be",)),
        t.first(by, ("acquired by", "acquisition by", "to be")),
        next(t.before(would, ("would acquire",)), None),
        next(t.before(listed_too, EXCHANGES, behind=80 + len("has agreed to acquire"), needs=ENDS), None),
    ):
        yield m[1] if m else None


def terms(text: str | None, head: int) -> dict:
    t = Text((text or "")[:head])
    direct = None
    for raw, price in sides(t):
        name = cleaned(raw)
        if direct is None and name and 0.5 <= float(price) <= 5000:
            direct = {"name": name, "price": float(price)}
    numbers = lambda patterns, words: [float(m[1]) for p, w in zip(patterns, words) for m in t.matches(p, w)]
    acquirer = None
    for raw in acquirers(t):
        name = tidy(raw or "", " ,.")
        if acquirer is None and 3 <= len(name) <= 80 and "stockholder" not in name.lower():
            acquirer = name
    if acquirer is None and (m := t.first(extract.ACQUIRED_BY, ("to be", "will be"))):
        acquirer = cleaned(m[1])
    return {
        "unsupported": t.has(extract.MECHANICS, MECHANICS),
        "direct": direct,
        "cash": [rounded(v, 4) for v in numbers(extract.CASH_PATTERNS, CASH) if 0.5 <= v <= 5000],
        "ratio": [rounded(v, 6) for v in numbers(extract.RATIO_PATTERNS, RATIO) if 0 < v < 50],
        "acquirer": acquirer,
        "cash_words": t.has(extract.CASH_WORDS, CASH_WORDS),
        "names_cash": t.has(r"(?i)\bcash\b", ("cash",)),
        "says_stock": t.has(extract.STOCK_WORDS, STOCK_WORDS),
    }


def buyers(text: str | None, buyer_head: int, party_head: int) -> list[str]:
    t, whole = Text((text or "")[:buyer_head]), Text((text or "")[:party_head])
    found = [raw for raw, _ in sides(t)]
    m = t.first(extract.ACQUIRED_BY, ("to be", "will be"))
    found += [m[1] if m else None, *acquirers(t)]
    for m in t.before(extract.ACQUIRES, ENDS):
        raw = m[1].strip()
        if raw.lower() not in extract.SHELLS and not raw.lower().startswith(extract.SHELL_STARTS) and not compiled(extract.INTENT).search(raw):
            found.append(raw)
    found += [m[1].strip() for m in whole.matches(extract.AMONG, ("agreement and plan of merger", "merger agreement")) if m[1].strip().lower() not in extract.AMONG_SHELLS]
    found += [m[1] for m in whole.matches(extract.QUOTED_ROLE, ("parent", "purchaser", "buyer"))]
    found += [m[1] for m in whole.before(extract.ROLE_BEHIND, ROLES)]
    found += [m[1] for m in t.matches(extract.PENDING, ("proposed", "pending"))]
    return list(dict.fromkeys(name for raw in found if (name := cleaned(raw))))


def stripped(html: str) -> str:
    """As ``text.html_strip``."""
    x = compiled(r"(?is)<(script|style)[^>]*>.*?</(script|style)>").sub(" ", html)
    x = compiled(r"(?s)<[^>]+>").sub(" ", x)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = x.replace(entity, char)
    return compiled(r"\s+").sub(" ", x).strip(" ")


def telling(name: str) -> list[str]:
    """As ``text.significant_tokens``; only the longer words, if there are any."""
    words = [w for w in re.sub("[^a-z0-9 ]+", " ", name.lower().replace("&", " and ")).split(" ") if w and w not in NAME_FILLER]
    return list(dict.fromkeys([w for w in words if len(w) >= 4] or words))


def adjacent(plain: str | None, target: str | None) -> str | None:
    words, hits = telling(target or ""), defaultdict(list)
    for m in compiled(listing.PARENTHESIS).finditer(plain or ""):
        window = plain[max(0, m.start() - listing.REACH) : m.start()].lower()
        hits[sum(w in window for w in words)].append(m[1].upper())
    best = max(hits, default=0)
    named = set(hits[best])
    return named.pop() if best and len(named) == 1 else None


def identity(raw: str | None, target: str | None, filer_is_target: bool | None) -> dict:
    raw = raw or ""
    plain = stripped(raw)
    first = lambda pattern, text: m[1] or None if (m := compiled(pattern).search(text)) else None
    upper = lambda x: x and x.upper()
    telling_only = lambda x: x if x and x not in listing.NO_TICKERS else None
    header = upper(first(listing.HEADER_TICKER, raw))
    tags = list(dict.fromkeys(x for m in compiled(listing.TAGGED_TICKER).finditer(raw) if (x := m[1].upper()) not in listing.NO_TAGS))
    at = plain.lower().find("trading symbol")
    cover = telling_only(upper(first(listing.COVER_TICKER, plain[at : at + 600]))) if at >= 0 else None
    near = adjacent(plain, target)
    ticker = place = None
    if filer_is_target and tags:
        ticker, place = next((x for x in tags if telling_only(x)), None), "dei:TradingSymbol"
    elif filer_is_target and cover:
        ticker, place = cover, "8-K_cover_trading_symbol"
    elif filer_is_target and telling_only(header):
        ticker, place = header, "SEC_HEADER_TICKER"
    elif telling_only(near):
        ticker, place = near, "parenthetical_ticker_adjacent_to_target_name"
    exchange = first(listing.HEADER_EXCHANGE, raw)
    return {
        "historical_ticker": ticker,
        "exchange": first(listing.EXCHANGE, plain) if exchange is None else compiled(r"\s+").sub(" ", exchange).strip(" "),
        "evidence_location": place if ticker else None,
        "header_ticker": header,
        "dei_tickers": tags,
        "cover_ticker": cover,
        "name_adjacent_ticker": near,
        "n_parenthetical": sum(1 for _ in compiled(listing.PARENTHESIS).finditer(plain)),
    }


#: What short rows say is kept, for so many of them, and of so many letters at most, a worker.
KEPT, SHORT = 16_384, 1_000


@lru_cache(KEPT)
def said(of: Callable, row: tuple, bounds: tuple):
    return of(*row, **dict(bounds))


def column(of: Callable, kind: pa.DataType, *columns: pa.Array, **bounds: int) -> pa.Array:
    """``of`` each row of Arrow columns; equal rows of a batch, and short ones that a worker has just seen, are read once."""
    own, values, at = tuple(bounds.items()), [], []
    places: dict[tuple, int] = {}
    for row in zip(*(c.to_pylist() for c in columns)):
        place = places.setdefault(row, len(values))
        if place == len(values):
            short = sum(len(x) for x in row if isinstance(x, str)) <= SHORT
            values.append(said(of, row, own) if short else of(*row, **bounds))
        at.append(place)
    return pa.array(values, kind).take(pa.array(at, pa.int64()))
