"""License scans by fuzzy short-notice search.

A notice is found where a text comes within ``len(notice) // LETTERS_PER_ERROR`` edits of it. With k edits allowed, a
notice is split into k + 1 pieces, one of which any such place holds unchanged; an Aho-Corasick automaton over
all pieces finds those seeds in one pass. Around each seed stands a window of the notice's length and k on either side;
one that holds too few of the notice's trigrams to be within k edits is dropped, the others are laid together to
stretches of at most twice their length, in each of which the regex library's bounded-error matching verifies the edits and
reports the span. So time grows with the text, however repetitive it is. Both work on the words of the lower-cased text
joined by single spaces, so spans are given in words of the document.

Beside that, exact phrases are counted where their words stand consecutively.

Defined cases: a null text counts as empty and has no label; overlapping places of a phrase all count; of
overlapping fuzzy finds the one with the fewest edits stays, then the first, then the longer one; repeated rows are
scanned one by one; a text of any length is scanned whole; an empty table gives an empty result; other columns than
doc_id and text are not looked at, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

#: Phrases whose places count, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Short notices, with their labels.
NOTICES = {
    "released under the mit license": "MIT",
    "licensed under the mit license": "MIT",
    "permission is hereby granted free of charge to any person obtaining a copy": "MIT",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "ISC",
    "licensed under the apache license version 2 0": "Apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "Apache-2.0",
    "licensed under the gnu general public license version 2": "GPL-2.0",
    "licensed under the gnu general public license version 3": "GPL-3.0",
    "either version 2 of the license or at your option any later version": "GPL-2.0-or-later",
    "either version 3 of the license or at your option any later version": "GPL-3.0-or-later",
    "everyone is permitted to copy and distribute verbatim copies of this license document": "GPL",
    "licensed under the gnu lesser general public license": "LGPL",
    "licensed under the gnu affero general public license": "AGPL",
    "redistribution and use in source and binary forms with or without modification": "BSD",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse": "BSD-3-Clause",
    "licensed under cc by nc 4 0": "CC-BY-NC-4.0",
    "licensed under cc by sa 4 0": "CC-BY-SA-4.0",
    "licensed under cc by nd 4 0": "CC-BY-ND-4.0",
    "creative commons attribution 4 0 international": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international": "CC-BY-NC-4.0",
    "creative commons attribution noderivatives 4 0 international": "CC-BY-ND-4.0",
    "cc0 1 0 universal public domain dedication": "CC0-1.0",
    "subject to the terms of the mozilla public license": "MPL",
    "made available under the terms of the eclipse public license": "EPL",
    "subject to the terms of the common development and distribution license": "CDDL",
    "distributed under the boost software license version 1 0": "BSL-1.0",
    "this software is provided as is without any express or implied warranty": "Zlib",
    "distributed under the terms of the artistic license 2 0": "Artistic-2.0",
    "licensed under the european union public licence": "EUPL",
    "licensed under the microsoft public license": "MS-PL",
    "licensed under the python software foundation license": "PSF",
    "licensed under the sil open font license version 1 1": "OFL-1.1",
    "made available under the open database license": "ODbL",
    "licensed under the business source license 1 1": "BUSL-1.1",
    "licensed under the server side public license": "SSPL",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "all-rights-reserved",
}
LETTERS_PER_ERROR = 12

#: Bytes that end a word become spaces, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,notice:string,first_word:long,last_word:long,edits:long>>"
)


class Notice(NamedTuple):
    text: str
    label: str
    edits: int
    pattern: regex.Pattern
    trigrams: Counter

    @property
    def window(self) -> int:
        """Letters around a seed that hold any place of the notice with the seed in it."""
        return len(self.text) + 2 * self.edits

    def possible(self, part: str) -> bool:
        """Whether a stretch holds as many of the trigrams as ``edits`` edits leave; each edit breaks three at most."""
        held = Counter(trigrams(part))
        return sum(min(n, held[g]) for g, n in self.trigrams.items()) >= len(self.text) - 2 - 3 * self.edits


def trigrams(line: str) -> list[str]:
    return [line[i : i + 3] for i in range(len(line) - 2)]


class Scanner:
    """Notices compiled once for a task."""

    def __init__(self, notices: dict[str, str] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.phrases = {f" {p} ": label for p, label in phrases.items()}
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (text, label) in enumerate(notices.items()):
            k = len(text) // LETTERS_PER_ERROR
            self.notices.append(Notice(text, label, k, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}"), Counter(trigrams(text))))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(text[a:b], []).append((n, a))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()

    def stretches(self, line: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the stretches to search; every window around a seed that can hold the notice lies within one."""
        starts: dict[int, set[int]] = {}
        for end, (length, uses) in self.seeds.iter(line):
            for n, at in uses:
                starts.setdefault(n, set()).add(end - length + 1 - at - self.notices[n].edits)
        out: dict[int, list[tuple[int, int]]] = {}
        for n, found in starts.items():
            notice, own = self.notices[n], []
            for start in sorted(found):
                lo, hi = max(0, start), min(start + notice.window, len(line))
                if own and hi <= own[-1][0] + 2 * notice.window and lo <= own[-1][1]:
                    own[-1] = (own[-1][0], hi)
                else:
                    own.append((lo, hi))
            if own := [(lo, hi) for lo, hi in own if notice.possible(line[lo:hi])]:
                out[n] = own
        return out

    def near(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, edits) of the finds in the joined words; of overlapping ones the one with the fewest edits."""
        found = set()
        for n, spans in self.stretches(line).items():
            notice, known = self.notices[n], {}
            for lo, hi in spans:
                part = line[lo:hi]
                if part not in known:  # repetitive texts repeat their stretches
                    known[part] = finds(notice, part)
                found |= {(edits, lo + start, -lo - end, n) for edits, start, end in known[part]}
        taken: list[tuple[int, int]] = []  # spans that don't overlap, in order
        best = []
        for edits, start, end, n in sorted(found):
            end = -end
            i = bisect_left(taken, (start, end))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or end <= taken[i][0]):
                insort(taken, (start, end))
                best.append((n, start, end, edits))
        return sorted(best)

    def scan(self, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        line = b" ".join(words).decode("utf-8", "replace")
        framed = f" {line} "
        places: list[int] = []
        base: set[str] = set()
        for phrase, label in self.phrases.items():
            at = framed.find(phrase)
            while at >= 0:
                places.append(at)
                base.add(label)
                at = framed.find(phrase, at + 1)
        near = self.near(line)
        gaps = np.array([i for i, c in enumerate(line) if c == " "]) if places or near else None
        word_at = lambda at: int(np.searchsorted(gaps, at))
        spans, score = [], 1.0 if base else 0.0
        for n, start, end, edits in near:
            notice = self.notices[n]
            spans.append({"label": notice.label, "notice": notice.text, "first_word": word_at(start), "last_word": word_at(end - 1), "edits": edits})
            score = max(score, 1 - edits / len(notice.text))
        labels = base | {s["label"] for s in spans}
        ends = (word_at(min(places)), word_at(max(places))) if places else (None, None)
        return len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


def finds(notice: Notice, part: str) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the notice's places in a stretch: the best one, then those before and behind it."""
    out, todo = [], [(0, len(part))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= len(notice.text) - notice.edits and (m := notice.pattern.search(part, lo, hi)) and m.end() > m.start():
            out.append((sum(m.fuzzy_counts), m.start(), m.end()))
            todo += [(lo, m.start()), (m.end(), hi)]
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: its phrase places, labels, score, and the spans of the notices found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        span = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(span))
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scanner.scan(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query."""
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("spans").cast("long").alias("n_spans"))
