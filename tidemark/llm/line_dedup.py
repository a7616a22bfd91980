"""Line dedup by winnowing over line hashes.

A line is what newlines separate, without ASCII white space at its ends; blank lines count for nothing and stay. A run
is ``window`` or more consecutive lines of one document, or a single line of ``long_line`` words or more. Each window
of lines selects its least line hash, the last of equal ones, and a selected position is a fingerprint once, however
many windows select it: 2 / (window + 1) of all lines. Two places of the same run select the same lines of it, so
positions whose line is selected nowhere else are dropped by a join on the fingerprint. The positions that stay
are extended both ways, over the lines before and behind them, to the windows that selected them; runs longer
than a window are found piece by piece, as each of their windows selects a line. An extension that stood
before, in an earlier document (by doc_id, then by a hash of the text) or earlier in the same one, is deleted; the first
place of every run stays. Lines are compared by 128 bits of hash.

Defined cases: a null text stays null and counts no lines; an empty text has no lines; a document below ``window`` lines
loses long lines only; a text of any length is read whole in one row of a task; rows that repeat id and text are one
document for this purpose and come out alike; ties cannot arise between different documents, as their text hashes
differ; null ids come before all others; an empty table gives an empty result; extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import checkpointed, fresh, row_key

#: Lines of the shortest run that is deleted, which is also the winnowing window.
WINDOW = 2
#: Words of a line that is a run by itself.
LONG_LINE = 10

BLANK = " \t\n\v\f\r"
SELECTED = "print long, size int, known int, key_id long, key_hash long, first int, wholes array<long>"


def line_hashes(text: str, long_line: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each non-blank line, and whether it has ``long_line`` words."""
    lines = [x for x in (x.strip() for x in text.encode("utf-8", "surrogatepass").split(b"\n")) if x]
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), ">u8").astype(np.uint64).reshape(-1, 2)
    return both, np.fromiter((len(x.split()) >= long_line for x in lines), bool, len(lines))


def selected(hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window the position of its least hash, the last of equal ones."""
    every = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.arange(len(every)) + window - 1 - every[:, ::-1].argmin(axis=1)


def fingerprints(hashes: np.ndarray, is_long: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The selected positions of a document, each once: fingerprints, lines a window has, first window that selects
    each, number of such windows, and the hash of all lines of each of these windows in turn."""
    if len(hashes) >= window:
        at = selected(hashes[:, 0], window)
        opens = np.flatnonzero(np.diff(at, prepend=-1))
        every = np.lib.stride_tricks.sliding_window_view(hashes[:, 1], window)
        whole = np.fromiter((xxhash.xxh64_intdigest(w.tobytes(), 13) for w in every), np.uint64, len(every)) if window > 1 else hashes[:, 1]
        yield hashes[at[opens], 0], window, opens, np.diff(opens, append=len(at)), whole
    if window > 1 and is_long.any():
        at = np.flatnonzero(is_long)
        yield hashes[at, 0], 1, at, np.ones(len(at), np.int64), hashes[at, 1]


def positions(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """One row for each selected position of each document."""
    names = [c.split()[0] for c in SELECTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(8)]
            for known, a, b, text in zip(*(batch.column(c).to_pylist() for c in ("known", "key_id", "key_hash", "text"))):
                for prints, size, first, count, whole in fingerprints(*line_hashes(text or "", long_line), window):
                    n = len(prints)
                    parts = (prints.view(np.int64), np.full(n, size, np.int32), np.full(n, known, np.int32), np.full(n, a), np.full(n, b), first.astype(np.int32), count, whole.view(np.int64))
                    for c, p in zip(columns, parts):
                        c.append(p)
            if columns[0]:
                *plain, count, whole = (np.concatenate(c) for c in columns)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(whole))
                yield pa.RecordBatch.from_arrays([*map(pa.array, plain), lists], names=names)

    rows = docs.select(F.col("doc_id").isNotNull().cast("int").alias("known"), *row_key(), "text")
    return rows.mapInArrow(run, SELECTED)


def repeated_runs(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """key_id, key_hash, runs: the runs (first line, by number among non-blank ones, and lines) that stood before."""
    prints = checkpointed(positions(docs, window, long_line))
    # counts are summed up before the shuffle; a line that very many documents hold is split by the engine's skew join
    twice = prints.groupBy("print", "size").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    joined = checkpointed(prints.join(twice, ["print", "size"]))
    extended = joined.select("print", "size", "known", "key_id", "key_hash", "first", F.posexplode("wholes").alias("i", "whole"))
    extended = extended.select("print", "size", "whole", "known", "key_id", "key_hash", (F.col("first") + F.col("i")).alias("start"))
    place = F.struct("known", "key_id", "key_hash", "start")
    first = extended.groupBy("print", "size", "whole").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = extended.join(first, ["print", "size", "whole"]).where(place > F.col("earliest"))
    return later.groupBy("key_id", "key_hash").agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("runs"))


def without_lines(text: str | None, runs: list[dict] | None) -> tuple[str | None, int, int]:
    """The text without the lines of ``runs``; its number of non-blank lines, and of deleted ones."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    at = [i for i, x in enumerate(lines) if x.strip(BLANK)]
    if not runs:
        return text, len(at), 0
    gone = {at[r["start"] + j] for r in runs for j in range(r["size"])}
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(at), len(gone)


def deduplicated(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """The columns of ``docs`` with the text deduplicated, and ``n_lines``, ``n_removed`` (renamed if they clash)."""
    kid, khash, found, total, gone = fresh(docs, "key_id", "key_hash", "runs", "n_lines", "n_removed")
    runs = repeated_runs(docs, window, long_line).select(F.col("key_id").alias(kid), F.col("key_hash").alias(khash), F.col("runs").alias(found))
    keyed = docs.select("*", *(c.alias(a) for c, a in zip(row_key(), (kid, khash))))
    joined = keyed.join(runs, [kid, khash], "left").select(*docs.columns, found)
    schema = StructType([*docs.schema.fields, StructField(total, LongType()), StructField(gone, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [without_lines(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column(found).to_pylist())]
            new = {"text": pa.array([r[0] for r in rows], pa.string()), total: pa.array([r[1] for r in rows], pa.int64()), gone: pa.array([r[2] for r in rows], pa.int64())}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in schema.names], names=schema.names)

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """The columns of ``docs``; text without repeated runs, and n_chars, where there is one, to match."""
    out = deduplicated(docs, window, long_line).select(*docs.columns)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(docs: DataFrame, window: int = WINDOW, long_line: int = LONG_LINE) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document."""
    out = deduplicated(docs.select("doc_id", "text"), window, long_line)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: The digest in DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE t <> ''),
w AS (SELECT doc_id, k, t, lead(t) OVER (PARTITION BY doc_id ORDER BY k) AS t2 FROM n),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, k) AS seen FROM w WHERE t2 IS NOT NULL),
s AS (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS seen FROM n WHERE len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 10),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest([k, k + 1]) AS k FROM f WHERE seen > 1 UNION ALL SELECT doc_id, k FROM s WHERE seen > 1)),
marked AS (SELECT l.doc_id, l.i, l.line, n.k IS NOT NULL AS counts, gone.k IS NOT NULL AS gone
  FROM l LEFT JOIN n ON l.doc_id = n.doc_id AND l.i = n.i LEFT JOIN gone ON n.doc_id = gone.doc_id AND n.k = gone.k)
SELECT doc_id, count(*) FILTER (counts)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL SELECT doc_id, 0::BIGINT, 0::BIGINT, NULL FROM documents WHERE text IS NULL
"""
