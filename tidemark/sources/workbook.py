"""Spreadsheets (xlsx) as rows of cells: tracked prices out of them, reports into them, an audit of both."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ordering import small

CELLS = "file string, sheet string, row int, col int, text string, number double, formula string"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
HEADER_ROW = 4
#: Rows that a report may have.
MOST_ROWS = 100_000
#: Sheets (a parameter of ``tracked_prices``), and which of their columns hold which series (a header that contains one of the words).
TRACKED = (
    ("Market Log", "SP500", ("s&p 500", "s&p")), ("Market Log", "NASDAQCOM", ("nasdaq",)), ("Oil Tracker", "DCOILWTICO", ("wti",)), ("Oil Tracker", "DCOILBRENTEU", ("brent",)),
)


def column_number(reference: str) -> int:
    """28 for AB7."""
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n


def column_name(n: int) -> str:
    return column_name((n - 1) // 26) + chr(65 + (n - 1) % 26) if n else ""


def cells_of(content: bytes) -> Iterator[tuple]:
    """sheet, row, col, text, number, formula of each cell that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, shared = set(z.namelist()), []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
            target = targets[sheet.get(LINK)]
            for c in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{MAIN}c"):
                kind, value, formula = c.get("t", "n"), c.findtext(f"{MAIN}v"), c.findtext(f"{MAIN}f")
                text = shared[int(value)] if kind == "s" else "".join(t.text or "" for t in c.iter(f"{MAIN}t")) if kind == "inlineStr" else value
                if text is not None or formula:
                    at = c.get("r")
                    yield sheet.get("name"), int(re.search(r"\d+", at)[0]), column_number(at), text, float(text) if kind == "n" and text else None, formula


def cells(spark: SparkSession, path: str) -> DataFrame:
    """All cells of the workbooks at ``path``; a file is read whole in one task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                yield pd.DataFrame([(file, *c) for c in cells_of(content)], columns=[x.split()[0] for x in CELLS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CELLS)


def written_day(text: Column, year: int = 2026) -> Column:
    """A date written as ``Apr 20`` or ``Apr 20 2026``; null for anything else."""
    plain = F.trim(text)
    full = F.concat_ws(" ", F.regexp_extract(plain, r"^([A-Z][a-z]{2})\s+(\d{1,2})(?:\s+(\d{4}))?$", 1), F.regexp_extract(plain, r"^([A-Z][a-z]{2})\s+(\d{1,2})(?:\s+(\d{4}))?$", 2), F.coalesce(F.nullif(F.regexp_extract(plain, r"(\d{4})$", 1), F.lit("")), F.lit(str(year))))
    return F.try_to_timestamp(full, F.lit("MMM d yyyy")).cast("date")


def tracked_prices(sheets: DataFrame, calendar: DataFrame, tracked: Sequence[tuple] = TRACKED) -> DataFrame:
    """series_id, obs_date, close of the tracked series on sessions; what isn't a number is a null close, counted but no price.

    Headers stand in row 4, days in the first column below. Of several words for a series' header the first that any header has counts.
    """
    spark = sheets.sparkSession
    words = spark.createDataFrame([(s, i, k, w) for s, i, ws in tracked for k, w in enumerate(ws)], "sheet string, series_id string, k int, word string")
    heads = sheets.where(F.col("row") == HEADER_ROW).select("file", "sheet", "col", F.lower(F.trim("text")).alias("head"))
    fits = heads.join(small(words), "sheet").where(F.contains("head", F.col("word")))
    columns = fits.groupBy("file", "sheet", "series_id").agg(F.min_by("col", F.struct("k", "col")).alias("col"))
    below = sheets.where(F.col("row") > HEADER_ROW)
    days = below.where("col = 1").select("file", "sheet", "row", written_day(F.col("text")).alias("obs_date")).where("obs_date is not null")
    days = days.join(small(calendar.where("is_trading").select("obs_date")), "obs_date")
    asked = days.join(small(columns), ["file", "sheet"])
    return asked.join(below.select("file", "sheet", "row", "col", "number"), ["file", "sheet", "row", "col"], "left").select("series_id", "obs_date", F.col("number").alias("close"))


def phantom_rows(sheets: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows dated on days without a session, and whether they carry a price; ``CLOSED``, a dash or ``n/d`` beside the day is benign."""
    below = sheets.where(F.col("row") > HEADER_ROW)
    days = below.where("col = 1").select("file", "sheet", "row", written_day(F.col("text")).alias("obs_date")).where("obs_date is not null")
    shut = days.join(small(calendar.where("not is_trading").select("obs_date")), "obs_date")
    beside = below.where("col = 2").select("file", "sheet", "row", F.trim("text").alias("beside"))
    return shut.join(beside, ["file", "sheet", "row"], "left").select("sheet", "row", "obs_date", (~F.coalesce(F.col("beside").isin("CLOSED", "—", "n/d"), F.lit(False))).alias("carries_a_price"))


def formula_counts(sheets: DataFrame) -> DataFrame:
    return sheets.groupBy("file", "sheet").agg(F.count("formula").alias("formulas"), F.count("*").alias("cells"))


def write_workbook(path: str, tables: dict[str, DataFrame], formulas: dict[str, dict[str, str]] | None = None) -> None:
    """Reports as sheets of one workbook: a header row, then the rows; at most ``MOST_ROWS`` each, as a report is for reading.

    ``formulas`` gives a sheet's computed columns as arithmetic over its other columns, ``{offer} - {price}``. Spark computes
    the value that is stored beside the formula, so ``formula_errors`` can compare the two later.
    """
    formulas, sheets = formulas or {}, []
    for name, df in tables.items():
        computed = formulas.get(name, {})
        for c, f in computed.items():
            df = df.withColumn(c, F.expr(re.sub(r"\{(\w+)\}", r"`\1`", f)))
        rows = df.limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has over {MOST_ROWS} rows")
        letters = {c: column_name(i + 1) for i, c in enumerate(df.columns)}
        lines = ["".join(f'<c r="{letters[c]}1" t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in df.columns)]
        for n, row in enumerate(rows, 2):
            line = ""
            for c in df.columns:
                at, value = f"{letters[c]}{n}", row[c]
                f = "<f>" + escape(re.sub(r"\{(\w+)\}", lambda m: f"{letters[m[1]]}{n}", computed[c])) + "</f>" if c in computed else ""
                if value is None:
                    line += f'<c r="{at}">{f}</c>' if f else ""
                elif isinstance(value, (int, float)) and not isinstance(value, bool):
                    line += f'<c r="{at}">{f}<v>{value!r}</v></c>'
                else:
                    line += f'<c r="{at}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'
            lines.append(line)
        sheets.append((name, "".join(f'<row r="{i}">{x}</row>' for i, x in enumerate(lines, 1))))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel, kind = "http://schemas.openxmlformats.org/package/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{rel}"><Relationship Id="r1" Type="{kind}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{kind}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rel}">' + "".join(f'<Relationship Id="r{i}" Type="{kind}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, body) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    spark = next(iter(tables.values())).sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    stream.write(bytearray(out.getvalue()))
    stream.close()


def formula_errors(sheets: DataFrame, sheet: str, formulas: dict[str, str]) -> DataFrame:
    """Rows of a written sheet whose stored value isn't what its formula gives over the row's other cells."""
    own = sheets.where(F.col("sheet") == sheet)
    heads = small(own.where("row = 1").select("col", F.col("text").alias("name")))
    names = [r["name"] for r in heads.orderBy("col").collect()]
    wide = own.where("row > 1").join(heads, "col").groupBy("row").pivot("name", names).agg(F.first("number"))
    wrong = [F.when(~F.col(f"`{c}`").eqNullSafe(F.expr(re.sub(r"\{(\w+)\}", r"`\1`", f))), F.lit(c)) for c, f in formulas.items()]
    return wide.select("row", F.explode(F.array_compact(F.array(*wrong))).alias("column"))
