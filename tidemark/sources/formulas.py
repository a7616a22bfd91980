"""A gate for workbooks: every cell's own formula is worked out again from the cells that it reads."""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from tidemark.operators.intervals import around, level_of, pieces
from tidemark.operators.ordering import small
from tidemark.sources.workbook import column_number
from tidemark.storage import checkpointed

AT = ["file", "sheet", "row", "col"]
LAST_ROW = 1 << 20
#: The rows of a place that names columns only.
WHOLE = (1, LAST_ROW)
#: Rows of a column are dealt out to so many places.
SALTS = 16
#: After so many rounds what they found is written as one table.
COLLAPSE = 16
#: Files of up to so many cells are worked out by the task that holds them.
FILE_CELLS = 1 << 16
#: Cells of a column that are summed up together.
SPAN = 32
#: Cells of a task, and formulas that it gives at once.
TASK_CELLS, OUT_ROWS = 1 << 19, 10_000
#: What a formula reads is summed up as: numbers, their sum, least and greatest, cells with anything, a cell's text.
READ = "k int, n long, total double, least double, most double, filled long, text string"
PLACES = pa.struct([("refs", pa.list_(pa.struct([("k", pa.int32()), ("sheet", pa.string()), *[(n, pa.int32()) for n in ("c1", "r1", "c2", "r2")]]))), ("problem", pa.string())])
VALUE = pa.struct([("number", pa.float64()), ("text", pa.string())])
TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?![\w!])|(?P<text>"(?:[^"]|"")*")
    |(?P<ref>(?:(?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)?(?:\$?[A-Z]{1,3}\$?\d+(?::\$?[A-Z]{1,3}\$?\d+)?|\$?[A-Z]{1,3}:\$?[A-Z]{1,3})(?![\w(]))
    |(?P<name>[A-Z][A-Z0-9.]*)|(?P<op><=|>=|<>|[-+*/^&=<>(),%]))""",
    re.VERBOSE,
)
#: Operators from the loosest to the tightest.
BINARY = (("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))


class Unreadable(ValueError):
    """A formula that the gate doesn't know."""


class Wrong(ArithmeticError):
    """An error value, such as ``#DIV/0!``."""


def parsed(formula: str) -> tuple[tuple, list[tuple]]:
    """A formula as nested tuples, and the places it reads (sheet or None, first column and row, last column and row)."""
    tokens, at, refs = [], 0, []
    text = formula.removeprefix("=").rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise Unreadable(f"at {at}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    tokens.reverse()

    def take(op: str) -> bool:
        if tokens[-1] == ("op", op):
            tokens.pop()
            return True
        return False

    def need(op: str) -> None:
        if not take(op):
            raise Unreadable(f"{op} is missing")

    def binary(level: int) -> tuple:
        if level == len(BINARY):
            return signed()
        left = binary(level + 1)
        while tokens[-1][0] == "op" and tokens[-1][1] in BINARY[level]:
            left = ("op", tokens.pop()[1], left, binary(level + 1))
        return left

    def signed() -> tuple:
        if take("-"):
            return ("op", "-", ("value", 0.0), signed())
        if take("+"):
            return signed()
        x = atom()
        while take("%"):
            x = ("op", "/", x, ("value", 100.0))
        return x

    def atom() -> tuple:
        kind, word = tokens.pop()
        if kind == "number":
            return ("value", float(word))
        if kind == "text":
            return ("value", word[1:-1].replace('""', '"'))
        if kind == "ref":
            if (where := place(word)) not in refs:
                refs.append(where)
            return ("ref", refs.index(where))
        if kind == "name" and word in ("TRUE", "FALSE") and tokens[-1] != ("op", "("):
            return ("value", word == "TRUE")
        if kind == "name":
            need("(")
            args = []
            if not take(")"):
                args.append(binary(0))
                while take(","):
                    args.append(binary(0))
                need(")")
            if word not in FUNCTIONS and word not in LAZY or not (FUNCTIONS | LAZY)[word][0] <= len(args) <= (FUNCTIONS | LAZY)[word][1]:
                raise Unreadable(f"{word} of {len(args)}")
            return ("call", word, *args)
        if (kind, word) == ("op", "("):
            x = binary(0)
            need(")")
            return x
        raise Unreadable(word or "it ends early")

    tree = binary(0)
    if tokens[-1][0] != "end":
        raise Unreadable(tokens[-1][1])
    return tree, refs


#: Formulas that differ in the rows they name only are read once; so many kinds are kept.
KINDS = 65_536
DIGITS = re.compile("([0-9]+)")
#: Of formulas by what stands around their digits, which of these are rows.
shapes: dict[tuple[str, ...], list[int]] = {}


def row_runs(formula: str) -> list[int] | None:
    """Which runs of digits of a formula are rows of places; None if it can't be read."""
    skipped = len(formula) - len(formula.removeprefix("="))
    text, at, found = formula[skipped:].rstrip(), 0, []
    starts = [m.start() - skipped for m in DIGITS.finditer(formula)]
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        if m.lastgroup == "ref":
            first = m.start("ref") + m["ref"].rfind("!") + 1
            found += [i for i, start in enumerate(starts) if first <= start < m.end()]
        at = m.end()
    return found


@lru_cache(KINDS)
def kind(parts: tuple[str, ...]) -> tuple[tuple, list[tuple]]:
    """As ``parsed``, for a formula's parts in which each row of a place is its number among those, from one."""
    return parsed("".join(parts))


def read_once(formula: str) -> tuple[tuple, list[tuple]]:
    """As ``parsed``; formulas of one kind (other rows, all else equal) are parsed once."""
    if not formula.isascii():  # other digits than these stand for numbers too
        return parsed(formula)
    parts = DIGITS.split(formula)
    outside = tuple(parts[::2])
    if (rows := shapes.get(outside)) is None:
        if (rows := row_runs(formula)) is None or len(shapes) >= KINDS:
            return parsed(formula)
        shapes[outside] = rows
    numbers = [int(parts[2 * i + 1]) for i in rows]
    in_order = sorted(set(numbers))  # equal rows stay equal and ends of places in order
    for i, n in zip(rows, numbers):
        parts[2 * i + 1] = str(in_order.index(n) + 1)
    try:
        tree, refs = kind(tuple(parts))
    except Unreadable:
        return parsed(formula)  # the message names what stands there
    return tree, [r if (r[2], r[4]) == WHOLE else (r[0], r[1], in_order[r[2] - 1], r[3], in_order[r[4] - 1]) for r in refs]


def place(word: str) -> tuple:
    sheet, _, cells = word.rpartition("!")
    sheet = sheet[1:-1].replace("''", "'") if sheet.startswith("'") else sheet
    first, _, last = cells.replace("$", "").partition(":")
    last = last or first
    if first.isalpha():
        first, last = f"{first}1", f"{last}{LAST_ROW}"
    columns = sorted(column_number(x) for x in (first, last))
    rows = sorted(int(x.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for x in (first, last))
    return (sheet or None, columns[0], rows[0], columns[1], rows[1])


def worked_out(tree: tuple, read: list[dict], size: list[int]) -> float | str | bool | None:
    """The value of a formula; ``read`` holds what it reads by place, ``size`` the number of cells of each place."""

    def scalar(x: tuple):
        if x[0] == "value":
            return x[1]
        if x[0] == "ref":
            r = read[x[1]]
            if size[x[1]] > 1:
                raise Wrong("#VALUE!")
            if r["n"] == 0 and r["text"] is not None and r["text"].startswith("#"):
                raise Wrong(r["text"])
            return r["total"] if r["n"] else r["text"]
        if x[0] == "op":
            return applied(x[1], scalar(x[2]), scalar(x[3]))
        _, name, *args = x
        if name == "IF":
            return scalar(args[1]) if truth(scalar(args[0])) else scalar(args[2]) if len(args) > 2 else False
        if name == "IFERROR":
            try:
                return scalar(args[0])
            except Wrong:
                return scalar(args[1])
        if name in ("ISNUMBER", "ISBLANK"):
            try:
                v = scalar(args[0])
            except Wrong:
                return False
            return v is None if name == "ISBLANK" else isinstance(v, float) and not isinstance(v, bool)
        if name in SUMMARIES:
            parts = [summary(a) for a in args]
            return SUMMARIES[name](parts)
        return FUNCTIONS[name][2](*[scalar(a) for a in args])

    def summary(x: tuple) -> tuple:
        if x[0] == "ref":
            r = read[x[1]]
            return (r["n"], r["total"] or 0.0, r["least"], r["most"])
        v = number(scalar(x))
        return (1, v, v, v)

    return scalar(tree)


def number(v) -> float:
    if v is None:
        return 0.0
    if isinstance(v, str):
        raise Wrong("#VALUE!")
    return float(v)


def truth(v) -> bool:
    return bool(number(v))


def applied(op: str, a, b):
    if op == "&":
        return "".join("" if v is None else str(v).upper() if isinstance(v, bool) else f"{v:.15g}" if isinstance(v, float) else v for v in (a, b))
    if op in BINARY[0]:
        a, b = ("" if a is None and isinstance(b, str) else a), ("" if b is None and isinstance(a, str) else b)
        key = lambda v: (2, v) if isinstance(v, bool) else (1, v.lower()) if isinstance(v, str) else (0, number(v))
        x, y = key(a), key(b)
        return {"=": x == y, "<>": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
    x, y = number(a), number(b)
    try:
        value = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y if op == "/" else x**y
    except ZeroDivisionError:
        raise Wrong("#DIV/0!") from None
    except OverflowError:
        raise Wrong("#NUM!") from None
    if isinstance(value, complex):
        raise Wrong("#NUM!")
    return value


def mean(parts: list[tuple]) -> float:
    return applied("/", sum(p[1] for p in parts), float(sum(p[0] for p in parts)))


def rounded(v, digits=0.0) -> float:
    """Halves go away from zero."""
    step = 10.0 ** int(number(digits))
    x = abs(number(v)) * step
    return (1 if number(v) >= 0 else -1) * float(int(x + 0.5 + 1e-9)) / step


SUMMARIES = {
    "SUM": lambda parts: sum(p[1] for p in parts), "COUNT": lambda parts: float(sum(p[0] for p in parts)), "AVERAGE": mean,
    "MIN": lambda parts: min((p[2] for p in parts if p[0]), default=0.0), "MAX": lambda parts: max((p[3] for p in parts if p[0]), default=0.0),
}
#: Fewest and most arguments, and what they do; those that look at their arguments themselves do it in ``worked_out``.
LAZY = {"IF": (2, 3), "IFERROR": (2, 2), "ISNUMBER": (1, 1), "ISBLANK": (1, 1)} | {name: (1, 255) for name in SUMMARIES}
FUNCTIONS = {
    "AND": (1, 255, lambda *v: all([truth(x) for x in v])), "OR": (1, 255, lambda *v: any([truth(x) for x in v])), "NOT": (1, 1, lambda v: not truth(v)),
    "ABS": (1, 1, lambda v: abs(number(v))), "ROUND": (1, 2, rounded), "SQRT": (1, 1, lambda v: applied("^", v, 0.5)), "POWER": (2, 2, lambda a, b: applied("^", a, b)),
}


def result(tree: tuple, refs: list[tuple], read: list[dict]) -> tuple[float | None, str | None]:
    """What a formula gives, as a number or as a text (truths are 1 and 0, errors as they are written)."""
    try:
        value = worked_out(tree, read, [(c2 - c1 + 1) * (r2 - r1 + 1) for _, c1, r1, c2, r2 in refs])
        value = 0.0 if value is None else value
    except Wrong as e:
        value = str(e)
    if isinstance(value, bool):
        return None, str(int(value))
    return (float(value), None) if isinstance(value, (int, float)) else (None, value)


def read_by(formulas: DataFrame) -> DataFrame:
    """``formulas`` (file, sheet, row, col, formula, ...) with the places each reads, and why it can't be read where that is so."""

    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for f in texts.to_pylist():
            try:
                refs, problem = read_once(f)[1], None
            except (Unreadable, RecursionError) as e:
                refs, problem = [], f"unreadable: {e}"
            rows.append({"refs": [dict(zip(("k", "sheet", "c1", "r1", "c2", "r2"), (k, *r))) for k, r in enumerate(refs)], "problem": problem})
        return pa.array(rows, PLACES)

    return formulas.withColumn("found", F.arrow_udf(run, from_arrow_type(PLACES))("formula")).select(*formulas.columns, "found.refs", "found.problem")


def with_inputs(asked: DataFrame, cells: DataFrame) -> DataFrame:
    """``asked`` with what its places hold, and how many of their cells have no value yet (``waits``).

    A place is the dyadic pieces of its rows, a column each; cells are summed up by piece, at the levels only that some
    formula asks of their column. So a formula over a million rows reads a few pieces, columns that nobody reads take no
    part, and formulas never meet cells by an inequality. A long column meets its levels in ``SALTS`` places.
    """
    places = asked.select("id", "file", "sheet", F.explode("refs").alias("r")).select("id", "file", "r.k", F.coalesce("r.sheet", "sheet").alias("on"), "r.r1", "r.r2", F.explode(F.sequence("r.c1", "r.c2")).alias("c"))
    wide = places.select("id", "file", "k", "on", "c", F.explode(pieces(F.col("r1"), F.col("r2"))).alias("piece"))
    column = ["file", "on", "c"]
    levels = wide.groupBy(*column).agg(F.collect_set(level_of(F.col("piece"))).alias("levels")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = cells.select("file", F.col("sheet").alias("on"), F.col("col").alias("c"), "row", F.pmod("row", F.lit(SALTS)).alias("salt"), "number", "text", "open")
    own = named.join(levels, [*column, "salt"]).select(*column, F.explode(around(F.col("row"), F.col("levels"))).alias("piece"), "number", "text", "open")
    held = own.groupBy(*column, "piece").agg(
        F.count("number").alias("n"), F.sum("number").alias("total"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.count("text").alias("filled"), F.max(F.when(F.col("number").isNull(), F.col("text"))).alias("text"), F.count_if("open").alias("open"),
    )
    met = wide.join(held, [*column, "piece"], "left").repartition("id").groupBy("id", "k").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("filled"), F.max("text").alias("text"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"),
    )
    by_formula = met.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[x.split()[0] for x in READ.split(", ")]))).alias("read"), F.sum("open").alias("waits"))
    return asked.join(by_formula, "id", "left").withColumn("waits", F.coalesce("waits", F.lit(0)))


def evaluated(rows: DataFrame) -> DataFrame:
    """``rows`` of ``with_inputs`` with the value of each formula: a number, or a text (truths are 1 and 0, errors as they are written)."""

    def run(texts: pa.Array, reads: pa.Array) -> pa.Array:
        out = [(None, None) if f is None else result(*read_once(f), read or []) for f, read in zip(texts.to_pylist(), reads.to_pylist())]
        return pa.array([dict(zip(("number", "text"), x)) for x in out], VALUE)

    ready = F.col("problem").isNull() & (F.col("waits") == 0)
    value = F.arrow_udf(run, from_arrow_type(VALUE))(F.when(ready, F.col("formula")), F.when(ready, F.col("read")))
    kept = [n for n in rows.columns if n not in ("refs", "read")]
    return rows.withColumn("value", value).select(*kept, F.col("value.number").alias("expected"), F.col("value.text").alias("expected_text"))


def joined(parts: list[tuple]) -> tuple:
    """Summaries (numbers, their sum, least and greatest, greatest text) of some cells as one; what isn't a number is above all that are."""
    known, texts = [p for p in parts if p[0]], [p[4] for p in parts if p[4] is not None]
    if len(known) < 2:
        return (*(known[0][:4] if known else (0, None, None, None)), max(texts, default=None))
    least, most = [p[2] for p in known if p[2] == p[2]], [p[3] for p in known]
    return sum(p[0] for p in known), sum(p[1] for p in known), min(least, default=math.nan), max(most) if all(x == x for x in most) else math.nan, max(texts, default=None)


class Column:
    """A column of one file: its cells in order of their rows, and where the next is that has no value yet."""

    def __init__(self, cells: list[tuple[int, int]]):
        cells.sort()
        self.rows, self.cells = [r for r, _ in cells], [k for _, k in cells]
        self.number, self.text = [None] * len(cells), [None] * len(cells)
        self.after, self.sums = list(range(len(cells) + 1)), {}

    def put(self, at: int, number: float | None, text: str | None) -> None:
        self.number[at], self.text[at], self.after[at] = number, text if number is None else None, at + 1

    def open_in(self, first: int, last: int) -> int | None:
        """The first cell of these places that has no value yet."""
        at = first
        while self.after[at] != at:
            self.after[at] = self.after[self.after[at]]
            at = self.after[at]
        return self.cells[at] if at < last else None

    def few(self, first: int, last: int) -> tuple:
        numbers = [x for x in self.number[first:last] if x is not None]
        text = None if len(numbers) == last - first else max((x for x in self.text[first:last] if x is not None), default=None)
        if not numbers:
            return 0, None, None, None, text
        if (total := sum(numbers)) == total:
            return len(numbers), total, min(numbers), max(numbers), text
        return joined([(1, x, x, x, None) for x in numbers] + [(0, None, None, None, text)])

    def whole(self, first: int, size: int) -> tuple:
        """``SPAN`` cells, doubled any number of times, that all have a value: summed up once."""
        if (first, size) not in self.sums:
            half = size // 2
            self.sums[first, size] = self.few(first, first + size) if size == SPAN else joined([self.whole(first, half), self.whole(first + half, half)])
        return self.sums[first, size]

    def summed(self, first: int, last: int) -> list[tuple]:
        """Cells that all have a value, as few summaries."""
        if last - first <= SPAN:
            return [self.few(first, last)]
        parts = []
        while first < last:
            size = -first % SPAN or min(SPAN, last - first)
            if size < SPAN:
                parts.append(self.few(first, first + size))
            else:
                while first % (2 * size) == 0 and first + 2 * size <= last:
                    size *= 2
                parts.append(self.whole(first, size))
            first += size
        return parts


def of_file(cells: list[tuple]) -> list[tuple]:
    """For each formula among a file's cells (sheet, row, col, text, number, formula): its place in the list, what it gives, if it waits, and its problem.

    Formulas without a stored value are worked out when one that reads them is; a formula whose cells come back to itself waits.
    """
    places: dict[tuple, list] = {}
    for k, (sheet, row, col, *_) in enumerate(cells):
        if sheet is not None and row is not None and col is not None:
            places.setdefault((sheet, col), []).append((row, k))
    columns = {where: Column(held) for where, held in places.items()}
    in_sheet: dict[str, list[int]] = {}
    for sheet, col in sorted(columns):
        in_sheet.setdefault(sheet, []).append(col)
    home, parsed_as, problems = {}, {}, {}
    for column in columns.values():
        for at, k in enumerate(column.cells):
            home[k] = (column, at)
            _, _, _, text, number, formula = cells[k]
            if formula is None or text is not None:
                column.put(at, number, text)
    for k, (*_, formula) in enumerate(cells):
        if formula is not None:
            try:
                parsed_as[k] = read_once(formula)
            except (Unreadable, RecursionError) as e:
                problems[k] = f"unreadable: {e}"

    def spans(k: int) -> list[list[tuple[Column, int, int]]]:
        """For each place that a formula reads, its cells: columns with their first cell and the one after the last."""
        out = []
        for on, c1, r1, c2, r2 in parsed_as[k][1]:
            on = cells[k][0] if on is None else on
            held = in_sheet.get(on, ())
            cols = [c1] if c1 == c2 else held[bisect_left(held, c1) : bisect_right(held, c2)]
            out.append([(x, bisect_left(x.rows, r1), bisect_right(x.rows, r2)) for c in cols if (x := columns.get((on, c)))])
        return out

    def read(place: list[tuple[Column, int, int]]) -> dict:
        parts = [part for x, a, b in place for part in x.summed(a, b)]
        return dict(zip(("n", "total", "least", "most", "text"), parts[0] if len(parts) == 1 else joined(parts)))

    values: dict[int, tuple | None] = {}
    for start in parsed_as:
        stack = [] if start in values else [(start, spans(start))]
        under_way = {start}
        while stack:
            k, parts = stack[-1]
            before = next((c for place in parts for x, a, b in place if (c := x.open_in(a, b)) is not None), None)
            if before is not None and before in parsed_as and before not in values and before not in under_way:
                under_way.add(before)
                stack.append((before, spans(before)))
                continue
            stack.pop()
            under_way.discard(k)
            values[k] = None if before is not None else result(*parsed_as[k], [read(place) for place in parts])
            if values[k] and cells[k][3] is None and k in home:
                home[k][0].put(home[k][1], *values[k])
    return [(k, *(values.get(k) or (None, None)), int(k in parsed_as and values[k] is None), problems.get(k)) for k in sorted([*parsed_as, *problems])]


FOUND = "file string, sheet string, row int, col int, formula string, text string, number double, problem string, waits long, expected double, expected_text string"
KINDS_OUT = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]] for x in FOUND.split(", ")]


def by_file(sheets: DataFrame, cells: int) -> DataFrame:
    """The formulas of files that a task can hold, each file's worked out where all of its cells meet.

    So a file's cells are dealt out once and nothing that its formulas read is shuffled. ``cells`` is their number; tasks
    hold one file at a time.
    """
    names = [x.split()[0] for x in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            found = of_file([cell[1:] for cell in held])
            out.extend((*(held[k][n] for n in (0, 1, 2, 3, 6, 4, 5)), problem, waits, *value) for k, *value, waits, problem in found)
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, KINDS_OUT)], names=names)

        for rows in batches:
            for cell in zip(*[rows.column(n).to_pylist() for n in range(7)]):
                if held and held[0][0] != cell[0]:
                    close()
                    if len(out) >= OUT_ROWS:
                        yield batch()
                held.append(cell)
        if held:
            close()
        if out:
            yield batch()

    session = sheets.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")), cells // TASK_CELLS)
    read = F.when(F.col("formula").isNotNull() | F.col("number").isNull(), F.col("text"))  # beside a number nothing asks for a cell's text
    kept = sheets.select("file", "sheet", F.col("row").cast("int"), F.col("col").cast("int"), read.alias("text"), F.col("number").cast("double"), "formula")
    return kept.repartition(tasks, "file").sortWithinPartitions("file").mapInArrow(run, FOUND)


def by_rounds(sheets: DataFrame) -> DataFrame:
    """The formulas of files of any size: places meet cells by pieces, whatever task holds them.

    Each formula is worked out once, in the first round in which all that it reads has a value: a round for each step of
    the longest chain of formulas without a stored value.
    """
    formulas = sheets.where("formula is not null").select(*AT, "formula", "text", "number")
    session = sheets.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    asked = checkpointed(read_by(formulas.repartition(tasks, *AT, "formula")).withColumn("id", F.monotonically_increasing_id()))
    stored = sheets.where("formula is null or text is not null").select(*AT, "number", "text", F.lit(False).alias("open"))
    none = lambda rows: rows.select(*AT, F.lit(None).cast("double").alias("number"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("open"))
    bare = lambda rows, waits: rows.drop("refs").withColumns({"waits": F.lit(waits).cast("long"), "expected": F.lit(None).cast("double"), "expected_text": F.lit(None).cast("string")})
    settled = none(asked.where("text is null and problem is not null"))
    waiting, out = asked.where("problem is null"), bare(asked.where("problem is not null"), 0)
    rounds, more = 0, not waiting.where("text is null").isEmpty()
    if more:
        stored = checkpointed(stored)
    while more:
        cells = stored.unionByName(settled).unionByName(none(waiting.where("text is null")))
        tried = checkpointed(evaluated(with_inputs(waiting, cells)))
        found, left = tried.where("waits = 0"), tried.where("waits > 0").select("id")
        own = found.where("text is null")
        values = own.select(*AT, F.col("expected").alias("number"), F.coalesce(F.col("expected").cast("string"), "expected_text").alias("text"), F.lit(False).alias("open"))
        rounds += 1
        settled, out = settled.unionByName(values), out.unionByName(found)
        if not rounds % COLLAPSE:
            settled, out = checkpointed(settled), checkpointed(out)
        waiting = checkpointed(waiting.join(left, "id", "left_semi"))
        more = not (own.isEmpty() or waiting.isEmpty())
    if rounds:
        out = out.unionByName(bare(waiting, 1))  # nothing more can be worked out
    else:
        out = out.unionByName(evaluated(with_inputs(waiting, stored.unionByName(settled))))
    return out.drop("id")


def gate(sheets: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Each formula of ``sheets`` (rows as ``workbook.cells`` gives them) with what it should be and its status.

    A stored value is checked against the stored values of what it reads, so order doesn't matter: where all agree, the
    sheet does. Formulas without a stored value are worked out in order of dependency and take part as what they give.
    A file of up to ``FILE_CELLS`` cells is worked out in the task that holds it (``by_file``), the cells of a larger one are
    spread over tasks (``by_rounds``). Status: ``ok``, ``wrong`` (by more than ``tolerance``, relative or
    absolute), ``computed`` (no stored value), ``error`` (gives an error that isn't stored), ``unsettled`` (reads a cell
    that has no value as it is unreadable, or in a circle), ``unreadable`` (``problem`` says why; also empty formulas).
    Blank cells count as zero, texts in arithmetic are ``#VALUE!``. A cell given twice is summed twice, a formula given
    twice is checked twice; cells whose file, sheet, row or column is null can't be read. An empty table gives no rows.
    """
    sizes = sheets.groupBy("file").agg(F.count("*").alias("cells"), F.count("formula").alias("asked"))
    held = F.col("file").isNotNull() & (F.col("cells") <= FILE_CELLS)  # what has no file reads nothing and can be any number
    total, others = sizes.agg(F.coalesce(F.sum(F.when(held, F.col("cells"))), F.lit(0)), F.count_if(~held)).first()
    if others:
        large = small(sizes.where(~held).select(F.col("file").alias("_file"), "asked"))
        same = F.col("file").eqNullSafe(F.col("_file"))
        spread = by_rounds(sheets.join(large.where("asked > 0"), same, "left_semi"))
        out = by_file(sheets.join(large, same, "left_anti"), total).unionByName(spread)
    else:
        out = by_file(sheets, total)
    near = F.abs(F.col("number") - F.col("expected")) <= tolerance * F.greatest(F.lit(1.0), F.abs("number"), F.abs("expected"))
    same = F.coalesce(near, F.col("number").isNull() & F.col("expected").isNull() & (F.col("text") == F.col("expected_text")), F.lit(False))
    failed = F.coalesce(F.startswith("expected_text", F.lit("#")), F.lit(False))
    status = F.when(F.col("problem").isNotNull(), "unreadable").when(F.col("waits") > 0, "unsettled").when(failed & ~same, "error").when(F.col("text").isNull(), "computed").when(same, "ok").otherwise("wrong")
    return out.select(*AT, "formula", F.col("number").alias("stored"), F.col("text").alias("stored_text"), "expected", "expected_text", status.alias("status"), "problem")


def gate_totals(checked: DataFrame) -> DataFrame:
    """How many formulas a gate checked and how many failed, by file and sheet."""
    return checked.groupBy("file", "sheet").agg(F.count("*").alias("formulas_checked"), F.count_if(~F.col("status").isin("ok", "computed")).alias("failures"))
