"""Writers with their checks. Stores are append-only: new files are added, old ones never rewritten."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.readers import Split, split_on_reason


class Rejected(ValueError):
    """A batch that breaks a rule of its store."""


def validated(rows: DataFrame, rules: dict[str, Column]) -> Split:
    """Rows that break no rule, and the others with all the rules they break; nothing is filled in."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    marked = rows.withColumn("reasons", broken)
    out = split_on_reason(marked.withColumn("reason", F.when(F.size("reasons") > 0, F.array_join("reasons", ";"))).drop("reasons"))
    return out


def clashes(existing: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key is taken, in the store or twice in the batch."""
    twice = batch.groupBy(*key).count().where("count > 1").select(*key)
    return batch.join(existing.select(*key).distinct().union(twice).distinct(), list(key), "left_semi")


def orphans(batch: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return batch.join(parents.select(key).distinct(), key, "left_anti")


def append(spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], parents: DataFrame | None = None, parent_key: str | None = None) -> None:
    """Adds a batch to a Parquet store, or raises if a key is taken or a parent is missing; then nothing of it is written.

    A lock file beside the store keeps a second writer out between check and write (where the store's file system
    creates files atomically); what a writer that died leaves must be removed by hand.
    """
    with locked(spark, path):
        existing = stored(spark, path, batch)
        if clashes(existing, batch, key).limit(1).count():
            raise Rejected(f"key {tuple(key)} is taken")
        if parents is not None and orphans(batch, parents, parent_key).limit(1).count():
            raise Rejected(f"no parent for {parent_key}")
        batch.write.mode("append").parquet(path)


def append_evidence(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Adds a batch to an evidence ledger, or raises with the rules that it breaks together with what is there; all or nothing."""
    from tidemark.operators.review import ledger_violations

    with locked(spark, path):
        both = stored(spark, path, batch).unionByName(batch)
        if broken := ledger_violations(both).join(batch.select("evidence_id").distinct(), "evidence_id", "left_semi").select("violations").distinct().take(5):
            raise Rejected("; ".join(r["violations"] for r in broken))
        batch.write.mode("append").parquet(path)


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Holds a store's lock file."""
    lock = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + ".lock")
    files = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.createNewFile(lock):
        raise Rejected(f"another writer holds {lock}")
    try:
        yield
    finally:
        files.delete(lock, False)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The store's rows, none if it doesn't exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def ledger_digest(rows: DataFrame) -> DataFrame:
    """Row count and an order-free digest of the content, to show that old rows are as they were."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])), F.lit(0)).alias("digest"))


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """Fixed columns in a fixed order, sorted, with a header."""
    rows.select(*columns).orderBy(*order).write.mode("errorifexists").csv(path, header=True)


def manifest_lines(prints: DataFrame) -> DataFrame:
    """deal_id, source, their prints (session_date, price, known_at) in order and the hash of these; grows with the days of a deal."""
    entries = F.array_sort(F.collect_list(F.struct(F.col("session_date").cast("string").alias("session_date"), "price", F.date_format("known_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("known_at"))))
    rows = prints.groupBy("deal_id", "source").agg(entries.alias("prints"))
    return rows.withColumn("sha256", F.sha2(F.to_json("prints"), 256))


def write_price_manifest(prints: DataFrame, path: str) -> None:
    """One JSON line per deal and source."""
    manifest_lines(prints).write.mode("errorifexists").json(path)


def csv_line(columns: Sequence[str]) -> Column:
    """A row as one line of CSV: null is empty, quotes stand where a field has a comma, quote or newline."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    field = lambda x: F.when(F.regexp_like(x, F.lit('[",\n\r]')), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.concat_ws(",", *[field(text(c)) for c in columns])


def replaced_rulesets(old: DataFrame, new: DataFrame) -> DataFrame:
    """A signal store after a run: the rulesets of ``new`` are replaced as a whole, others stay."""
    return old.join(new.select("ruleset").distinct(), "ruleset", "left_anti").unionByName(new)


def calendar_rows(spark: SparkSession, start: str, end: str, closures: dict[str, str]) -> DataFrame:
    """Every day with whether it is a session, and why not: weekend, or the closure's name."""
    shut = spark.createDataFrame([*closures.items()], "day string, name string").select(F.col("day").cast("date").alias("obs_date"), "name")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("obs_date"))
    reason = F.when(F.weekday("obs_date") >= 5, "weekend").otherwise(F.col("name"))
    return days.join(shut, "obs_date", "left").select("obs_date", reason.isNull().alias("is_trading"), reason.alias("reason"))


def upserted_calendar(store: DataFrame, rows: DataFrame) -> DataFrame:
    """A calendar (obs_date, is_trading, reason) after an upsert by day: new rows take the place of stored ones."""
    columns = ["obs_date", "is_trading", "reason"]
    return store.join(rows.select("obs_date"), "obs_date", "left_anti").select(*columns).unionByName(rows.select(*columns))


def migrated(rows: DataFrame, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """``rows`` in a later schema: new columns are null or their default; a column that goes must be empty."""
    target = rows.sparkSession.createDataFrame([], schema).schema
    gone = [c for c in rows.columns if c not in target.names]
    if gone and rows.where(" or ".join(f"`{c}` is not null" for c in gone)).limit(1).count():
        raise Rejected(f"columns {gone} have values and can't be dropped")
    new = {f.name: F.lit((defaults or {}).get(f.name)) for f in target if f.name not in rows.columns}
    return rows.withColumns(new).select(*[F.col(f.name).cast(f.dataType) for f in target])


#: The deals that a ledger starts with. Quotes that are only illustrative aren't among them.
SEED_COLUMNS = "deal_id string, announce_date string, acquirer string, target string, sponsor string, value_usd_mm double, sector string, geography string, deal_type string, resolution_date string, status string, p_break double"
SEED_DEALS = (
    ("EA-PIF-2026", "2026-06-17", "PIF/Silver Lake/Affinity", "Electronic Arts", "PIF/Silver Lake/Affinity", 55000.0, "Gaming/Tech", "US", "take_private", "2026-08-04", "closed", 0.28),
    ("EZJ-CASTLELAKE-2026", "2026-07-05", "Castlelake", "easyJet", "Castlelake", 7300.0, "Airlines", "UK", "take_private", None, "pending", 0.22),
    ("ORGN-SUNP-2026", "2026-04-27", "Sun Pharma", "Organon", None, 11750.0, "Healthcare", "US/IN", "strategic", None, "pending", 0.18),
    ("CALIBER-NEE-2026", "2026-06-19", "NextEra Energy", "Caliber Resource Partners", "Quantum Capital", 1300.0, "Energy", "US", "JV", None, "pending", 0.15),
    ("FORVIA-APO-2026", "2026-04-27", "Apollo Global", "Forvia auto interiors", "Apollo", 2100.0, "Industrials", "EU/US", "LBO", None, "pending", 0.20),
    ("ANTH-TPU-FIN-2026", "2026-05-29", "Apollo/Blackstone", "Anthropic (TPU financing)", "Apollo/Blackstone", 36000.0, "AI", "US", "financing", None, "pending", 0.10),
)


def seeded(existing: DataFrame | None, spark: SparkSession) -> DataFrame:
    """A ledger with the seed deals put over what it had of them; other deals stay."""
    seeds = spark.createDataFrame([*SEED_DEALS], SEED_COLUMNS).withColumns({c: F.col(c).cast("date") for c in ("announce_date", "resolution_date")})
    return seeds if existing is None else existing.join(seeds.select("deal_id"), "deal_id", "left_anti").unionByName(seeds)


def overwrite_ruleset(rows: DataFrame, path: str) -> None:
    """Signals replaced per ruleset, other rulesets untouched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ruleset").parquet(path)
