"""Publication of immutable, content-addressed snapshots of facts as Parquet, and their portable export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG = "snapshot_id string, repository_id string, sequence long, rows long"


class Conflict(Exception):
    """The head isn't the one that the publisher expected."""


def digest(df: DataFrame) -> str:
    """A digest of the rows whatever their order: sums of the quarters of each row's SHA-256, and the number of rows.

    A row's values stand with their lengths in the order of the column names, a null with none, so it differs from any value.
    """
    columns = sorted(df.columns)
    text = lambda c: F.col(f"`{c}`").cast("string")
    row = F.sha2(F.concat(F.lit("row"), *(F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns)), 256)
    quarters = [F.sum(F.conv(F.substring("row", at, 16), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 17, 33, 49)]
    sums = [F.coalesce(q, F.lit("0")) for q in quarters]
    one = df.select(row.alias("row")).agg(F.sha2(F.concat_ws("|", F.lit("facts-2"), F.lit(",".join(columns)), F.count("*").cast("string"), *sums), 256)).first()
    return one[0]


def catalog(spark: SparkSession, base: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/catalog")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CATALOG)
    return spark.read.schema(CATALOG).parquet(f"{base}/catalog")


def head(spark: SparkSession, base: str, repository: str) -> str | None:
    row = catalog(spark, base).where(F.col("repository_id") == repository).agg(F.max(F.struct("sequence", "snapshot_id")).alias("h")).select("h.*").first()
    return row.snapshot_id if row else None


def publish(facts: DataFrame, base: str, repository: str, expected: str | None) -> str:
    """Writes facts under their digest and moves the head; publishing the head's facts again changes nothing.

    Readers see a snapshot only after its catalog row, which is written last. A head other than ``expected`` raises Conflict.
    """
    spark, name = facts.sparkSession, digest(facts)
    now = head(spark, base, repository)
    if now == name:
        return name
    if now != expected:
        raise Conflict(f"head is {now}, not {expected}")
    facts.write.mode("overwrite").parquet(f"{base}/snapshots/{name}")
    written = spark.read.parquet(f"{base}/snapshots/{name}")
    if digest(written) != name:
        raise ValueError("what was written differs from what was published")
    sequence = (catalog(spark, base).where(F.col("repository_id") == repository).agg(F.max("sequence")).first()[0] or 0) + 1
    spark.createDataFrame([(name, repository, sequence, written.count())], CATALOG).write.mode("append").parquet(f"{base}/catalog")
    return name


def load(spark: SparkSession, base: str, snapshot: str) -> DataFrame:
    """A snapshot whose content still has its digest."""
    facts = spark.read.parquet(f"{base}/snapshots/{snapshot}")
    if digest(facts) != snapshot:
        raise ValueError(f"snapshot {snapshot} is damaged")
    return facts


def export(spark: SparkSession, base: str, snapshot: str, to: str) -> None:
    """A portable folder: the facts as JSON lines and a manifest with their digest; an existing folder isn't replaced."""
    facts = load(spark, base, snapshot)
    facts.write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{to}/facts")
    spark.createDataFrame([(snapshot, facts.count(), facts.schema.json())], "snapshot_id string, rows long, schema string").coalesce(1).write.mode("errorifexists").json(f"{to}/manifest")


def import_(spark: SparkSession, folder: str, base: str, repository: str, expected: str | None) -> str:
    """Publishes an exported folder after its digest has been checked."""
    from pyspark.sql.types import StructType
    import json

    manifest = spark.read.schema("snapshot_id string, rows long, schema string").json(f"{folder}/manifest").first()
    facts = spark.read.schema(StructType.fromJson(json.loads(manifest.schema))).option("mode", "FAILFAST").json(f"{folder}/facts")
    if digest(facts) != manifest.snapshot_id or facts.count() != manifest.rows:
        raise ValueError("the folder doesn't hold what its manifest says")
    return publish(facts, base, repository, expected)
