"""Sources and sinks: parquet lakes, delimited files, JDBC, Kafka, and versioned tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltworks.sources.commits import Conflict, claim, manifest, numbers

CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class LakePaths:
    """Paths of the layers below one base."""

    base: str

    def _at(self, layer: str, name: str) -> str:
        return f"{self.base.rstrip('/')}/{layer}/{name}"

    def raw(self, name: str) -> str:
        return self._at("raw", name)

    def ods(self, name: str) -> str:
        return self._at("ods", name)

    def analytics(self, name: str) -> str:
        return self._at("analytics", name)

    def dds(self, name: str) -> str:
        return self._at("dds", name)

    def mart(self, name: str) -> str:
        return self._at("mart", name)


def read_lake(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A parquet table, partitions discovered; filters on them prune directories."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_dict(spark: SparkSession, path: str, schema: StructType | str, sep: str = ";") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def read_csv_day(spark: SparkSession, glob: str, schema: StructType | str, day_col: str, day: str) -> DataFrame:
    """The rows of one day from all files that match, read by the day's text prefix."""
    return spark.read.csv(glob, schema=schema, header=True).filter(F.col(day_col).cast("string").startswith(day))


def load_with_rejects(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(good, rejected). Empty fields are null; a line that the schema can't hold is rejected whole, as text.

    Each file starts with a line of the schema's names; a record is one line.
    """
    wide = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + f", {CORRUPT} string"
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "nullValue": "", "emptyValue": ""}
    lines = spark.read.text(path).filter(F.col("value") != sep.join(f.name for f in schema.fields))
    read = lines.select("value", F.from_csv("value", wide, options).alias("row"))
    bad = F.col(f"row.{CORRUPT}").isNotNull()
    return read.filter(~bad).select("row.*").drop(CORRUPT), read.filter(bad).select(F.col("value").alias("line"))


def read_jdbc(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None) -> DataFrame:
    """A snapshot. For a large table give partitionColumn, lowerBound, upperBound and numPartitions."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load()


def write_jdbc(df: DataFrame, url: str, table: str, options: dict[str, str] | None = None, mode: str = "append") -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, truncate="true", **(options or {})).mode(mode).save()


def kafka_options(servers: str, user: str | None = None, password: str | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers}
    if user is not None:
        login = f'org.apache.kafka.common.security.scram.ScramLoginModule required username="{user}" password="{password}";'
        out |= {"kafka.security.protocol": "SASL_SSL", "kafka.sasl.mechanism": "SCRAM-SHA-512", "kafka.sasl.jaas.config": login}
    return out


def read_topic(spark: SparkSession, options: dict[str, str], topic: str, max_per_batch: int | None = None) -> DataFrame:
    extra = {"maxOffsetsPerTrigger": str(max_per_batch)} if max_per_batch else {}
    return spark.readStream.format("kafka").options(**(options | {"subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"} | extra)).load()


def read_files(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """A stream of the parquet files below a path, at most ``max_files`` of them a batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def as_messages(df: DataFrame) -> DataFrame:
    """The whole row as one JSON column named value."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_topic(df: DataFrame, options: dict[str, str], topic: str) -> None:
    as_messages(df).write.format("kafka").options(**options, topic=topic).save()


def write_lake(df: DataFrame, path: str, partition_by: list[str] | None = None, files: int | None = None) -> None:
    """Overwrite a parquet table; with ``partition_by`` only the partitions that the rows are in. Rows are dealt by partition first, so that each has few files."""
    if partition_by:
        df = df.repartition(files, *partition_by) if files else df.repartition(*partition_by)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    else:
        (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)


def publish(tables: dict[str, DataFrame], base: str, after: int | None = None) -> int:
    """Write several tables as one new version below ``base``; returns its number.

    Readers take the last version, so they see all tables of a load or none, and a load may read what it replaces. With ``after``, the number of the version
    that the load has read (``version``), this raises ``Conflict`` where another has been published since, so that no load is lost.
    """
    spark = next(iter(tables.values())).sparkSession
    part = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{base}/{part}/{name}")
    number = version(spark, base) if after is None else after
    while True:
        try:
            claim(spark, f"{base}/_versions", number + 1, {"part": part})
            return number + 1
        except Conflict:
            if after is not None:
                raise
            number += 1


def version(spark: SparkSession, base: str) -> int:
    """The number of the last version, 0 before the first."""
    return max(numbers(spark, f"{base}/_versions"), default=0)


def current(spark: SparkSession, base: str, name: str, schema: StructType | str) -> DataFrame:
    """The last published version of a table; an empty one before the first."""
    empty, last = spark.createDataFrame([], schema), version(spark, base)
    return spark.read.schema(empty.schema).parquet(f"{base}/{manifest(spark, f'{base}/_versions', last)['part']}/{name}") if last else empty


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, which all executors share; in a local session without one, below a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as written once to a shared folder, for results that read it several times."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_batch(df: DataFrame, base: str, name: str, batch_id: int, options: dict[str, str] | None = None) -> None:
    """Write a micro-batch under its id. A batch that runs again replaces what it wrote; nothing that earlier batches wrote is read or written. ``options``: of the parquet writer."""
    df.write.mode("overwrite").option("compression", "zstd").options(**(options or {})).parquet(f"{base}/{name}/batch={batch_id}")


def read_batches(spark: SparkSession, base: str, name: str, schema: str) -> DataFrame:
    """The rows of all batches with the number of their batch; none before the first."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{base}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def compact(spark: SparkSession, base: str, name: str, schema: str, into: str) -> None:
    """Merge the batches of a table into one folder of the table ``into``; run it between streams, and delete the batches after."""
    read_batches(spark, base, name, schema).drop("batch").write.mode("overwrite").parquet(f"{base}/{into}/batch=0")
