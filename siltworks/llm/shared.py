"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Keys = list[str]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in local tests, a new temporary one.

    Raises where it is unset and the session is not local, since no machine-local folder is seen by all executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


#: Paths that the ``scratch`` blocks open in this thread or context have stored, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the plan above starts from files, which outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/siltworks-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable]:
    """Deletes the tables stored within at its end. Those given to the function that it yields stay, as the result reads them, and pass to the block around it."""
    made: list[str] = []
    kept: set[str] = set()
    around = _OPEN.get()
    _OPEN.set((*around, made))
    try:
        yield lambda *tables: kept.update(t.stored_at for t in tables)
    finally:
        _OPEN.set(around)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif around:
                around[-1].append(path)


#: Bits of the hash prefixes that stand for a set of keys: at most 2**20 of them are broadcast, however large the set.
PREFIX_BITS = 20


def split_by(df: DataFrame, keys: Keys, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows whose ``keys`` may be among those of ``wanted``, rows whose keys are not, the stored table that both read). Neither is shuffled.

    Keys are told apart by a prefix of their hash, so the first part is for an exact join, which then moves little where few keys are wanted.
    """
    prefix = F.shiftrightunsigned(F.xxhash64(F.lit(20), *keys), 64 - PREFIX_BITS).alias("_prefix")
    few = stored(wanted.select(prefix).distinct(), "prefixes")
    dealt = df.select("*", prefix)
    may, not_ = (dealt.join(F.broadcast(few), "_prefix", how).select(df.columns) for how in ("left_semi", "left_anti"))
    return may, not_, few


ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text):
    """A-Z lower-cased, all else as it is; ``lower`` alone is faster and the same where the text is ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def rank_file() -> str:
    return vocabulary_file("byte_bpe_multi_50k.tiktoken")
