"""Pieces that the corpus operators share: words, ASCII lower case, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_dirs: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(c: Column | str) -> Column:
    """The text as a string, with an empty one for null."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else. All-ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words(c: Column) -> Column:
    """The array of words; empty for a text without any. Bind it to a column before using it in a lambda."""
    t = F.btrim(c, F.lit(SPACE))
    return F.when(t == "", F.expr("array()").cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def count_words(texts: pd.Series) -> pd.Series:
    # bytes.split() splits at just the white space that separates words here.
    return texts.map(lambda t: len(t.encode("utf-8", "surrogatepass").split())).astype("int64")


def n_words(c: Column) -> Column:
    """The number of words of a text that isn't null; in Python, where it takes a fifth of the CPU time that split() does."""
    return F.pandas_udf(count_words, "long")(c)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, and where it isn't set the warehouse, or in
    local mode, where driver and executors are one, a temporary folder."""
    if configured := spark.conf.get("spark.checkpoint.dir", None):
        return configured
    if spark.sparkContext.master.startswith("local"):
        return "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return spark.conf.get("spark.sql.warehouse.dir")


def tables_dir(spark: SparkSession) -> str:
    """Where this application writes its tables; removed when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _dirs:
        _dirs[app] = f"{shared_dir(spark)}/tidemill/{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_dirs[app])
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _dirs[app]


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs a read and no more."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hashed_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """About `rows` rows of a written table, all if it has fewer, chosen by a hash of the id: the same on each run, and
    without sending more than them to the driver."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < F.lit(int((1 << 30) * rows / n)))


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of `most` bytes at most, or of one row."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
        yield at, max(stop, at + 1)
        at = max(stop, at + 1)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs that begin at starts, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
