"""What several of the operators use."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of what isn't a space, tab, line feed, vertical tab, form feed or carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binary(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def missing(columns: Iterable[str], df: DataFrame) -> None:
    if lost := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; in local runs without it, as in tests, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/tidemark-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """The same rows, written as a table in the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A hash's range, for draws at any rate.
RANGE = 1 << 62


def sample(rows: DataFrame, stratum: str, most: int, key: str = "doc_id") -> tuple[DataFrame, dict]:
    """About ``most`` rows of each stratum at most, chosen by a hash of the key, for fitting a model; and each stratum's share that is taken.

    A stratum with fewer rows is taken whole. Strata must be few: their counts come to the driver. Who fits
    frequencies to the sample weighs a stratum's rows by the inverse of its share.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(RANGE))
    keep, share = F.lit(False), {}
    for value, n in counts.items():
        share[value] = min(1.0, most / n)
        limit = RANGE if most >= n else RANGE * most // n
        keep = keep | (F.col(stratum).eqNullSafe(F.lit(value)) & (draw < F.lit(limit)))
    return rows.where(keep), share


def commonest(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, ``most`` at most; of rows with the same count all or none. ``rows`` is read twice, so a table.

    Only the distinct counts come to the driver; there are about as many as the root of all counts together.
    """
    left = most
    least = None
    for r in sorted(rows.groupBy(count).agg(F.count("*").alias("rows")).collect(), reverse=True):
        left -= r["rows"]
        if left < 0:
            break
        least = r[count]
    return rows.where(F.col(count) >= least) if least is not None else rows.limit(0)


#: Rows whose texts a worker turns into strings at once.
SLICE = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def rescale(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through (score, label), by damped Newton steps with a slight ridge.

    Weights, of any scale, tell how many rows each one stands for.
    """
    if len(x) == 0:
        return 0.0, -20.0
    v = np.ones(len(x)) if weight is None else weight * (len(x) / weight.sum())
    middle, spread = float(x.mean()), float(x.std()) or 1.0
    ones = np.stack([(x - middle) / spread, np.ones_like(x)], 1)
    loss = lambda w: (v * np.logaddexp(0, np.where(y > 0, -1, 1) * (ones @ w))).sum() + ridge / 2 * w @ w
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(ones @ w, -30, 30)))
        step = np.linalg.solve(ones.T @ (ones * (v * p * (1 - p))[:, None]) + ridge * np.eye(2), ones.T @ (v * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)
