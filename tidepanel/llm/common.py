"""What the operators of this subpackage share: tables, written intermediate results, stable row ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.sources.storage import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written to a new folder of the shared scratch space and read again: its lineage ends there."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def quoted(name: str):
    """A column by its plain name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_scan(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of its own of some file: a scan with projections and filters only."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().apply(0)
    if plan.nodeName() != "LogicalRelation" or not hasattr(plan.relation(), "location"):
        return False
    roots = plan.relation().location().rootPaths()
    names = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    # A folder that is read twice, or within another one, gives its rows twice.
    return not any(b.startswith(a) for a, b in zip(names, names[1:]))


def with_row_id(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a struct column that identifies each row, its file and its number in that file; its name.

    A frame that is not a plain scan (joined, exploded, sampled, united) may hold a row of a file more than once, and
    is written to the scratch space first. The id does not depend on how Spark splits the scan, so a second scan, a
    retried task or a lost executor sees the same ids.
    """
    name = free_name(df, "_rid")
    source = df if is_scan(df) else saved(df, "rows")
    meta = source.metadataColumn("_metadata")
    return source.select("*", F.struct(
        meta["file_path"].alias("file"), meta["row_index"].alias("row")).alias(name)), name


# ---- hashing of byte ranges, for whole batches at once ---------------------------------------------------------

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Powers:
    """Powers of the hash multiplier and of its inverse, as far as they have been needed."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", MULTIPLIER), ("down", INVERSE)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


POWERS = Powers()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums modulo 2**64 of bytes; see ``range_hashes``."""
    POWERS.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``[start, end)``: equal bytes give equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * POWERS.down[starts])
