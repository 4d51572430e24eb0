"""Helpers of the corpus operators: column picking, checkpoints, partition counts, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fundaflow.session import cut_lineage

# Python's bytes.split() and this class agree: the white space of every contract that speaks of words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def pick(df: DataFrame, *names: str, **renamed: str) -> DataFrame:
    """The columns `names`, and `renamed` (new=old), found by exact name and position.

    Other columns may clash in any way (same name in another case, dots in the name, the same name
    twice: the first one counts); they are left out.
    """
    columns = df.columns
    wanted = [(n, n) for n in names] + [(new, old) for new, old in renamed.items()]
    missing = [old for _, old in wanted if old not in columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {columns}")
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    return flat.select(*[F.col(f"c{columns.index(old)}").alias(new) for new, old in wanted])


def with_flag(df: DataFrame, key: str, flags: DataFrame) -> DataFrame:
    """Rows of df whose key is in `flags` (one column, any name), with all their columns untouched."""
    columns = df.columns
    at = columns.index(key)
    flat = df.toDF(*[f"c{i}" for i in range(len(columns))])
    ids = flags.toDF("flag_key")
    return flat.join(ids, flat[f"c{at}"].eqNullSafe(ids["flag_key"]), "left_semi").toDF(*columns)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster names; survives lost executors."""
    return cut_lineage(df)


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers where neither their path nor their working folder has it."""
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if str(root) in known or getattr(spark.sparkContext, "_corpus_shipped", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="fundaflow-")) / "fundaflow_package.zip"  # on the driver; Spark sends it
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "fundaflow").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._corpus_shipped = True


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with slices of at most `rows` rows, so that a task holds a bounded number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
