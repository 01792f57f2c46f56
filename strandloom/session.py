"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select source columns under new names: ``pick(df, key="seqname")``.

    Source names are matched exactly first, then without regard to case, and by position, so that
    further columns of ``df`` may clash with each other or with the new names.
    """
    names = df.columns
    lower = [n.lower() for n in names]
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    chosen = []
    for alias, source in columns.items():
        if source in names:
            at = names.index(source)
        elif source.lower() in lower:
            at = lower.index(source.lower())
        else:
            raise ValueError(f"no column {source!r}; there are {names}")
        chosen.append(F.col(f"_c{at}").alias(alias))
    return flat.select(*chosen)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset, which only local mode may leave it, a
    temporary folder is made, that goes when Python ends.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="strandloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
