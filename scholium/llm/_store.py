"""Tables written to the folder that all executors share."""

from __future__ import annotations

import os
import pickle
import tempfile
import uuid

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; in local mode, if unset, a temporary one. On a cluster it must be set:
    no other folder is known to be shared."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
        return f"file://{os.path.join(tempfile.gettempdir(), 'scholium-checkpoints')}"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: it is computed
    once, its lineage ends there, and a lost executor costs no recomputation. options: the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes a table that written() made and nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def narrowed(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns own, all others in one struct, so no name can clash with an operator's;
    and what puts docs' columns back."""
    rest = [c for c in docs.columns if c not in own]
    inner = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(rest))) if rest else F.lit(True)

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"rest_of_row.c{rest.index(c)}").alias(c) if c in rest else F.col(c) for c in docs.columns))

    return docs.select(*own, inner.alias("rest_of_row")), restored


class Carried:
    """A value to broadcast: it arrives as itself, its classes with it, so executors need no installed copy."""

    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return pickle.loads, (cloudpickle.dumps(self.value),)
