"""Session helpers: table access, shared storage for checkpoints and written tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where the session names none, a temporary one
    serves a master that runs on this machine alone; on a cluster it is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(sc, "_ferrule_shared", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="ferrule-")
            sc._ferrule_shared = folder
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; all that :func:`written` and :func:`stored` leave lies in it."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove this application's folder, once nothing reads its results any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (for results with several readers)."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """:func:`written`, with its place noted, so that :func:`discard` can remove it once nothing reads it any more."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[id(out)] = (out, path)
    return out


def bucketed(df: DataFrame, name: str, n: int, key: str = "paper_id") -> DataFrame:
    """:func:`written` and noted as in :func:`stored`, in ``n`` buckets by ``key``: what groups, ranks or joins by the key needs no
    shuffle. A ``df`` whose partitions are those of the key in ``n`` parts is written as one file a bucket."""
    spark, as_name = df.sparkSession, f"ferrule_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("path", path).bucketBy(n, key).saveAsTable(as_name, format="parquet")
    out = spark.table(as_name)
    spark.sql(f"drop table {as_name}")  # the name only, which the catalog needs for the buckets; the files stay, and the plan has them
    _PLACES[id(out)] = (out, path)
    return out


_PLACES: dict[int, tuple[DataFrame, str]] = {}


def discard(df: DataFrame) -> None:
    """Remove what :func:`stored` wrote for this DataFrame; nothing may read it after."""
    _, path = _PLACES.pop(id(df), (None, None))
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage: only then does Spark drop broadcasts and shuffle files that nothing uses any more."""
    gc.collect()
    spark._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
