"""Session helpers: a local session for tests and the bench, and the
checkpoint folder that iterative operators use to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "kernelspark") -> SparkSession:
    """A ``local[cores]`` session with AQE on and the web UI off.

    Only tests, the bench and the smoke entry use this; library code takes
    the caller's session.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("KS_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for reliable checkpoints.

    The cluster's ``spark.checkpoint.dir`` (or a folder set with
    ``setCheckpointDir``) wins. Only a local-mode session without one gets a
    fresh scratch folder; on a cluster a missing setting is an error,
    because a machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ks-ckpt-"))
        return sc.getCheckpointDir()
    raise ValueError(
        "spark.checkpoint.dir is not set: iterative operators need a shared "
        "folder (e.g. on HDFS or object storage) to checkpoint their state")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: lineage ends there, and a lost executor costs a read."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_stored_path", None):
            remove_folder(df.sparkSession, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on the shared file system: written beside its place and
    renamed, so that it is there whole or not at all."""
    target, fs = _file(spark, path)
    beside, _ = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"could not rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, None if there is no such file."""
    p, fs = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    p, fs = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``kernelspark`` importable in the Python workers, as
    ``--py-files`` would: the package sources are zipped once per Spark
    context and added with ``addPyFile`` (Spark distributes the file to every
    executor). Needed by the Arrow / pandas UDF paths when the package is not
    installed on the executors."""
    import zipfile
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="ks-pyfiles-"), "kernelspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)
