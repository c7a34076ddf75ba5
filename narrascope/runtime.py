"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """``ship``, and batches of 1,500 rows for Python workers of this session where it has the default of 10,000: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1500")
    ship(spark)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="narrascope-"), "narrascope_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("narrascope", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests, a laptop) a local folder is made and used; on a
    cluster without the setting executors would write to their own disks, so that is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        held = getattr(spark.sparkContext, "_narrascope_dir", None)
        if held is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            held = "file://" + tempfile.mkdtemp(prefix="narrascope-shared-")
            spark.sparkContext._narrascope_dir = held
        where = held
    if getattr(spark.sparkContext, "_narrascope_ckpt", None) != where:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(where)
        spark.sparkContext._narrascope_ckpt = where
    return where.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends in files that outlive executors.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._narrascope_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a staged table."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._narrascope_path)
    return path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` staged with each row's place (from 0) in a total order: ranges are sorted apart, and counts of ranges are added up."""
    spark = df.sparkSession
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part, local = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()  # a row for each partition
    before, total = [0] * (max((r["_part"] for r in sizes), default=0) + 1), 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]], total = total, total + r["_n"]
    offset = F.get(F.lit(before).cast("array<bigint>"), part.cast("int"))
    return rows.withColumn(name, offset + local).drop("_id")


def planned_bytes(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``: those of the files behind a plain scan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def settle(spark: SparkSession) -> None:
    """Executors collect garbage once, and so give heap back to the system, before a stage whose Python workers need it.

    One short task a core; a full collection an executor. A heap that has grown in one stage otherwise keeps its size
    beside the workers of the next, in a container that both share.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()
