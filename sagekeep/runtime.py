"""Session helpers shared by all operators."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that Unicode counts as white space (the set that Python's str.strip removes).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


#: Folders made for applications whose session names none.
_OWN_ROOTS: dict[str, str] = {}

#: Applications whose workers have this package already.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark, 'package')}/sagekeep.zip")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(data.getvalue())
    stream.close()
    context.addPyFile(path.toString())
    _SHIPPED.add(context.applicationId)


def build_session(app: str = "sagekeep", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session is given."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names that folder in ``spark.checkpoint.dir``. Only where the
    setting is absent and all runs on one machine (local tests) one is made under
    the temporary folder; on a cluster its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = spark.sparkContext.applicationId
        if own not in _OWN_ROOTS:
            _OWN_ROOTS[own] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _OWN_ROOTS[own]
    return f"{root.rstrip('/')}/sagekeep-{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def strip(column: Column | str) -> Column:
    """Remove outer white space, all kinds that Unicode knows."""
    column = F.col(column) if isinstance(column, str) else column
    return F.btrim(column, F.lit(WHITESPACE))


def hot_values(df: DataFrame, column: str, support: float = 0.005) -> list:
    """Values that may fill at least ``support`` of the rows.

    One pass with bounded counters; the answer has at most ``1 / support``
    values whatever the size of the data, so it may be used as a literal list.
    It can hold values that are less frequent, never lacks a frequent one.
    """
    found = df.select(F.col(column)).freqItems([column], support).collect()[0][0]
    return [v for v in (found or []) if v is not None]
