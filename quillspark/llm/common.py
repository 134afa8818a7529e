"""Helpers shared by the training-data operators.

Intermediate results that are read more than once are written as Parquet below the folder named by
``spark.checkpoint.dir``; they survive lost executors and cut the lineage.  The folder is read from the session, and a
temporary one is set only where the setting is missing and the master is local; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_schema as arrow_schema

_TABLES: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a DataFrame; the path is only ever read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from the session if it names one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = getattr(checkpoint_root, "own", None)
        if root is None:
            root = checkpoint_root.own = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
            spark.sparkContext.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of what was written.  The path is in ``.table_path``."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/quillspark/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written; the tables that it has made on its way are deleted."""
    before = {path for _, path in _TABLES}
    out = materialize(make(), tag)
    for spark, path in [x for x in _TABLES if x[1] not in before and x[1] != out.table_path]:
        _delete(spark, path)
        _TABLES.remove((spark, path))
    return out


def numbered(df: DataFrame, tag: str, number: str = "rid") -> DataFrame:
    """``df`` as a table of its own with the stored column ``number``, different in every row.

    Numbers of a scan hold within one job only: where files are split depends on the cores that are there.
    """
    return materialize(df.select(F.monotonically_increasing_id().alias(number), *df.columns), tag)


def free_name(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{base}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later step reads."""
    for df in tables:
        path = getattr(df, "table_path", None)
        if path:
            _delete(df.sparkSession, path)
            _TABLES[:] = [x for x in _TABLES if x[1] != path]


@atexit.register
def _release_all() -> None:
    for spark, path in _TABLES:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before Python, the session may be another
            continue


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``QUILLSPARK_TOKENIZERS`` overrides the installed package."""
    root = os.environ.get("QUILLSPARK_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """``mapInArrow`` with plain column lists: ``fn`` turns the columns of one batch into the output columns."""
    from pyspark.sql.types import StructType, _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def fold_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal id, modulo ``n``; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")
