"""Document files as rows, and LaTeX rows as files."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename, file_kind, output_name


def read_documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``path``, ``kind``, ``name``, ``out_path``, ``rtf`` (the bytes), ``error``: one row a file.  What is no document stays, with an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    bundle = F.regexp_extract("path", r"^(.*\.rtfd)/TXT\.rtf$", 1)
    place = F.when(bundle != "", bundle).otherwise(F.col("path"))
    kind = file_kind(place)
    magic = F.decode(F.substring("content", 1, 5), "ISO-8859-1") == "{\\rtf"
    wrong = F.when(kind == "unknown", "not a document").when(kind.isin("rtf", "rtfd") & ~magic, "no version word")
    return files.select("path", kind.alias("kind"), basename(place).alias("name"), output_name(place).alias("out_path"), F.col("content").alias("rtf"), wrong.alias("error"))


def candidates(name: str) -> list[str]:
    """Where a bare name may be found, in order."""
    return [name, f"{name}.rtf", f"{name}.rtfd/TXT.rtf", f"{name}.eqn"]


def resolve(name: str) -> str | None:
    """The first of the :func:`candidates` that is a file, on any file system that pyarrow reads; nothing if none is."""
    from pyarrow import fs

    for place in candidates(name):
        system, path = fs.FileSystem.from_uri(place if "://" in place else f"file://{os.path.abspath(place)}")
        if system.get_file_info(path).type == fs.FileType.File:
            return place
    return None


def bundle_images(spark: SparkSession, path: str) -> DataFrame:
    """``bundle``, ``name``, ``content`` of the files beside the text of every bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    bundle = F.regexp_extract("path", r"^(.*\.rtfd)/[^/]+$", 1)
    return files.select(bundle.alias("bundle"), basename(F.col("path")).alias("name"), "content").filter((F.col("bundle") != "") & (F.col("name") != "TXT.rtf"))


def write_files(rows: DataFrame, folder: str, path: str = "out_path", content: str = "latex", root: str = "") -> DataFrame:
    """Write one file a row below ``folder``, under its ``path`` without ``root``, so that equal names in different folders stay apart;
    returns ``written``.  ``folder`` is a URI that all executors share; a bare path or ``file://`` is taken with a local master only.
    A file appears whole: it is written beside its place and moved there, and a task that runs again writes the same."""
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    if uri.startswith("file://") and not rows.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is local to each machine")

    def write(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            done = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                short = name.split("://", 1)[-1].removeprefix("file:").removeprefix(root).lstrip("/")
                parts = [x for x in short.split("/") if x not in ("", ".", "..")]
                target = "/".join([base.rstrip("/"), *parts])
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                beside = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(beside) as f:
                    f.write(data.encode("utf-8") if isinstance(data, str) else data or b"")
                system.move(beside, target)
                done.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(done, type=pa.string())], ["written"])

    return rows.filter(F.col(path).isNotNull() & F.col(content).isNotNull()).select(path, content).mapInArrow(write, "written string")


def write_latex(rows: DataFrame, folder: str, root: str = "") -> DataFrame:
    """:func:`write_files` for ``out_path`` and ``latex``."""
    return write_files(rows, folder, "out_path", "latex", root)


def picture_path(out_path: Column, num: Column, kind: Column) -> Column:
    """Where a picture of a document goes: beside its LaTeX."""
    folder = F.regexp_extract(out_path, r"^(.*/)?[^/]*$", 1)
    return F.concat(folder, F.lit("picture-"), num.cast("string"), F.lit("."), F.coalesce(kind, F.lit("bin")))
