"""Writers of tab-separated output."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(df: DataFrame, header: bool = True) -> Iterable[str]:
    """Tab-separated lines of a rendered result, streamed partition by partition."""
    if header:
        yield "\t".join(df.columns)
    for row in df.toLocalIterator():
        yield "\t".join("" if v is None else str(v) for v in row)


def write(df: DataFrame, path: str | None = None, header: bool = True) -> None:
    """To a file, whose lines all tasks write, or to standard output."""
    if path is None:
        for line in lines(df, header):
            sys.stdout.write(line + "\n")
    else:
        write_ordered(df, path, header)


def write_ordered(df: DataFrame, path: str, header: bool = True) -> None:
    """The rows of a sorted result as tab-separated lines of one file, in their order.

    Tasks write the ranges that the sort deals out to numbered files beside the target; when all are there, these are put
    together, byte by byte, and the file appears under its name at once. A failed write leaves nothing under that name.
    path is one of the file system that driver and executors share.
    """
    spark = df.sparkSession
    beside = f"{path}.parts-{uuid.uuid4().hex}"
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws("\t", *cells).alias("value")).write.text(beside)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    folder, target, whole = (hadoop.fs.Path(x) for x in (beside, path, f"{beside}/whole"))
    fs = folder.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-"))
    out = fs.create(whole, True)
    try:
        if header:
            out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
        for name in names:
            part = fs.open(hadoop.fs.Path(folder, name))
            hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            part.close()
    finally:
        out.close()
    fs.delete(target, False)
    if not fs.rename(whole, target):
        raise OSError(f"cannot write {path}")
    fs.delete(folder, True)


def write_tsv(df: DataFrame, path: str, header: bool = True, files: int | None = None) -> None:
    """To a folder of part files, by all tasks; files: how many (1 keeps the order in one file)."""
    (df.coalesce(files) if files else df).write.csv(path, sep="\t", header=header)
