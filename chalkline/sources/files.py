"""Paths on whatever file system the cluster uses, through the session's own file-system layer, and the folder that all executors share."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none."""
    fs, p = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _at(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def relative(path: str, root: str) -> str:
    """The path below root with forward slashes, as manifests hold it; a path outside of root is an error."""
    plain = lambda x: "/" + "/".join(part for part in x.replace("\\", "/").split("/") if part not in ("", "."))
    base, own = plain(root).rstrip("/"), plain(path)
    if own != base and not own.startswith(base + "/"):
        raise ValueError(f"{path} does not lie below {root}")
    return own[len(base) + 1 :]


def fingerprint(spark: SparkSession, path: str, *more: str) -> str:
    """Of a table's files: their names, sizes and times, and whatever else the result depends on. It changes when the table is written again."""
    fs, p = _at(spark, path)
    files = fs.listFiles(p, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join([*sorted(seen), *more]).encode()).hexdigest()[:32]


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one is set, but only if all tasks run on this machine; on a cluster
    other executors could not read it."""
    sc = spark.sparkContext
    got = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if got is None and known.isDefined():
        got = known.get()
    if got is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        got = tempfile.mkdtemp(prefix="chalkline-")
    if not known.isDefined():
        sc.setCheckpointDir(got)
    return got
