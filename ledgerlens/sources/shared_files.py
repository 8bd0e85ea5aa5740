"""Small files and folders on any file system that Spark knows, for markers and commit logs."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    modified_ms: int


def _open(spark: SparkSession, address: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(address)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, address: str) -> bool:
    path, system = _open(spark, address)
    return system.exists(path)


def children(spark: SparkSession, address: str) -> list[Entry]:
    """What is directly inside a folder, by name; nothing where there is no folder."""
    path, system = _open(spark, address)
    if not system.exists(path):
        return []
    return sorted(Entry(s.getPath().getName(), s.getModificationTime()) for s in system.listStatus(path))


def delete(spark: SparkSession, address: str) -> None:
    path, system = _open(spark, address)
    system.delete(path, True)


def read_text(spark: SparkSession, address: str) -> str:
    return spark.read.option("wholetext", True).text(address).first().value


def create_new(spark: SparkSession, address: str, text: str) -> bool:
    """Create a file with its whole content, or return False if it is there already.

    The content is written under another name first, so nobody sees half of it.  Of several
    writers exactly one succeeds: by a hard link on local and network disks, elsewhere by a
    rename that does not overwrite.
    """
    path, system = _open(spark, address)
    jvm = spark._jvm
    system.mkdirs(path.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_draft-{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if system.getScheme() == "file":
            place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(place(path), place(draft))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                system.getUri(), spark._jsc.hadoopConfiguration())
            rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            choice = spark.sparkContext._gateway.new_array(rename, 1)
            choice[0] = rename.NONE
            context.rename(draft, path, choice)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    finally:
        system.delete(draft, False)
    return True
