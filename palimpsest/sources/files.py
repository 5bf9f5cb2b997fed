"""Small files of a store, on whatever file system its folder names."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``. Only on one machine
    (tests) a local one is made and set where the session has none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared one, kept until ``release``."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._palimpsest_folders = [*getattr(context, "_palimpsest_folders", ()), path]
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables of this session; to be called once results
    that read them are written. Returns their number."""
    folders = getattr(spark.sparkContext, "_palimpsest_folders", [])
    spark.sparkContext._palimpsest_folders = []
    for path in folders:
        Files(spark, path).delete("")
    return len(folders)


class Files:
    """Paths under one folder, through the file systems that Spark itself uses."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def local_path(self, name: str = "") -> str:
        return os.path.join(self.root.toUri().getPath(), name)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def modified(self, name: str) -> float:
        """Seconds since the epoch at which a file or folder was last changed."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a file that nobody has written yet; False if somebody has. The
        file appears whole: it is written under another name and then linked (local)
        or renamed (file systems whose rename does not replace)."""
        temporary = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self.path(temporary), True)
        try:
            stream.write(bytearray(data))
            if not self.local:
                stream.hsync()
        finally:
            stream.close()
        try:
            if not self.local:
                return not self.exists(name) and self.fs.rename(self.path(temporary), self.path(name))
            try:
                os.link(self.local_path(temporary), self.local_path(name))
            except FileExistsError:
                return False
            return True
        finally:
            if self.exists(temporary):
                self.delete(temporary)
