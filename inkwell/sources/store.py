"""Files of any store that Spark reads, from the driver: whole folders move at once, and a file is created only if it is absent."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Store:
    """A folder, by the file system that Spark opens it with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.folder = folder.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def local(self, name: str) -> str | None:
        """The plain path if the store is this machine's file system."""
        found = self.path(name)
        return found.toUri().getPath() if self.fs.getScheme() == "file" else None

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.fs.exists(self.path(name)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether this call has created the file: whole, and only if there was none.

        A hard link on a local file system, elsewhere a rename that never overwrites: both fail where the name is taken.
        """
        folder, _, own = name.rpartition("/")
        staged = f"{folder}/.{own}.{uuid.uuid4().hex}"
        self.write(staged, text)
        try:
            if (there := self.local(name)) is not None:
                os.link(self.local(staged), there)
            else:
                context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
                context.rename(self.path(staged), self.path(name), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.delete(staged)
            if self.local(staged) is not None:  # the checksum Spark's local file system writes beside it
                self.delete(f"{folder}/..{own}.{staged.rpartition('.')[2]}.crc")

    def move(self, name: str, to: str) -> None:
        if self.fs.exists(self.path(to)) or not self.fs.rename(self.path(name), self.path(to)):
            raise OSError(f"{self.path(name)} can't be moved to {to}")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
