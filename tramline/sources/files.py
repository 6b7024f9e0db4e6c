"""Small files of the driver beside tables: made once, listed, read and deleted on any file system that Spark knows."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        sc = spark.sparkContext
        self._jvm, self.root = sc._jvm, root.rstrip("/")
        self._fs = self._at("").getFileSystem(sc._jsc.hadoopConfiguration())
        self.local = self._fs.getScheme() == "file"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _local(self, name: str) -> str:
        return self._at(name).toUri().getPath()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, sorted; none if there is no such folder. Hidden and unfinished files are left out."""
        try:
            found = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        except Exception as error:  # a py4j error of the JVM's FileNotFoundException
            if "FileNotFoundException" in str(error):
                return []
            raise
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create_once(self, name: str, text: str) -> bool:
        """Write a file that wasn't there; False if it was. Of several writers one wins, and readers see the whole file or none."""
        if self.local:
            path = self._local(name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            new = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
            with open(new, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(new, path)  # fails if there is one, in one step
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(new)
        if self.exists(name):
            return False
        try:
            stream = self._fs.create(self._at(name), False)
            stream.write(bytearray(text.encode()))
            stream.close()
            return True
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise

    def rename(self, old: str, new: str) -> bool:
        """Move a folder to a name that isn't taken; False if it is."""
        self._fs.mkdirs(self._at(new).getParent())
        return not self.exists(new) and self._fs.rename(self._at(old), self._at(new))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
