"""Small control files: exclusive creation, reading, listing and removal, on a local path or any Hadoop file system."""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import SparkSession


#: Stores of objects have no rename that fails where the name is taken, which commits rest on.
NO_EXCLUSIVE_RENAME = {"s3", "s3a", "s3n", "gs", "wasb", "wasbs", "oss", "cos", "cosn", "obs", "swift", "http", "https"}


def qualified(spark: SparkSession, root: str) -> str:
    """``root`` with its file system's scheme, as Spark itself resolves it; a file system without exclusive rename is refused."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if out.partition(":")[0].lower() in NO_EXCLUSIVE_RENAME:
        raise ValueError(f"{out}: commits need a file system that renames a file only if the new name is free")
    return out


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, root = spark, qualified(spark, root)
        self.local = re.sub(r"^file:/*", "/", root) if root.startswith("file:") else root if "://" not in root else None
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.local.rstrip('/') if self.local else self.root}/{name}"

    def _fs(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is already there. This is the compare-and-swap that commits rest on."""
        if self.local:
            path = self.path(name)
            os.makedirs(os.path.dirname(path), exist_ok=True)
            # a file appears under its name whole: it is written aside, then linked, which fails if the name is taken
            aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
            with open(aside, "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(aside, path)
            except FileExistsError:
                return False
            finally:
                os.unlink(aside)
            return True
        fs, path = self._fs(name)
        _, aside = self._fs(f"{name}.{os.urandom(8).hex()}.aside")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        made = not fs.exists(path) and fs.rename(aside, path)
        if not made:
            fs.delete(aside, False)
        return bool(made)

    def read(self, name: str) -> str | None:
        if self.local:
            try:
                with open(self.path(name), encoding="utf-8") as f:
                    return f.read()
            except FileNotFoundError:
                return None
        fs, path = self._fs(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def list(self, name: str) -> list[str]:
        if self.local:
            try:
                return sorted(x for x in os.listdir(self.path(name)) if not x.startswith("."))
            except FileNotFoundError:
                return []
        fs, path = self._fs(name)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def remove(self, name: str) -> None:
        if self.local:
            path = self.path(name)
            shutil.rmtree(path, ignore_errors=True) if os.path.isdir(path) else os.path.exists(path) and os.unlink(path)
            return
        fs, path = self._fs(name)
        fs.delete(path, True)
