"""Files of a store through Hadoop's file systems, and its commit log.

A commit is a numbered file that holds the whole state after a change. It is put in place whole, and
only where no file has its number: of writers that chose the same number one succeeds, and the others
see that they must look again. Readers need the file of the greatest number alone.
"""

from __future__ import annotations

import json
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """What lies below ``root``, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def at(self, *parts: str):
        """The Hadoop path and its file system."""
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(context._jsc.hadoopConfiguration())

    def name(self, *parts: str) -> str:
        return self.at(*parts)[0].toString()

    def exists(self, *parts: str) -> bool:
        path, fs = self.at(*parts)
        return fs.exists(path)

    def remove(self, *parts: str) -> None:
        path, fs = self.at(*parts)
        fs.delete(path, True)

    def below(self, *parts: str) -> dict[str, int]:
        """Names in a folder, with their times of change in milliseconds."""
        path, fs = self.at(*parts)
        return {f.getPath().getName(): f.getModificationTime() for f in fs.listStatus(path)} if fs.exists(path) else {}

    def sizes(self, *parts: str) -> dict[str, int]:
        """Bytes of data files by the first folder below ``parts`` that they lie in; "" for those right in it."""
        path, fs = self.at(*parts)
        out: dict[str, int] = {}
        if fs.exists(path):
            start, each = len(fs.makeQualified(path).toString()) + 1, fs.listFiles(path, True)
            while each.hasNext():
                f = each.next()
                *folders, name = fs.makeQualified(f.getPath()).toString()[start:].split("/")
                if not name.startswith(("_", ".")):
                    key = folders[0] if folders else ""
                    out[key] = out.get(key, 0) + f.getLen()
        return out

    def read(self, *parts: str) -> str:
        path, fs = self.at(*parts)
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """A new file with this text; False, with nothing changed, where there is one of that name."""
        path, fs = self.at(*parts)
        made, _ = self.at(*parts[:-1], f".{uuid.uuid4().hex}")
        fs.mkdirs(path.getParent())
        stream = fs.create(made, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getScheme() != "file":
                return not fs.exists(path) and fs.rename(made, path)  # a rename doesn't replace a file
            java = self.spark.sparkContext._jvm.java  # here it would; a link doesn't
            java.nio.file.Files.createLink(*(java.io.File(fs.makeQualified(p).toUri().getPath()).toPath() for p in (path, made)))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(made, False)


class CommitLog:
    """Commits 1, 2, ... in a folder. ``kept`` of them stay, so that a writer can see what happened since its base."""

    def __init__(self, files: Files, folder: str = "commits", kept: int = 256):
        self.files, self.folder, self.kept = files, folder, kept

    def numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in self.files.below(self.folder) if (m := re.fullmatch(r"(\d+)\.json", n)))

    def get(self, number: int) -> dict:
        return json.loads(self.files.read(self.folder, f"{number:012d}.json"))

    def latest(self) -> dict | None:
        numbers = self.numbers()
        return self.get(numbers[-1]) if numbers else None

    def put(self, state: dict) -> bool:
        """Commits ``state`` as number ``state["seq"]``; False if that is taken."""
        if not self.files.create(json.dumps(state), self.folder, f"{state['seq']:012d}.json"):
            return False
        if state["seq"] % 32 == 0:
            for number in self.numbers():
                if number <= state["seq"] - self.kept:
                    self.files.remove(self.folder, f"{number:012d}.json")
        return True
