"""Small files and folders by the session's file systems, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the context's checkpoint folder, or in local mode a temporary one."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            folder = known.get()
        elif sc.master.startswith("local"):
            folder = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
            sc.setCheckpointDir(folder)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return folder.rstrip("/")


class Folder:
    """What lies below a path, as names relative to it."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.files = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        """The names in a folder, sorted; none where there is no such folder. Hidden ones are left out."""
        if not self.files.exists(self.path(name)):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self.files.listStatus(self.path(name))) if not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        stream = self.files.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file and says whether it did: where there is one of that name, it stays as it is.

        Of two writers one succeeds where the file system creates files exclusively, as HDFS does.
        """
        try:
            stream = self.files.create(self.path(name), False)
        except Exception as e:  # noqa: BLE001  the gateway has no type for it
            if "AlreadyExists" in str(e) or self.files.exists(self.path(name)):
                return False
            raise
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def bytes(self, name: str) -> int:
        """The bytes of all visible files below a name."""
        status = self.files.listStatus(self.path(name))
        return sum(self.bytes(f"{name}/{s.getPath().getName()}") if s.isDirectory() else s.getLen() for s in status if not s.getPath().getName().startswith((".", "_")))

    def age(self, name: str) -> float:
        """Seconds since a file or folder was changed."""
        return time.time() - self.files.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.files.delete(self.path(name), True)
