"""Small file-system chores through Hadoop's FileSystem, so any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        path = self._path("")
        self._conf = spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway
        self._fs = path.getFileSystem(self._conf)
        # Local files without check sum files, which could not be swapped together with them.
        self._local = self._fs.getUri().getScheme() == "file"
        if self._local:
            self._fs = self._fs.getRawFileSystem()

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        path = self._path(name)
        if not self._fs.exists(path):
            return []
        names = (item.getPath().getName() for item in self._fs.listStatus(path))
        return sorted(name for name in names if not (name.startswith(".") and name.endswith(".crc")))

    def size(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def largest(self, name: str = "") -> int:
        """Length of the largest file directly in a folder, or of the file itself."""
        return max((item.getLen() for item in self._fs.listStatus(self._path(name))), default=0)

    def read(self, name: str) -> str:
        """A small text file, such as a state row."""
        stream = self._fs.open(self._path(name))
        try:
            data = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return data

    def write(self, name: str, text: str) -> None:
        """Write a small text file, visible under its name only when complete.

        An equal file is left alone, so a retried batch never takes its pointer away.
        """
        if self.exists(name) and self.read(name) == text:
            return
        hidden = self._path(f".{name.rsplit('/', 1)[-1]}.tmp")
        target = self._path(name)
        stream = self._fs.create(hidden, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        self._fs.mkdirs(target.getParent())
        self._replace(hidden, target)

    def _replace(self, source, target) -> None:
        """Rename over the target in one step: readers see the old file or the new one."""
        if self._local:  # the system's own rename
            if not self._fs.rename(source, target):
                raise OSError(f"could not write {target}")
            return
        hadoop = self._jvm.org.apache.hadoop.fs
        rename = hadoop.Options.Rename
        kinds = self._gateway.new_array(rename, 1)
        kinds[0] = rename.OVERWRITE
        qualified = self._fs.makeQualified(target)
        context = hadoop.FileContext.getFileContext(qualified.toUri(), self._conf)
        context.rename(self._fs.makeQualified(source), qualified, kinds)

    def join_parts(self, parts: Store, name: str, start: str, end: str, skip: int) -> None:
        """One file of the part files of a folder in name order, with a start and an end.

        Bytes are copied stream to stream in the store; ``skip`` bytes of the first part that
        has any are left out.  The file appears under its name only when complete.
        """
        hidden = self._path(f".{name.rsplit('/', 1)[-1]}.tmp")
        out = self._fs.create(hidden, True)
        try:
            out.write(bytearray(start.encode("utf-8")))
            for part in parts.names():
                if not part.startswith("part-") or not parts.size(part):
                    continue
                stream = parts._fs.open(parts._path(part))
                try:
                    stream.seek(skip)
                    skip = 0
                    self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                finally:
                    stream.close()
            out.write(bytearray(end.encode("utf-8")))
        finally:
            out.close()
        self._fs.mkdirs(self._path(name).getParent())
        self._replace(hidden, self._path(name))

    def hidden_files(self, suffix: str) -> list[str]:
        """Files in the folder, or the folders of the glob, that Spark's listing leaves out."""
        pattern = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/[_.]*{suffix}")
        found = self._fs.globStatus(pattern) or []
        return sorted(item.getPath().toString() for item in found if item.isFile())

    def folders(self) -> list[str]:
        """The folder, or the folders of the glob; none where there are files or hidden folders among them."""
        found = self._fs.globStatus(self._path("")) or []
        hidden = any(item.getPath().getName()[:1] in ("_", ".") for item in found)
        if hidden or not all(item.isDirectory() for item in found):
            return []
        return sorted(item.getPath().toString() for item in found)

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
