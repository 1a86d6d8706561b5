"""Folders whose files count once a commit names them: tasks write files of their own, the driver commits all or none.

A commit is one JSON document, renamed into place: its entries (a key, a file and what the writer found while writing it) and their hash.  Files that no
commit names, such as those of a task or a job that was cut off, are nobody's.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid

from .contracts import canonical_hash


def file_system(url: str):
    """(pyarrow file system, path in it) of a URL or a plain path."""
    from pyarrow import fs

    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), os.path.abspath(url))


def scratch(spark, name: str) -> str:
    """A new folder below that which driver and executors share (``spark.checkpoint.dir``); where that is unset and the master local, as in tests, a local one."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df, name: str):
    """``df`` written once to a new scratch folder and read again: its lineage ends there, and its size is known to the plans that use it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_name(key: str) -> str:
    """A new name for a file of ``key``, whatever its characters."""
    return f"{hashlib.sha256(key.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"


class HashedFile:
    """An output stream that hashes what goes through; ``discard`` leaves nothing."""

    def __init__(self, root: str, name: str):
        self.system, self.path = file_system(f"{root}/{name}")
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.out, self.name = self.system.open_output_stream(self.path), name
        self.sha, self.bytes, self.closed = hashlib.sha256(), 0, False

    def write(self, data) -> int:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        return len(data)

    def writable(self) -> bool:
        return True

    def flush(self) -> None:
        self.out.flush()

    def tell(self) -> int:
        return self.bytes

    def close(self) -> None:
        if not self.closed:
            self.out.close()
            self.closed = True

    def entry(self) -> dict:
        self.close()
        return {"file": self.name, "bytes": self.bytes, "sha256": self.sha.hexdigest()}

    def discard(self) -> None:
        self.close()
        self.system.delete_file(self.path)


def write_once(url: str, data: bytes) -> None:
    """Written under a name of its own, then renamed; what is there already is an error."""
    system, path = file_system(url)
    system.create_dir(os.path.dirname(path), recursive=True)
    if system.get_file_info(path).type.name != "NotFound":
        raise FileExistsError(url)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, path)


def commit(root: str, entries: list[dict], unique: bool = True) -> str | None:
    """Make the entries count, together; with ``unique`` a key that an earlier commit has is an error.  Nothing is written without entries."""
    if not entries:
        return None
    if unique:
        have = {e["key"] for e in committed(root)}
        if again := sorted({e["key"] for e in entries} & have):
            raise ValueError(f"{again[:5]} are committed already")
    body = {"entries": sorted(entries, key=lambda e: (e["key"], e["file"]))}
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    write_once(f"{root}/commits/{name}.json", json.dumps(body | {"hash": canonical_hash(body)}, sort_keys=True).encode())
    return name


def committed(root: str) -> list[dict]:
    """Entries of all commits; of a key that two commits have, such as of two jobs at once, those of the first.  A changed commit is an error."""
    from pyarrow import fs

    system, path = file_system(f"{root}/commits")
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".json"))
    out, owner = [], {}
    for name in names:
        with system.open_input_file(name) as f:
            found = json.loads(f.read())
        if canonical_hash({"entries": found["entries"]}) != found["hash"]:
            raise ValueError(f"the commit {name} was changed")
        out += [e for e in found["entries"] if owner.setdefault(e["key"], name) == name]
    return out


def discard(root: str, entries: list[dict]) -> None:
    """Delete the files of a job that failed, if it committed none of them."""
    kept = {e["file"] for e in committed(root)}
    system, _ = file_system(root)
    for e in entries:
        for name in (e["file"], e.get("index")):
            path = file_system(f"{root}/{name}")[1]
            if name and name not in kept and system.get_file_info(path).type.name == "File":
                system.delete_file(path)
