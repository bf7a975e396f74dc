"""Random access to files in any store that executors can reach."""

from __future__ import annotations

import os
import tempfile
import uuid


def store_of(uri: str):
    """(pyarrow file system, path)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def open_input(uri: str):
    store, path = store_of(uri)
    return store.open_input_file(path)


def scratch_dir(spark) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or with a local master under the temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.gettempdir()
    uri = f"{base.rstrip('/')}/relief-{uuid.uuid4().hex}"
    store, path = store_of(uri)
    store.create_dir(path, recursive=True)
    return uri
