"""Files that tasks write to and read from the cluster's shared folder.

Tasks write under names of their own (a retried or doubled attempt never meets
another's file); a manifest that Spark commits says which files count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from voicegrid.session import scratch_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder, as a URI or an absolute path."""
    folder = f"{scratch_dir(spark)}/voicegrid/{name}-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return folder


def write_file(folder: str, suffix: str, content: bytes) -> str:
    """Writes one file under a new name and returns its address."""
    address = f"{folder}/{uuid.uuid4().hex}{suffix}"
    system, path = fs.FileSystem.from_uri(address)
    with system.open_output_stream(path, compression=None) as out:
        out.write(content)
    return address


def open_file(address: str):
    """A file open for random reads."""
    system, path = fs.FileSystem.from_uri(address)
    return system.open_input_file(path)
