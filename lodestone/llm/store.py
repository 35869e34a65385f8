"""Files below a shared folder, written and read by executors.

Paths are URIs; ``pyarrow.fs`` opens them (local or network mounts, HDFS, object stores).  A task
writes to a name of its own and reports it in its output row, so only files of tasks whose output was
committed are ever read: attempts that failed or ran twice leave at most an unused file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/part-{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_input(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
