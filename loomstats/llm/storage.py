"""Byte files in the shared folder, written and read inside tasks with pyarrow's file systems.

A file gets a name of its own per attempt and counts only once the manifest row of its task is committed by Spark, so a
task that ran twice, or was lost half way, leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import re
import uuid

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; `file:/x` as Hadoop writes it is understood."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def create(folder: str, suffix: str):
    """A new file below `folder`: its URI and the open stream."""
    system, path = resolve(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str):
    """A seekable stream."""
    system, path = resolve(uri)
    return system.open_input_file(path)
