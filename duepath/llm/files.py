"""Files in the shared folder, by any scheme that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)
