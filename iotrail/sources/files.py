"""File systems for code that reads bytes in Python: on shared disks, or in stores that pyarrow knows."""

from __future__ import annotations

from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """What opens a path as Spark writes it (a plain path, file:/..., or scheme://...), and the path within it. An OSError if
    pyarrow doesn't know the scheme."""
    if path.startswith("file:"):
        rest = path[5:]
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(quote(path, safe=":/?*[]=&@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
        raise OSError(str(e)) from e
