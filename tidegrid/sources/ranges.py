"""Reading parts of files where a task runs, from any store that pyarrow knows (local, HDFS, S3, GCS)."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """Local paths come plain or as file:/...; others are URIs."""
    local = re.sub(r"^file:/*", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


@contextmanager
def opened(path: str, retries: int = 1, wait_s: float = 1.0) -> Iterator[pa.NativeFile]:
    """An open file; a store that fails to open it, as busy ones do, is asked again after a while."""
    store, inner = _opened(path)
    for left in range(retries, -1, -1):
        try:
            file = store.open_input_file(inner)
            break
        except FileNotFoundError:
            raise
        except OSError:
            if not left:
                raise
            time.sleep(wait_s)
    with file:
        yield file


def size(path: str) -> int:
    store, inner = _opened(path)
    return store.get_file_info(inner).size
