"""Files in the shared folder, by URI, from any executor."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as file:///shared/x, s3://bucket/x or hdfs://host/x."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str) -> Iterator[io.BufferedIOBase]:
    """A stream whose bytes appear under ``uri`` only when all are written.

    A task that is run again writes the same name again; readers never see a part of it.
    """
    store, path = at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    early = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with store.open_output_stream(early) as out:
            yield out
        store.move(early, path)
    except BaseException:
        if store.get_file_info(early).type != fs.FileType.NotFound:
            store.delete_file(early)
        raise


def opened(uri: str):
    """A stream to read and seek in."""
    store, path = at(uri)
    return store.open_input_file(path)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files of a folder whose names end in ``suffix``, by name."""
    store, path = at(uri)
    found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    scheme = uri.partition("://")[0] if "://" in uri else "file"
    head = uri.rstrip("/")
    out = []
    for x in found:
        if x.type == fs.FileType.File and x.path.endswith(suffix):
            tail = x.path[len(path.rstrip("/")) :]
            out.append((head + tail if scheme else x.path, x.size))
    return sorted(out)
