"""Opening a path or URI through pyarrow's file systems, on the driver and on executors."""

from __future__ import annotations

import uuid


def open_file(uri: str):
    """A random-access file; any scheme that pyarrow knows."""
    import pyarrow.fs as pafs

    fs, path = (pafs.LocalFileSystem(), uri.removeprefix("file:")) if uri.startswith(("/", "file:")) else pafs.FileSystem.from_uri(uri)
    return fs.open_input_file("/" + path.lstrip("/") if fs.type_name == "local" else path)


def write_file(uri: str, data: bytes) -> None:
    """Written under another name and moved into place, so that a reader never sees half a file."""
    import pyarrow.fs as pafs

    fs, path = (pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")) if uri.startswith(("/", "file:")) else pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    fs.move(part, path)
