"""Files by Arrow's file systems: local or mounted folders, HDFS and object stores, by path or URI."""

from __future__ import annotations

import fnmatch


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, of the files in the folder, or of those whose names match the last part of path."""
    from pyarrow.fs import FileSelector, FileType

    fs, at = opened(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, name = at.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = [i for i in fs.get_file_info(FileSelector(folder)) if i.type == FileType.File and fnmatch.fnmatch(i.base_name, name)]
    else:
        one = fs.get_file_info(at)
        found = [one] if one.type == FileType.File else [i for i in fs.get_file_info(FileSelector(at)) if i.type == FileType.File and i.base_name[0] not in "._"]
    return sorted((scheme + i.path, i.size) for i in found)


def read_text(path: str) -> str | None:
    """None if there is no such file."""
    from pyarrow.fs import FileType

    fs, at = opened(path)
    if fs.get_file_info(at).type != FileType.File:
        return None
    with fs.open_input_stream(at) as f:
        return f.read().decode()


def write_text(path: str, text: str) -> None:
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        out.write(text.encode())


def exists(path: str) -> bool:
    from pyarrow.fs import FileType

    fs, at = opened(path)
    return fs.get_file_info(at).type != FileType.NotFound


def drop(path: str) -> None:
    """Deletes a folder, if it is there."""
    if exists(path):
        fs, at = opened(path)
        fs.delete_dir(at)
