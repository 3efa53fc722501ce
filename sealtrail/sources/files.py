"""Small files and listings on the file systems that ``pyarrow.fs`` opens.

Spark reads and writes all data; this is for the few bytes beside it, such as a store's log.
Local and mounted paths, S3, GCS, ABFS and HDFS (with its library) are supported.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as arrow_fs, parquet


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of ``path`` and the path within it."""
    if "://" not in path and not path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    for alias in ("s3a://", "s3n://"):
        if path.startswith(alias):
            path = "s3://" + path.removeprefix(alias)
    return arrow_fs.FileSystem.from_uri(path)


def names_in(path: str) -> list[str]:
    """Names of the files directly in a folder, sorted; none if there is no such folder."""
    system, root = file_system(path)
    found = system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == arrow_fs.FileType.File)


def data_files(path: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of the Parquet files in and below a folder."""
    system, root = file_system(path)
    found = system.get_file_info(arrow_fs.FileSelector(root, recursive=True, allow_not_found=True))
    prefix = root.rstrip("/") + "/"
    return sorted((f.path.removeprefix(prefix), f.size) for f in found if f.type == arrow_fs.FileType.File and f.path.endswith(".parquet"))


def rows_in(paths: list[str]) -> int:
    """Rows of Parquet files, from their footers."""
    total = 0
    for path in paths:
        system, root = file_system(path)
        total += parquet.read_metadata(root, filesystem=system).num_rows
    return total


def folders_in(path: str) -> list[str]:
    system, root = file_system(path)
    found = system.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == arrow_fs.FileType.Directory)


def read_bytes(path: str) -> bytes:
    system, root = file_system(path)
    with system.open_input_stream(root) as source:
        return source.read()


def put_new(path: str, data: bytes) -> bool:
    """Write a file that appears whole under its name; False if the name is taken.

    Locally a taken name is refused atomically.  Object stores have no such step here: there a
    folder must have one writer at a time.
    """
    system, root = file_system(path)
    folder = root.rsplit("/", 1)[0]
    system.create_dir(folder)
    temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(temporary) as out:
        out.write(data)
    if isinstance(system, arrow_fs.LocalFileSystem):
        try:
            os.link(temporary, root)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    if system.get_file_info(root).type != arrow_fs.FileType.NotFound:
        system.delete_file(temporary)
        return False
    system.move(temporary, root)
    return True


def delete_folder(path: str) -> None:
    system, root = file_system(path)
    if system.get_file_info(root).type == arrow_fs.FileType.Directory:
        system.delete_dir(root)


def delete_file(path: str) -> None:
    system, root = file_system(path)
    if system.get_file_info(root).type == arrow_fs.FileType.File:
        system.delete_file(root)
