"""Files of a write that appear all together or not at all, on any file system that Arrow knows by its address."""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address or of a path of this machine, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_name(job_id: object, ending: str) -> str:
    """A job's file: its id with what no file name may hold as percent codes, so different ids have different files."""
    return quote(str(job_id), safe=" +,;=@()[]{}!'&$~") + ending


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they wait, and where they belong."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Staged:
    """A folder beside the result where tasks leave their files until all are there."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.waiting = posixpath.join(path, f"_waiting-{uuid.uuid4().hex}")

    def place(self) -> str:
        """A new folder for a task's attempt: two attempts of one task never share files."""
        system, folder = file_system(posixpath.join(self.waiting, uuid.uuid4().hex))
        system.create_dir(folder)
        return posixpath.join(self.waiting, posixpath.basename(folder))

    def commit(self, written: list[Written | None]) -> None:
        system, folder = file_system(self.path)
        system.create_dir(folder)
        files = [f for message in written if message for f in message.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(written)
            raise ValueError("rows of one job came from two tasks")
        if self.overwrite:
            for info in system.get_file_info(fs.FileSelector(folder)):
                if info.type == fs.FileType.File and not info.base_name.startswith(("_", ".")):
                    system.delete_file(info.path)
        for waits, name in files:
            system.move(file_system(waits)[1], posixpath.join(folder, name))
        self.abort(written)

    def abort(self, written: list[Written | None]) -> None:
        """Nothing is left of the files that still wait."""
        system, folder = file_system(self.waiting)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
