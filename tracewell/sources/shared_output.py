"""Files that tasks write side by side and that appear together: a folder with a manifest of what counts.

A task writes under a folder of its job's; the commit moves what the tasks report into place and then replaces the manifest, whose
rename is the one step that makes the files count. Whatever an aborted job or a lost attempt has written is never named there.
"""

import json
import os
import shutil
import uuid
from dataclasses import dataclass, field

from pyspark.sql.datasource import WriterCommitMessage

MANIFEST = "_manifest.json"


@dataclass
class Written(WriterCommitMessage):
    """Files of one task, relative to the job's folder, with what is told of each."""

    files: list[tuple[str, dict]] = field(default_factory=list)


def members(path: str) -> list[str]:
    """The files that count: the path itself, or those that a folder's manifest names."""
    if not os.path.isdir(path):
        return [path]
    try:
        with open(os.path.join(path, MANIFEST)) as f:
            return [os.path.join(path, x["file"]) for x in json.load(f)["files"]]
    except FileNotFoundError:
        raise ValueError(f"{path} has no manifest: nothing was committed to it") from None


class SharedOutput:
    """One job's writing to a folder that all tasks share."""

    def __init__(self, path: str, overwrite: bool, ending: str):
        self.path, self.overwrite, self.ending = path, overwrite, ending
        self.job = uuid.uuid4().hex
        self.folder = os.path.join(path, f"_writing-{self.job}")

    def new_file(self) -> str:
        """A place for a task's next file; each attempt has names of its own."""
        os.makedirs(self.folder, exist_ok=True)
        return os.path.join(self.folder, f"part-{uuid.uuid4().hex}{self.ending}")

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        manifest, files = os.path.join(self.path, MANIFEST), []
        if os.path.exists(manifest):
            with open(manifest) as f:
                before = json.load(f)["files"]
        else:
            before = []
        files = [] if self.overwrite else list(before)
        for message in messages:
            for name, told in message.files if message else ():
                os.replace(os.path.join(self.folder, name), os.path.join(self.path, name))
                files.append({"file": name, **told})
        with open(f"{manifest}-{self.job}", "w") as f:
            json.dump({"files": sorted(files, key=lambda x: x["file"])}, f)
        os.replace(f"{manifest}-{self.job}", manifest)
        if self.overwrite:
            for x in before:
                os.unlink(os.path.join(self.path, x["file"]))
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
