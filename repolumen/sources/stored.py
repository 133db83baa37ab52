"""A file per document, in folders that the tasks of one write put in place.

For folders that every machine mounts: there Hadoop starts a process for the mode of each
file it makes, and the driver would list all files. Here tasks make, list and read them.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa

_NAME, _PART, _DRAFT = b"name=", "part-", "_draft-"
#: What a file name cannot hold, and the sign that tells it; that sign comes first.
_ESCAPES = ((b"%", b"%25"), (b"/", b"%2F"), (b"\0", b"%00"))
#: Rows and bytes of a batch that is read, unless one document has more.
_ROWS, _BYTES = 1000, 4 << 20


def _file_name(name: bytes) -> bytes:
    for plain, escaped in _ESCAPES:
        name = name.replace(plain, escaped)
    return _NAME + name


def _document_name(file: bytes) -> bytes:
    name = file.removeprefix(_NAME)
    for plain, escaped in reversed(_ESCAPES):
        name = name.replace(escaped, plain)
    return name


def write_part(root: str, part: str, batches: Iterator[pa.RecordBatch]) -> None:
    """A folder of files out of rows (name, text); a text is a line, those of one name share a file.

    The folder is in place as a whole or not at all. If another attempt of the task has put
    it there, that one stays.
    """
    draft, target = f"{root}/{_DRAFT}{uuid.uuid4().hex}", f"{root}/{_PART}{part}"
    os.mkdir(draft)
    try:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                with open(os.path.join(os.fsencode(draft), _file_name(name)), "ab") as file:
                    file.write(text.as_buffer() or b"")
                    file.write(b"\n")
        try:
            os.rename(draft, target)
        except OSError:
            if not os.path.isdir(target):
                raise
    finally:
        shutil.rmtree(draft, ignore_errors=True)


def part_folders(root: str) -> list[str]:
    """Folders put in place by :func:`write_part`, none if there is no such folder."""
    if not os.path.isdir(root):
        return []
    with os.scandir(root) as found:
        return sorted(f.path for f in found if f.name.startswith(_PART) and f.is_dir())


def read_part(folder: str) -> Iterator[pa.RecordBatch]:
    """Names and whole files of a folder."""
    held, size = [], 0
    with os.scandir(os.fsencode(folder)) as files:
        for entry in files:
            with open(entry.path, "rb") as file:
                text = file.read()
            if held and (len(held) == _ROWS or size + len(text) > _BYTES):
                yield _batch(held)
                held, size = [], 0
            held.append((_document_name(entry.name), text))
            size += len(text)
    if held:
        yield _batch(held)


def _batch(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    names, texts = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(names, pa.binary()), pa.array(texts, pa.binary())], ["name", "content"]
    )
