"""Files that tasks write to and read from the shared folder, whatever store it is in."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def _resolve(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def new_file(folder: str, stem: str, suffix: str) -> str:
    """A path no other attempt of the task uses; only paths that a finished task reports are read."""
    return f"{folder}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"


def create(path: str):
    """An output stream; folders are made where the store has them."""
    fs, p = _resolve(path)
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(p)


def open_ranges(path: str):
    """A random access file: read_at(n_bytes, offset), size()."""
    fs, p = _resolve(path)
    return fs.open_input_file(p)


def read_spans(path: str, spans: list[tuple[int, int]], most: int = 8 << 20, gap: int = 1 << 16) -> Iterator[bytes]:
    """Bytes of (offset, length) spans in ascending order; near spans share one read of at most ``most`` bytes, or one span."""
    with open_ranges(path) as f:
        at = 0
        while at < len(spans):
            low, high, last = spans[at][0], sum(spans[at]), at + 1
            while last < len(spans) and spans[last][0] - high <= gap and sum(spans[last]) - low <= most:
                high, last = max(high, sum(spans[last])), last + 1
            block = f.read_at(high - low, low)
            for offset, n in spans[at:last]:
                yield block[offset - low:offset - low + n]
            at = last
