"""Arrow batches in pieces of bounded size, for the operators that run in Python."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Characters of text in one piece, at least one row.
PIECE_CHARS = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: a worker stays between tasks, and other operators run beside it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, their texts with null as empty), cut so that long texts don't pile up."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        start, size = 0, 0
        held: list[str] = []
        for i in range(batch.num_rows):
            held.append(texts[i].as_py() or "")
            size += len(held[-1])
            if size >= PIECE_CHARS:
                yield batch.slice(start, i + 1 - start), held
                start, size, held = i + 1, 0, []
        if held:
            yield batch.slice(start), held
    batch = texts = held = None
    give_back()


class Memory(dict):
    """What a function gave for short strings so far; past ``limit`` entries it starts anew."""

    def __init__(self, make: Callable, limit: int, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, key: str):
        made = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[key] = made
        return made
