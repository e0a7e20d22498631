"""Arrow batch helpers shared by the operators that run Python on executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in runs of about this many UTF-8 bytes, so that what a task
#: holds beside its Arrow batch does not depend on how long the documents are.
RUN_BYTES = 1 << 20


def text_runs(batch: pa.RecordBatch, limit: int = RUN_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, texts) over the ``text`` column; null counts as empty; one text is never split."""
    column = batch.column(batch.schema.get_field_index("text"))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > limit:
            yield start, i, [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes), [t or "" for t in column.slice(start).to_pylist()]


class Memo(dict):
    """A cache that is emptied when it holds ``cap`` entries: bounded memory, same results."""

    def __init__(self, make, cap: int):
        super().__init__()
        self._make, self._cap = make, cap

    def __missing__(self, key):
        if len(self) >= self._cap:
            self.clear()
        value = self[key] = self._make(key)
        return value
