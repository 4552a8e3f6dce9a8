"""Small helpers shared by the Arrow-side operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

SLICE_BYTES = 4 << 20


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs whose ``name`` column holds about ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column(batch, name)), 0).to_pylist()
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as UTF-8 bytes, nulls as empty."""
    return [b"" if x is None else x for x in column(batch, name).cast(pa.binary()).to_pylist()]


def ensure_unique(columns: list[str], wanted: list[str]) -> dict[str, str]:
    """Names for ``wanted`` that clash with none of ``columns`` (case ignored, as Spark resolves names)."""
    taken = {c.lower() for c in columns}
    out = {}
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out[w] = name
    return out
