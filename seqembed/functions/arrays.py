"""Arrow columns to numpy matrices, without a Python step per row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from .alphabet import Alphabet


def text_codes(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all characters of a string column, and the row boundaries among them."""
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    text = text[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    leading = (text & 0xC0) != 0x80  # False on the later bytes of a multi-byte character
    if not leading.all():
        bounds = np.concatenate([[0], np.cumsum(leading)])[bounds]
        text = text[leading]
    table = np.full(256, alphabet.unk_id, np.int32)
    table[:128] = alphabet.ascii_ids()
    return table[text], bounds


def framed_codes(column: pa.Array, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids with cls before and eos after each row, the row starts and the row lengths."""
    codes, bounds = text_codes(column, alphabet)
    lengths = np.diff(bounds)
    starts = bounds[:-1] + 2 * np.arange(len(lengths))
    ends = starts + lengths + 1
    framed = np.empty(len(codes) + 2 * len(lengths), np.int32)
    body = np.ones(len(framed), bool)
    body[starts] = body[ends] = False
    framed[body] = codes
    framed[starts] = alphabet.cls_id
    framed[ends] = alphabet.eos_id
    return framed, starts, lengths + 2


def windowed_codes(column: pa.Array, alphabet: Alphabet, body: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows cut into windows of at most `body` characters, each with cls before and eos after.

    Ids of all windows, their starts and lengths, and the row of each; an empty row is one empty window.
    """
    codes, bounds = text_codes(column, alphabet)
    sizes = np.diff(bounds)
    windows = np.maximum(1, -(-sizes // body))
    row = np.repeat(np.arange(len(sizes)), windows)
    within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    lengths = np.minimum(body, sizes[row] - within * body)
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    framed = np.empty(len(codes) + 2 * len(row), np.int32)
    inside = np.ones(len(framed), bool)
    inside[starts] = inside[starts + lengths + 1] = False
    framed[inside] = codes
    framed[starts], framed[starts + lengths + 1] = alphabet.cls_id, alphabet.eos_id
    return framed, starts, lengths + 2, row


def byte_runs(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows of about `max_bytes`."""
    for batch in batches:
        if batch.num_rows:
            step = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                yield batch.slice(start, step)


def width_runs(batch: pa.RecordBatch, widths: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """An Arrow batch cut into runs of rows whose widths add up to about `most`, at least a row each."""
    part = (np.cumsum(widths) - widths) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], batch.num_rows)):
        yield batch.slice(start, end - start)


def list_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of an integer list column, and the row boundaries among them."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


def pad_rows(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int,
             pad: int) -> np.ndarray:
    """Rows `values[start:start + length]` left-aligned in a matrix filled with `pad`."""
    out = np.full((len(starts), width), pad, np.int32)
    if width:
        inside = np.arange(width) < lengths[:, None]
        out[inside] = values[(starts[:, None] + np.arange(width))[inside]]
    return out


def list_column(rows: np.ndarray) -> pa.Array:
    """A matrix as a column of lists."""
    count, width = rows.shape
    bounds = pa.array(np.arange(count + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(bounds, pa.array(np.ascontiguousarray(rows).ravel()))
