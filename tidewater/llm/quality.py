"""Quality rules: compression bands over whole documents and fixed chunks.

A text is compressed whole and, where longer than a chunk, chunk by chunk. Repetitive text
compresses below the band of its length, random or encoded text above it. Both limits
depend on the length, as short texts pay the frame header and have nothing to repeat yet.

Defined results: a null text counts as empty; a text of no words fails the base rule; a text of any
length is compressed whole, in one call; a ratio equal to a limit is inside the band; repeated
rows each get their own row; an empty table gives an empty one; extra columns, whatever their
names, are ignored by :func:`score` and kept as they are by :func:`keep`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tidewater.llm import textkit

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, bad_chunk_share double, verdict string"
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """(log2 of the bytes, least ratio, largest ratio), straight lines between.

    The least ratios lie 2.8 standard deviations below the mean of documents labelled as good, from 64 bytes
    to 32 KB; beyond, they go on falling slowly, by judgement. Prose shrinks to 0.6 at 512 bytes and 0.4 at 32 KB;
    base64 and ciphers stay above 0.75, as six bits a byte are left: the largest ratios lie between.
    """

    knots: tuple[tuple[float, float, float], ...] = (
        (4, 0.500, 1.75), (5, 0.750, 1.75), (6, 0.910, 1.40), (7, 0.679, 1.25), (8, 0.589, 1.00), (9, 0.559, 0.84), (10, 0.497, 0.74), (11, 0.469, 0.72),
        (12, 0.446, 0.70), (13, 0.426, 0.68), (14, 0.409, 0.66), (15, 0.393, 0.64), (17, 0.360, 0.62), (20, 0.300, 0.62), (24, 0.250, 0.62),
    )
    chunk_bytes: int = 4096
    #: A text is rejected if more than this share of its bytes lies in chunks outside the chunk band.
    chunk_share: float = 0.5
    level: int = 3

    def limits(self, size: int) -> tuple[float, float]:
        at, low, high = zip(*self.knots, strict=True)
        return float(np.interp(np.log2(size), at, low)), float(np.interp(np.log2(size), at, high))


def _compression(data: memoryview, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    size = len(data)
    if not size:
        return 1.0, 0.0, "fits"
    low, high = bands.limits(size)
    ratio, bad = len(packer.compress(data)) / size, 0
    if size > bands.chunk_bytes:
        full = bands.limits(bands.chunk_bytes)
        for at in range(0, size, bands.chunk_bytes):
            part = data[at : at + bands.chunk_bytes]
            least, most = full if len(part) == bands.chunk_bytes else bands.limits(len(part))
            bad += len(part) * (not least <= len(packer.compress(part)) / len(part) <= most)
    bad_share = bad / size
    if ratio < low:
        return ratio, bad_share, "repetitive"
    if ratio > high:
        return ratio, bad_share, "incompressible"
    return ratio, bad_share, "chunks" if bad_share > bands.chunk_share else "fits"


def measure(column: pa.Array, bands: Bands) -> pa.RecordBatch:
    """The columns of STATS for each text of a column."""
    packer = zstandard.ZstdCompressor(level=bands.level)
    out: list[list[np.ndarray]] = [[] for _ in range(10)]
    for first, end, data, at in textkit.slices(column):
        t = textkit.Texts(data, at)
        rows = end - first
        n_words = t.n_words
        letters = t.word & ((data & 0xC0) != 0x80)
        # Lines: between newlines and row edges; those with a word count.
        breaks = np.flatnonzero(data == 10)
        begins = np.unique(np.concatenate([at[:-1], breaks + 1]))
        begins = begins[begins < len(data)]
        row = np.searchsorted(at, begins, "right") - 1
        stops = np.minimum(np.concatenate([begins[1:], [len(data)]]), at[row + 1]) if len(begins) else begins
        ends_in_break = (stops > begins) & (data[np.maximum(stops - 1, 0)] == 10) if len(begins) else np.zeros(0, bool)
        stops = stops - ends_in_break
        worded = np.searchsorted(t.start, stops) > np.searchsorted(t.start, begins)
        begins, stops, row = begins[worded], stops[worded], row[worded]
        _, later = textkit.repeats(row, t.span_hash(begins, stops) if len(begins) else np.zeros(0, np.uint64))
        # Five-word windows found twice or more in their text.
        windows, at_window = t.windows(t.word_hash(), 5) if len(t.start) else (np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64))
        of = np.repeat(np.arange(rows), np.diff(at_window))
        again, _ = textkit.repeats(of, windows)
        starts = t.first[:-1][of] + np.arange(len(of)) - at_window[:-1][of]
        inside = np.concatenate([[0], np.cumsum(textkit.spread(again, 5, starts, len(t.start)))])
        n_repeat = inside[t.first[1:]] - inside[t.first[:-1]]
        base = (n_words < 10) | (100 * n_repeat > 20 * n_words)
        view = memoryview(np.ascontiguousarray(data))
        packed = [_compression(view[at[i] : at[i + 1]], bands, packer) for i in range(rows)]
        verdict = np.array([x[2] for x in packed], object)
        values = (n_words, t.per_row(letters), t.per_row(SYMBOL[data]), np.bincount(row[later], minlength=rows), n_repeat, base, ~base & (verdict == "fits"), np.array([x[0] for x in packed]), np.array([x[1] for x in packed]), verdict)
        for kept, value in zip(out, values, strict=True):
            kept.append(value)
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()]
    names = [x.split()[0] for x in STATS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], k) for x, k in zip(out, types, strict=True)], names)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row a document: its id, the base counts, the ratios and the verdict."""
    slim = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = measure(b.column(1), bands)
            yield pa.RecordBatch.from_arrays([b.column(0), *got.columns], [id_col, *got.schema.names])

    return slim.mapInArrow(run, f"`{id_col}` {slim.schema['_id'].dataType.simpleString()}, {STATS}")


def keep(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(measure(b.column(at), bands).column("kept"))

    return docs.mapInArrow(run, docs.schema)
