"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two chunks are spliced at a
boundary that is proven stable and that both tokenisations show: a place where a run of
spaces starts after another character. No piece of the vocabulary holds a space mark after
another character (checked when the model is loaded), so no merge ever crosses such a place
and the tokens on either side don't depend on the other. A chunk goes on to the next such
place and an overlap beyond; where two chunks don't agree on it, it is widened to a later one, in the end to the rest of the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_of

MARK = "▁"  # what the library writes for a space
SPACES = " " + MARK
BOUNDARY = re.compile(f"(?<=[^{SPACES}])[{SPACES}]")


@lru_cache(maxsize=2)
def load(model_path: str):
    """The processor, and whether boundaries before spaces are proven stable for it."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    stable = not any(MARK in p.id_to_piece(i).lstrip(MARK) for i in range(p.get_piece_size()))
    return p, stable


def boundary(text: str, start: int) -> int | None:
    """The first place from start on where a run of spaces starts after another character."""
    found = BOUNDARY.search(text, max(start, 1))
    return found.start() if found else None


@lru_cache(maxsize=2)
def _piece_bytes(processor) -> np.ndarray | None:
    """How many bytes of a text each piece covers; None if the model rewrites texts, so that pieces don't tell."""
    probe = "ﬁ①  Ａ "
    if processor.normalize(probe) != MARK + probe.replace(" ", MARK):
        return None
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    return np.array([1 if processor.is_byte(i) else 0 if processor.is_control(i) or processor.is_unknown(i) else len(x.replace(MARK, " ").encode()) for i, x in enumerate(pieces)])


def token_starts(processor, text: str) -> np.ndarray:
    """Where each token starts in text, in code points; byte tokens of one character start together."""
    bytes_ = _piece_bytes(processor)
    if bytes_ is not None:
        lengths = bytes_[processor.encode(text, return_type="numpy")]
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        # the library writes a mark before a text; a mark of the text itself is longer than a space and shows in the sum
        if len(data) and lengths.sum() == len(data) + 1:
            character = np.cumsum((data & 0xC0) != 0x80) - 1
            return character[np.maximum(0, np.cumsum(lengths) - lengths - 1)]
    return np.array([begin for begin, _ in processor.encode(text, return_type="offset_mapping")["offsets"]], dtype=np.int64)


def _shows(starts: np.ndarray, place: int) -> bool:
    at = np.searchsorted(starts, place)
    return at < len(starts) and starts[at] == place


def count_spliced(processor, text: str, chunk: int, overlap: int) -> int:
    """Tokens of text, from chunks spliced at proven boundaries.

    A chunk ends `overlap` characters after the first boundary beyond its length, however far that is, and the next
    one starts as many before it: each character is encoded once, and those of overlaps twice. Should a chunk not
    show the boundary, the one before is encoded anew up to a later one.
    """
    total, start, first = 0, 0, 0  # tokens that start before `first` have been counted
    before, after = None, 0
    while True:
        cut_at = boundary(text, max(start + chunk, after))
        if not start and cut_at is None:
            return len(processor.encode(text, return_type="numpy"))
        ours = token_starts(processor, text[start : None if cut_at is None else cut_at + overlap]) + start
        if start and not _shows(ours, first):  # no alignment: widen the chunk before
            (total, start, first), after, before = before, first + max(overlap, first - before[1]), None
            continue
        if cut_at is None:
            return total + int((ours >= first).sum())
        if not _shows(ours, cut_at):
            after = cut_at + max(overlap, cut_at - start)
            continue
        before, after = (total, start, first), 0
        total += int(((ours >= first) & (ours < cut_at)).sum())
        start, first = max(start + 1, cut_at - overlap), cut_at


def count_tokens(processor, stable: bool, texts: list[str], *, huge: int, chunk: int, overlap: int, slice_chars: int = 1 << 20) -> list[int]:
    """Token counts of texts; those of at most `huge` characters are encoded whole, in slices of bounded length."""
    counts, held, chars = [0] * len(texts), [], 0

    def flush() -> None:
        for i, ids in zip(held, processor.encode([texts[i] for i in held], num_threads=1, return_type="numpy")):
            counts[i] = len(ids)
        held.clear()

    for i, text in enumerate(texts):
        if len(text) > huge and stable:
            counts[i] = count_spliced(processor, text, chunk, overlap)
            continue
        held.append(i)
        chars += len(text)
        if chars >= slice_chars:
            flush()
            chars = 0
    if held:
        flush()
    return counts


def _count(batches: Iterator[pa.RecordBatch], *, model_path: str, limit: int, huge: int, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    processor, stable = load(model_path)
    for batch in batches:
        counts = pa.array(count_tokens(processor, stable, batch.column("text").to_pylist(), huge=huge, chunk=chunk, overlap=overlap), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts, pa.array([c > limit for c in counts.to_pylist()], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, model_path: str, *, limit: int = 4096, huge: int = 8_192, chunk: int = 4_096, overlap: int = 128) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Texts of more than `huge` characters are spliced from chunks of `chunk`; a shorter one is its own only chunk.
    A text of any length without a proven boundary, such as a run of one letter, is encoded whole in the end.
    Null and empty texts have 0 bytes and 0 tokens. Repeated rows stay; an empty table gives an
    empty one. Only doc_id and text are read. No shuffle: one narrow pass.
    """
    text = text_of()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    ship_package(docs.sparkSession)
    f = partial(_count, model_path=model_path, limit=limit, huge=huge, chunk=chunk, overlap=overlap)
    return rows.mapInArrow(f, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
