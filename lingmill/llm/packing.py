"""Best-fit packing of documents into sequences by hierarchical residual packing.

Documents become token pieces of at most `capacity`. Full pieces are sequences already. Each
partition packs its other pieces by best fit (decreasing) in blocks of bounded length and
emits nearly full bins; underfull bins go on as items of the next round, which deals them
into as many groups as their number asks for, until one group holds them all or a round
no longer joins any two. A bin carries its members, at most `capacity` of them, so memory is bounded
by the block length. Each round is cut in the shared checkpoint folder.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import filterfalse, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship_package, text_of, trim

MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_BINS = f"load int, done boolean, members array<{MEMBER}>"


#: Where a space starts between two characters that are no white space. Pre-tokens of a byte-level BPE hold a space
#: only at their start or among white space, and none looks back, so the ids on either side don't depend on the other.
BOUNDARY = re.compile(r"(?<=[!-~\w])(?= [!-~\w])")

_LETTER, _SIGN, _ASCII = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r"!-/:-@\[-`{-~", r"(?=[\x00-\x7f]|\Z)"
#: Runs of one or more whole pre-tokens, from a place where one starts: a word, signs, a line end, a number or a contraction that what
#: follows can't lengthen; else all up to the next boundary. They make up the text.
_RUNS = re.compile(
    rf" ?[{_LETTER}]++{_ASCII}|(?: [{_SIGN}]|(?!')[{_SIGN}])[{_SIGN}]*+(?=[A-Za-z0-9 \n]|\Z)|\n(?=[!-~{_LETTER}])"
    rf"| ?[0-9]++{_ASCII}|'(?:[stmd]|re|ve|ll)|(?s:.)+?(?:{BOUNDARY.pattern}|\Z)"
)
#: Runs that are one pre-token, and go to the library's model without its search for pre-tokens.
_ONE = re.compile(rf" ?(?:[{_LETTER}]+|[{_SIGN}]+|[0-9]+)")
#: For Arrow: a space that does not stand so, but for one at the start of a text.
_OTHER_SPACE = r"[^!-~\pL\pN_] | (?:[^!-~\pL\pN_]|$)"
#: Runs that stand as a line of their own: white space is at most one space, at the start, and inside.
_LINE = re.compile(r" ?[!-~\w](?:.*[!-~\w])?")


class Encoder:
    """Ids of whole texts by the library's tokenizer at path, with a memo of the ids of short runs of pre-tokens.

    Texts without added tokens whose spaces are all boundaries are split into words by Arrow, and only the distinct words of all
    texts given at once are cut in runs. Other texts, and those of more than `longest_text` bytes, are cut in runs as a whole.

    The memo has two generations of about `memo` runs: when the younger is full it takes the older's place, and what is met again comes back
    from there, so runs that are met often stay. Other texts are taken in slices of about
    `slice_chars`, cut at boundaries, and slices in runs: a word and the signs after it are two, so few runs are new.
    A stretch that only boundaries cut goes to the library whole. New runs go to
    the library as lines of one text: a line end before anything but white space is a pre-token, and a token, of its own.
    Added tokens are taken out first, as the library does; texts with one that takes more than its own characters go whole.
    """

    def __init__(self, path: str, memo: int = 300_000, longest: int = 40, slice_chars: int = 1 << 17, lines: int = 64, longest_text: int = 1 << 23):
        from tokenizers import Tokenizer

        self.library, self.most, self.longest, self.slice_chars, self.lines = Tokenizer.from_file(path), memo, longest, slice_chars, lines
        self.longest_text, self.byte_chars = longest_text, _byte_chars()
        ends = {tuple(self.library.encode(x, add_special_tokens=False).ids[1:-1]) for x in ("a\n b", "7\n 7", "!\n !", "a\nb", "7\n7", "!\n!")}
        alone = self.library.encode("\n", add_special_tokens=False).ids
        self.line_end = alone[0] if ends == {tuple(alone)} and len(alone) == 1 else None
        added = sorted(self.library.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))
        pattern = lambda some: re.compile("(" + "|".join(re.escape(t.content) for t in some) + ")") if some else None
        self.added, self.contents = pattern(added), {t.content for t in added}
        self.greedy = pattern([t for t in added if t.single_word or t.lstrip or t.rstrip or t.normalized])
        probes = ["a", " word", " 12", "7", "!?", " ...", "é", " Ünïcödé", "antidisestablishmentarianism", " '"]
        self.by_model = self._by_model(probes) == self._raw(probes)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.slice_chars:
            found = BOUNDARY.search(text, at + self.slice_chars)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's slices and added tokens, in order, and whether one goes to the library whole."""
        if self.greedy and self.greedy.search(text):
            yield text, True
            return
        for k, part in enumerate(self.added.split(text) if self.added else [text]):
            yield from [(part, True)] if k % 2 else ((x, False) for x in self._slices(part))

    def _raw(self, runs: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]

    def _by_model(self, runs: list[str]) -> list[bytes]:
        """Ids of runs that are one pre-token each, by the library's model, which takes a character for each byte."""
        tokenize = self.library.model.tokenize
        taken = "\n".join(runs).encode().decode("latin-1").translate(self.byte_chars).split(self.byte_chars[10]) if runs else []
        return [array("I", [t.id for t in tokenize(r)]).tobytes() for r in taken]

    def _learn(self, new: set[str]) -> list[str]:
        """Puts the ids of runs into the memo. Returns the long ones."""
        one = [r for r in new if _ONE.fullmatch(r) and r not in self.contents] if self.by_model else []
        self.memo.update(zip(one, self._by_model(one)))
        rest = new.difference(one)
        plain = [r for r in rest if _LINE.fullmatch(r) and r not in self.contents] if self.line_end is not None else []
        rest = list(rest.difference(plain))
        parts = [plain[at : at + self.lines] for at in range(0, len(plain), self.lines)]
        for part, e in zip(parts, self.library.encode_batch_fast(["\n".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.line_end)
            if len(ends) == len(part) - 1:
                raw, cuts = ids.tobytes(), (4 * ends).tolist()
                self.memo.update(zip(part, [raw[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(raw)])]))
            else:
                rest.extend(part)
        self.memo.update(zip(rest, self._raw(rest)))
        return [r for r in new if len(r) > self.longest]

    def encode(self, texts: list[str] | pa.StringArray) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string())
        other = pc.or_(pc.match_substring_regex(texts, _OTHER_SPACE), pc.greater(pc.binary_length(texts), self.longest_text))
        for content in self.contents:
            other = pc.or_(other, pc.match_substring(texts, content))
        out = np.empty(len(texts), dtype=object)
        for which, own in ((pc.invert(other), self._by_words), (other, lambda x: self._by_slices(x.to_pylist()))):
            if len(some := texts.filter(which)):
                out[which.to_numpy(zero_copy_only=False)] = own(some)
        return out.tolist()

    def _by_words(self, texts: pa.Array) -> list[bytes]:
        """Ids of texts whose spaces are all boundaries."""
        split = pc.split_pattern(texts, " ")
        words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
        # only a text's first word can be empty, and no space stands before it: first words are encoded by themselves
        distinct = pc.if_else(pc.equal(words.dictionary, ""), "a", words.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), pa.scalar(" ", distinct.type))[0].as_py()
        runs = _RUNS.findall(" " + joined)
        starts = [k for k, r in enumerate(runs) if r[0] == " "]
        if len(starts) == len(distinct):
            raw = self._ids([runs])[0]
            ends = np.cumsum([0, *map(len, raw)])[[*starts, len(raw)]]
        else:  # what Arrow and Python call a letter differs
            raw = self._by_slices([" " + w for w in distinct.to_pylist()])
            ends = np.cumsum([0, *map(len, raw)])
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(distinct), [None, pa.py_buffer(ends.astype("<i8")), pa.py_buffer(b"".join(raw))])
        taken = own.take(words.indices)
        at, data = np.frombuffer(taken.buffers()[1], dtype="<i8"), memoryview(taken.buffers()[2] or b"")
        first = self._by_slices(words.take(pa.array(bounds[:-1])).cast(pa.large_string()).to_pylist())
        return [f + data[a:b] for f, a, b in zip(first, at[bounds[:-1] + 1].tolist(), at[bounds[1:]].tolist())]

    def _by_slices(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        chars = 0
        for i, text in enumerate(texts):
            for part, whole in self._parts(text):
                held.append((i, [part] if whole else _RUNS.findall(part)))
                chars += len(part)
                if chars >= self.slice_chars:
                    self._flush(held, out)
                    chars = 0
        self._flush(held, out)
        return [b"".join(x) for x in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        for (i, _), raw in zip(held, self._ids([runs for _, runs in held])):
            out[i].append(b"".join(raw))
        held.clear()

    def _ids(self, held: list[list[str]]) -> list[list[bytes]]:
        """The ids of each run of some lists of runs."""
        new: set[str] = set()
        for runs in held:
            new.update(filterfalse(self.memo.__contains__, runs))
        known = [r for r in new if r in self.old]
        self.memo.update(zip(known, map(self.old.__getitem__, known)))
        long = self._learn(new.difference(known))
        out = [list(map(self.memo.__getitem__, runs)) for runs in held]
        if len(self.memo) >= self.most:
            self.memo, self.old = {}, self.memo
        for r in long:
            self.memo.pop(r, None)
            self.old.pop(r, None)
        return out

    def rest(self) -> None:
        """Keeps one generation, for the next task."""
        self.memo, self.old = {}, max(self.memo, self.old, key=len)


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own if it can be seen, else one from 256 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    # a task has one core; the library's threads would only contend with those of other tasks
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def cut_lengths(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole up to capacity, else the first piece takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenize(batches: Iterator[pa.RecordBatch], *, path: str, end_id: int, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
    for batch in batches:
        # texts that come to about as many bytes as one may have to go by words
        bytes_at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = np.flatnonzero(np.diff(bytes_at // own.longest_text)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            out: list[list] = [[] for _ in names]
            part = batch.slice(a, b - a)
            for doc_id, ids in zip(part.column(0).to_pylist(), own.encode(part.column(1))):
                ids += end
                for piece, (start, length) in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    raw = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(raw), raw)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
        trim()
    # the worker may wait for tasks of other stages with what is left here
    own.rest()
    gc.collect()
    trim()


def tokenize(docs: DataFrame, path: str, *, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids_crc32[, ids]), by the tokenizer file at path.

    Null and empty texts are the end token alone; texts of any length are encoded whole, with or without white space.
    Null and repeated doc_ids are documents of their own. ids is little-endian unsigned 32-bit.
    """
    ship_package(docs.sparkSession)
    f = partial(_tokenize, path=path, end_id=end_id, capacity=capacity, keep_ids=keep_ids)
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(f, _PIECES + ", ids binary" * keep_ids)


def best_fit(loads: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: lists of item numbers. Open bins stand in stacks by room left; a bit set finds the tightest."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    bits = 0
    for i in np.argsort(-loads, kind="stable").tolist():
        size = int(loads[i])
        fitting = bits >> size
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + size
            b = stacks[room].pop()
            if not stacks[room]:
                bits &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        if left:
            stacks[left].append(b)
            bits |= 1 << left
    return bins


def _pack_block(loads: np.ndarray, members: list[list[dict]], capacity: int, slack: int, last: bool) -> pd.DataFrame:
    rows = []
    for b in best_fit(loads, capacity):
        load, merged = 0, []
        for i in b:
            for m in members[i]:
                merged.append({**m, "offset": m["offset"] + load})
            load += int(loads[i])
        rows.append((load, last or load >= capacity - slack, merged))
    return pd.DataFrame(rows, columns=["load", "done", "members"])


def _pack_pieces(frames: Iterator[pd.DataFrame], *, capacity: int, slack: int, block: int) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []

    def pack() -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        held.clear()
        pdf["offset"] = 0
        return _pack_block(pdf["length"].to_numpy(), [[m] for m in pdf.to_dict("records")], capacity, slack, False)

    for pdf in frames:
        for at in range(0, len(pdf), block):
            held.append(pdf.iloc[at : at + block])
            if sum(map(len, held)) >= block:
                yield pack()
    if held and sum(map(len, held)):
        yield pack()


def _bins_packer(capacity: int, slack: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(pdf["load"].to_numpy(), pdf["members"].tolist(), capacity, slack, last)

    return run


def pack(pieces: DataFrame, *, capacity: int = 2048, slack: int = 8, block: int = 20_000) -> DataFrame:
    """pieces (the columns of tokenize) to one row per piece with sequence_id and offset.

    Pieces longer than capacity are refused. Repeated rows are pieces of their own; an empty
    table gives an empty one. Sequences of a piece's ids stand gapless from offset 0.
    """
    ship_package(pieces.sparkSession)
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32")
    pieces = pieces.withColumn("length", F.when(F.col("length") <= capacity, F.col("length")).otherwise(F.raise_error(F.lit("a piece is longer than a sequence")).cast("long")))
    full = pieces.filter(F.col("length") == capacity).select(F.lit(capacity).alias("load"), F.lit(True).alias("done"), F.array(F.struct(*pieces.columns, F.lit(0).cast("long").alias("offset"))).cast(f"array<{MEMBER}>").alias("members"))
    rest = pieces.filter(F.col("length") < capacity)
    bins = cut(rest.mapInPandas(partial(_pack_pieces, capacity=capacity, slack=slack, block=block), _BINS))
    emitted = [full, bins.filter("done")]
    under, before = bins.filter("not done"), None
    while True:
        n = under.count()
        groups = -(-n // block)
        if n == 0:
            break
        # the checkpoint fixes partitions, so this numbering is the same in every attempt
        dealt = under.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
        last = groups == 1 or before is not None and n >= before
        bins = cut(dealt.groupBy("group").applyInPandas(_bins_packer(capacity, slack, last), _BINS))
        emitted.append(bins.filter("done"))
        under, before = bins.filter("not done"), n
        if last:
            break
    every = emitted[0]
    for e in emitted[1:]:
        every = every.unionByName(e)
    # numbered before the explosion: in one select the number would be one of the exploded rows
    numbered = every.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode("members").alias("m"))
    return numbered.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def packing_query(docs: DataFrame, path: str) -> DataFrame:
    """One row per piece of every row of docs. Null texts are empty ones, a null doc_id stays null, repeated rows are
    packed each by itself, an empty table gives an empty one; only doc_id and text are read."""
    return pack(cut(tokenize(docs, path)))
