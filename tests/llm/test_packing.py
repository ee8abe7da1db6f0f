import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lingmill.llm.packing import BOUNDARY, Encoder, best_fit, cut_lengths, pack, packing_query, tokenize

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, piece string, length int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def nasty():
    r = random.Random(2)
    bits = ["the ", "  ", "\n\n", "é", "日本", "<|endoftext|>", "'ll", "12345", "\t", "x" * 300, "😀", "\x00", "​", "ﬁ", "Hello, world! ", "\r\n", "　"]
    return ["".join(r.choices(bits, k=r.randint(0, 60))) for _ in range(200)] + ["", " ", "<|endoftext|>", " <|endoftext|> ", "a" * 5000]


def same(own, library, texts):
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    return own.encode(texts) == want


def test_ids_equal_the_library(library):
    assert same(Encoder(PATH), library, nasty())
    # a memo that is always full, and slices of a few characters
    small = Encoder(PATH, memo=3, longest=6, slice_chars=7, lines=2)
    assert same(small, library, nasty()) and same(small, library, nasty()[::-1])


def test_boundaries_hold_beside_every_character(library):
    """No character next to a boundary, or within a run, makes the library's pre-tokens cross it."""
    own = Encoder(PATH)
    assert own.line_end is not None
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xA100), 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF, 0x1C80, 0x2028, 0x2029, 0x3000]]
    assert same(own, library, [f"a{c} b {c}d 1{c} c{c}e f{c} .{c} {c}" for c in points])


def test_signs_and_line_ends_make_no_new_runs(library):
    """A word is asked of the library once, whatever stands after it: before, each of these pairs was a run of its own."""
    words, after = [f"{a}{b}é" for a in "bcdfghjklm" for b in "aeiou"], [".", ",", "!?", ".\n", "\n", "'s", ' "', "&&&", " 12", ")"]
    text = " " + " ".join(w + x for w in words for x in after)
    own = Encoder(PATH)
    assert same(own, library, [text, text[::-1]])
    own = Encoder(PATH)
    own.encode([text])
    assert len(own.memo) <= 2 * len(words) + len(after) + 10


def test_words_of_texts_given_at_once_are_looked_up_once(library):
    """Before, each of these words was cut and looked up again wherever it stood."""

    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    own, texts = Encoder(PATH), [" ".join(["Some", "words,", "again", "(and", "été)."] * 2000), " at first", "", " ", "12 monkeys' 'll"]
    own.memo = memo = Counted()
    assert same(own, library, texts)
    assert memo.asked <= 40


def test_texts_by_words_and_whole_equal_the_library(library):
    """Spaces beside what Arrow, Python and the library may take for a letter, a sign or white space; texts over the limit go whole."""
    r = random.Random(8)
    bits = ["a", "é", "1", "_", "'s", "¿", "—", "日", "½", "\u0301", "\u200b", "\x1c", "\x85", "\xa0", "😀", "\U00010d4a", "\ua7cb", "\n", "\t", "<|endoftext|>"]
    texts = [" ".join("".join(r.choices(bits[: r.randint(5, len(bits))], k=r.randint(1, 3))) for _ in range(r.randint(1, 12))) for _ in range(5000)]
    assert same(Encoder(PATH), library, texts) and same(Encoder(PATH, longest_text=20), library, texts)


def test_runs_of_mixed_characters_equal_the_library(library):
    r = random.Random(5)
    bits = [*"aZ9'.,-(<|> \n\t\r\x00\x1c\x1f\x7f\x85\xa0\xb5\xaa\xb2éÿ×š٣日\u0301\u200b\u2028😀", "  ", "\n\n", "'s", "'LL", " 're", "<|endoftext|>", "word", " word", "12", "__", "n't"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(20_000)]
    assert same(Encoder(PATH), library, texts)
    assert same(Encoder(PATH, memo=50, longest=6, slice_chars=11, lines=3), library, texts[:4000])


def test_very_long_texts(library):
    own = Encoder(PATH)
    assert same(own, library, ["x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a" * 2_000_000, "a \n" * 700_000, "some words " * 200_000])
    assert BOUNDARY.search("a  b") is None and BOUNDARY.search("a b").start() == 1


def test_cuts():
    assert cut_lengths(5, 8) == [(0, 5)] and cut_lengths(8, 8) == [(0, 8)]
    assert cut_lengths(9, 8) == [(0, 1), (1, 8)] and cut_lengths(16, 8) == [(0, 8), (8, 8)]


def test_best_fit_keeps_capacity_and_is_near_the_bound():
    loads = np.random.default_rng(0).integers(1, 800, 3000)
    bins = best_fit(loads, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(loads[b].sum() <= 2048 for b in bins) and len(bins) <= -(-loads.sum() // 2048) + 2


def check(rows, library, out):
    want = {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, (start, length) in enumerate(cut_lengths(len(ids), 2048)):
            key = (doc_id, piece, start, length, zlib.crc32(np.array(ids[start : start + length], dtype="<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in out:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return by


def test_round_trip(spark, library):
    rows = list(enumerate(nasty())) + [(7, "again"), (7, "again"), (None, None), (300, "word " * 9000), (301, "x" + " " * 1_200_000 + "y")]
    out = packing_query(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), PATH).collect()
    by = check(rows, library, out)
    assert len(by) <= -(-sum(r.length for r in out) // 2048) + 1


def test_rounds_merge_across_partitions(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "0 as piece", "0L as start", "(id * 37) % 600 + 20 as length", "1L as ids_crc32").repartition(16)
    out = pack(df, block=200).collect()
    assert len(out) == 4000 and len({r.sequence_id for r in out}) <= 1.02 * sum(r.length for r in out) / 2048


def test_empty_table_and_kept_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing_query(empty, PATH).collect() == []
    ids = tokenize(spark.createDataFrame([(1, "a b", "", 0)], SCHEMA), PATH, keep_ids=True).first().ids
    assert np.frombuffer(ids, dtype="<u4")[-1] == 0
