import random
import time

import public_tokenizers
import sentencepiece

from lingmill.llm import token_counts as token_counts_module
from lingmill.llm.token_counts import count_spliced, load, token_counts, token_starts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string"


def texts():
    r = random.Random(1)
    bits = ["the ", "  ", "abc", "é", "\n", "▁", "ﬁ", "x" * 70, "漢字", " a", "😀 ", "<s>", "</s>", "<unk>", "Straße "]
    return ["".join(r.choices(bits, k=r.randint(1, 400))) for _ in range(150)]


def test_spliced_counts_equal_whole_ones():
    p, stable = load(MODEL)
    assert stable
    for text in [*texts(), "x" * 3000, " " * 3000, ("y" * 900 + " ") * 4]:
        assert count_spliced(p, text, 60, 10) == len(p.encode(text))


def test_query(spark):
    rows = list(enumerate(texts())) + [(1, None), (2, ""), (None, "null id"), (3, "long text, " * 30000), (3, "long text, " * 30000), (4, "x" * 100_000), (5, " " * 100_000), (6, "漢" * 50_000)]
    p = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = token_counts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), MODEL, huge=5000, chunk=2000, overlap=100).collect()
    want = [(i, len((t or "").encode()), len(p.encode(t or ""))) for i, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in out), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in out)


def test_defaults_splice(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choices(["the ", "  ", "abc", "é", "\n", "漢字", " a", "😀 ", "Straße "], k=9000))) for i in range(6)]
    p, stable = load(MODEL)
    assert stable and all(len(t) > 8192 for _, t in rows) and all(count_spliced(p, t, 4096, 128) == len(p.encode(t)) for _, t in rows)
    out = token_counts(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), MODEL).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(p.encode(t)) for i, t in rows}


def test_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_long_run_then_words_is_linear():
    """A stretch without spaces is encoded once, however many chunks it is long."""
    p, _ = load(MODEL)
    for text in ("q7" * 500_000 + " some words" * 20_000, "漢字" * 100_000 + " a b" * 9_000, " " * 300_000 + "x" + " y" * 50_000):
        began = time.perf_counter()
        want = len(p.encode(text, return_type="numpy"))
        whole = time.perf_counter() - began
        began = time.perf_counter()
        assert count_spliced(p, text, 4096, 128) == want
        assert time.perf_counter() - began < 2 * whole + 0.5


def test_an_alignment_that_fails_widens(monkeypatch):
    """Tokens that hide some boundaries: chunks are widened to later ones and counts stay whole."""
    p, _ = load(MODEL)
    plain, calls = token_counts_module.token_starts, []

    def hiding(processor, text):
        calls.append(text)
        # two words, the second of which starts with q, are one token
        found = plain(processor, text)
        return found[[text[b : b + 2] != " q" for b in found]]

    text = " ".join(["word", "q", "other"] * 400)
    want = len(hiding(p, text))
    calls.clear()
    monkeypatch.setattr(token_counts_module, "token_starts", hiding)
    assert count_spliced(p, text, 50, 10) == want and len(calls) > 10


def test_starts_equal_the_library_s_offsets():
    p, _ = load(MODEL)
    for text in [*texts(), " ", "x", "a▁b ▁▁ c", "<s>x</s>", "\u0000\x07é"]:
        assert token_starts(p, text).tolist() == [b for b, _ in p.encode(text, return_type="offset_mapping")["offsets"]]
