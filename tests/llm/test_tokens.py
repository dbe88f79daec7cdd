from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from llm_helpers import EDGES, documents  # noqa: F401
from tokenizers import Tokenizer

from tallymark.llm import counts, huffman, packing, tokens
from tallymark.llm.queries import BYTE_VOCABULARY, WORD_VOCABULARY
from tallymark.llm.tokens import tokenizer_path

PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "Word", "é", "ñ", "'s", "'", "’", "...", ",", "!?",
         "$%", "#*", "1", "23", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "\xa0", "\x1c",
         "\u2003", "\u0301", "\u0338", "Σ", "İ", "日本", "😀", "_", "(", "<", "=", "don't", "\x00"]


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_encoder_equals_the_library(name, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 500)
    texts = random_texts(4000)
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = tokens.Encoder(tokenizer_path(name)).many(texts)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids] == want
    assert tokens.Encoder(tokenizer_path(name), True).many(texts) == [len(w) for w in want]
    long = "".join(texts)
    pieces = list(tokens.safe_pieces(long, 50))
    assert "".join(pieces) == long and len(pieces) > 100
    assert sum((e.ids for e in library.encode_batch(pieces, add_special_tokens=False)), []) == \
        library.encode(long, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [BYTE_VOCABULARY, WORD_VOCABULARY])
def test_words_at_single_spaces(name):
    rng = random.Random(8)
    parts = ["word", "Wörter.", "don't", "", "a\nb", "\n", "x" * 60, "1,2", "\u0301", "=", "日本", "!"]
    parts += ["é.", "×.", "÷,", "a.b", "ÿ!É"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    library = Tokenizer.from_file(tokenizer_path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    made = tokens.Encoder(tokenizer_path(name))
    assert made.cuts and made.prepared
    for at in range(0, 2000, 100):  # words come back
        got = made.many(texts[at:at + 100])
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want[at:at + 100]


def test_a_vocabulary_that_merges_across_spaces_is_used_whole(tmp_path, monkeypatch):
    library = Tokenizer.from_file(tokenizer_path(BYTE_VOCABULARY))
    library.pre_tokenizer = None  # the model then sees a text as one word
    library.save(str(tmp_path / "other.json"))
    texts = random_texts(200, 9) + ["one two  three " * 50]
    made = tokens.Encoder(str(tmp_path / "other.json"))
    assert not made.cuts
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)
    assert [np.frombuffer(x, "<u2").tolist() for x in made.many(texts)] == want


def library_ids(rows, name, end):
    library = Tokenizer.from_file(tokenizer_path(name))
    return [library.encode(t or "", add_special_tokens=False).ids + end for _, t in rows]


ROWS = [*EDGES, *((100 + i, t) for i, t in enumerate(random_texts(60, 2)))]


def test_counts(documents):
    got = counts.count_tokens(documents(ROWS), tokenizer_path(BYTE_VOCABULARY), limit=20).collect()
    want = [(d, len((t or "").encode()), len(i), len(i) > 20)
            for (d, t), i in zip(ROWS, library_ids(ROWS, BYTE_VOCABULARY, []))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert counts.count_tokens(documents([]), tokenizer_path(BYTE_VOCABULARY)).count() == 0


def test_token_files_round_trip(documents, monkeypatch):
    monkeypatch.setattr(huffman, "FILE_IDS", 5_000)
    monkeypatch.setattr(huffman, "TASK_IDS", 20_000)
    files = huffman.write_tokens(documents(ROWS), tokenizer_path(BYTE_VOCABULARY), end_id=0)
    assert files.select("part").distinct().count() < files.count()
    assert "lengths" not in files.columns
    got = huffman.read_tokens(files).collect()
    assert files.count() > 1
    ids = dict(enumerate(library_ids(ROWS, BYTE_VOCABULARY, [0])))
    want = sorted((ROWS[k][0] is not None, ROWS[k][0] or 0, v) for k, v in ids.items())
    rows = sorted(got, key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == [w[:2] for w in want]
    start = 0
    for r in rows:
        n = len(r["ids"]) // 4
        assert r["start"] == start
        start += n
    texts = sorted((repr(r["doc_id"]), np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in rows)
    assert texts == sorted((repr(ROWS[k][0]), v) for k, v in ids.items())


def test_ids_are_written_to_one_file_a_task(spark, documents, monkeypatch, tmp_path):
    """Each open writer, dictionary and large array of rows is memory of the executor."""
    key, folder = "spark.sql.parquet.columnarReaderBatchSize", str(tmp_path / "ids")
    monkeypatch.setattr(huffman, "new_path", lambda spark, label: folder)
    before = spark.conf.get(key)
    ids, n = huffman.encoded(documents(ROWS), tokenizer_path(BYTE_VOCABULARY), 0, "doc_id", "text")
    files = list((tmp_path / "ids").rglob("*.parquet"))
    assert len(files) == 3  # the tasks
    for file in files:
        group = pq.read_metadata(file).row_group(0)
        assert not any(group.column(i).has_dictionary_page for i in range(group.num_columns))
    assert spark.conf.get(key) == before
    want = library_ids(ROWS, BYTE_VOCABULARY, [0])
    got = ids.collect()
    assert ids.columns == ["doc_id", "row", "ids"] and len({r["row"] for r in got}) == len(ROWS)
    assert sorted((repr(r["doc_id"]), np.frombuffer(bytes(r["ids"]), "<u2").tolist())
                  for r in got) == sorted((repr(d), v) for (d, _), v in zip(ROWS, want))
    assert n.tolist() == np.bincount(np.concatenate(want), minlength=len(n)).tolist()


def test_token_files_of_nothing(documents):
    files = huffman.write_tokens(documents([]), tokenizer_path(BYTE_VOCABULARY), end_id=0)
    assert huffman.read_tokens(files).collect() == []


@pytest.mark.parametrize("counts_of", [[5], [1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512],
                                       [0, 3, 0, 3, 7], list(range(1, 300))])
def test_code_lengths_and_blocks(counts_of):
    n = np.array(counts_of)
    lengths = huffman.code_lengths(n, longest=9)
    used = lengths[n > 0].astype(int)
    assert (lengths[n == 0] == 0).all() and used.max() <= 9
    assert sum(2.0 ** -x for x in used) <= 1
    code = huffman.Code(lengths)
    ids = np.random.default_rng(0).permutation(np.repeat(np.arange(len(n)), n))
    for size in {1, min(7, len(ids)), len(ids) // 2, len(ids)} - {0}:
        points, bits = code.encode(ids[:size], 4)
        assert code.decode(bits, points, size, 4).tolist() == ids[:size].tolist()


def test_code_lengths_are_the_best():
    """Against the least total over all ways to give three to five symbols lengths up to 3."""
    from itertools import product
    rng = np.random.default_rng(3)
    for size in (3, 4, 5):
        for _ in range(10):
            n = rng.integers(1, 50, size)
            best = min(sum(n * np.array(x)) for x in product((1, 2, 3), repeat=size)
                       if sum(2.0 ** -y for y in x) <= 1)
            assert (n * huffman.code_lengths(n, longest=3)).sum() == best


def slow_sum_of_squares(lengths, capacity):
    """The rule as stated: try every gap and a new bin, count all squares anew."""
    gaps, number = [], {}
    bins = {}
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        choices = []
        for gap in sorted({g for g in gaps if g >= lengths[i]}) + [capacity]:
            after = list(gaps)
            if gap in gaps:
                after.remove(gap)
            after.append(gap - lengths[i])
            count = {g: after.count(g) for g in set(after) if 0 < g < capacity}
            choices.append((sum(c * c for c in count.values()), gap))
        gap = min(choices)[1]
        if gap in gaps:
            gaps.remove(gap)
        gaps.append(gap - lengths[i])
        bins[i] = gap
        number[i] = capacity - gap
    return number, len([1 for i in bins if bins[i] == capacity])


def test_sum_of_squares_follows_the_rule():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 21, rng.integers(1, 60))
        bins, at = packing.sum_of_squares(lengths, 20)
        number, used = slow_sum_of_squares(lengths.tolist(), 20)
        assert bins.max() + 1 == used
        assert at.tolist() == [number[i] for i in range(len(lengths))]
    assert len(packing.sum_of_squares(np.zeros(0, np.int64), 20)[0]) == 0


def test_packing(documents, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 16)
    path = tokenizer_path(WORD_VOCABULARY)
    got = packing.pack(documents(ROWS), path, end_id=1, capacity=64).collect()
    want = []
    for (d, _), ids in zip(ROWS, library_ids(ROWS, WORD_VOCABULARY, [1])):
        want += [(repr(d), k, at, ids[at:at + 64]) for k, at in enumerate(range(0, len(ids), 64))]
    rows = [(repr(r["doc_id"]), r["piece"], r["start"],
             np.frombuffer(bytes(r["ids"]), "<u2").tolist()) for r in got]
    assert sorted(rows) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(len(w[3]) for w in want)
    assert len(sequences) <= 1.1 * total / 64 + 3
    assert packing.pack(documents([]), path, end_id=1).count() == 0
