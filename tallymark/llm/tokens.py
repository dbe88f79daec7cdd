"""Token ids of whole texts by a public tokenizer, at the speed of its distinct words.

A batch of texts is cut into chunks over its array of bytes, and only the distinct chunks are
looked up; those not known are encoded and kept. The vocabularies whose settings are listed below
split a text before any white space that follows other characters, and between a letter and a
mark such as a full stop, so the ids of the chunks, one after another, are the ids of the text.
Texts that may hold a special string are not cut at marks. Texts with white space other than
space, tab, line feed and carriage return go to the tokenizer whole, and so does every text if a
vocabulary has other settings.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MARK = "<|"  # begins every special string
RARE_SPACE = re.compile(r"[^\S \t\n\r]")
BATCH_BYTES = 4_000_000
KEPT_CHUNKS = 300_000

# What a byte is to the cutting of texts: white space, an ASCII letter, or a mark.
SPACE, LETTER, CUT_BEFORE = 1, 2, 3
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t\n\r")] = SPACE
KIND[[b for b in range(128) if chr(b).isalpha()]] = LETTER
KIND[list(b".,;:!?$%#*")] = CUT_BEFORE

# How the vocabularies that may be cut split a text, by normaliser and pattern.
SPLITS = [(None, "ByteLevel regex"),
          ("NFC, Replace \\s+, Lowercase",
           r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")]

PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
SAMPLES = ["word", " word", "Word", " WORDS", " é", "Éß", " naïve", " Straße", "ÿþ", " x", "a",
           " internationalisation", "Qzxwvjk", " ÀÖØöøÿ"]

_encoders: dict = {}


def byte_table() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: the byte's own character
    if it is printable and no space, else the next free one from 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and b != 0x20]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_table()


def byte_letters(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def id_type(vocabulary: int) -> str:
    """Smallest little-endian unsigned type that holds every id."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def may_be_cut(tokenizer) -> bool:
    """Whether the settings of a tokenizer are such that ids of chunks are ids of the text."""
    made = json.loads(tokenizer.to_str())

    def steps(part, name):
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    normal = steps(made["normalizer"], "normalizers")
    split = steps(made["pre_tokenizer"], "pretokenizers")
    byte = [p for p in split if p["type"] == "ByteLevel" and not p["add_prefix_space"]]
    first = split[0] if split else {}
    if len(split) == 1 and byte and first.get("use_regex"):
        pattern = "ByteLevel regex"
    elif len(split) == 2 and byte == split[1:] and not split[1].get("use_regex") and \
            first["type"] == "Split" and (first["behavior"], first["invert"]) == ("Removed", True):
        pattern = first["pattern"].get("Regex")
    else:
        return False
    names = [n["type"] + (" " + n["pattern"].get("Regex", "") if n["type"] == "Replace" else "")
             for n in normal]
    plain_model = made["model"]["type"] == "BPE" and not made["model"].get("dropout")
    special = all(t["content"].startswith(MARK) and not (t["single_word"] or t["lstrip"] or t["rstrip"])
                  for t in made["added_tokens"])
    return plain_model and special and (", ".join(names) or None, pattern) in SPLITS


class Encoder:
    """Ids as packed bytes, or their number. Keeps at most twice KEPT_CHUNKS chunks."""

    def __init__(self, path: str, counts_only: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.code = "H" if self.dtype == "<u2" else "I"
        self.model = self.tokenizer.model
        self.cuts = may_be_cut(self.tokenizer)
        self.prepared = self.find_short_way() if self.cuts else None
        self.counts_only = counts_only
        self.recent: dict = {}
        self.older: dict = {}

    def find_short_way(self):
        """How a plain word reaches the library's model, which spares it the steps before: as
        its bytes, or lower-cased without the space. None if neither gives the library's ids."""
        ways = (byte_letters, lambda word: byte_letters(word.lstrip(" ").lower()))
        want = [e.ids for e in self.tokenizer.encode_batch(SAMPLES, add_special_tokens=False)]
        for way in ways:
            if [[t.id for t in self.model.tokenize(way(w))] for w in SAMPLES] == want:
                return way
        return None

    def raw(self, texts: list[str]) -> list:
        """One value per chunk, by the library."""
        if not self.prepared:
            return self.slow(texts)
        rest = [t for t in texts if not PLAIN.fullmatch(t)]
        others = iter(self.slow(rest))
        slow, tokenize, way, code = set(rest), self.model.tokenize, self.prepared, self.code
        if self.counts_only:
            return [next(others) if t in slow else len(tokenize(way(t))) for t in texts]
        return [next(others) if t in slow else array(code, [x.id for x in tokenize(way(t))]).tobytes()
                for t in texts]

    def slow(self, texts: list[str]) -> list:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if self.counts_only:
            return [len(e) for e in found]
        return [array(self.code, e.ids).tobytes() for e in found]

    def batch(self, texts: list[str]) -> list:
        """One value per text; meant for some BATCH_BYTES bytes at a time."""
        out: list = [None] * len(texts)
        whole, special, plain = [], [], []
        for i, text in enumerate(texts):
            (whole if not self.cuts or RARE_SPACE.search(text) else
             special if MARK in text else plain).append(i)
        for own, values in ((whole, self.raw([texts[i] for i in whole])),
                            (special, self.in_chunks([texts[i] for i in special], False)),
                            (plain, self.in_chunks([texts[i] for i in plain], True))):
            for i, value in zip(own, values):
                out[i] = value
        return out

    def in_chunks(self, texts: list[str], at_marks: bool) -> list:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(d) for d in data], np.int64)
        start = np.cumsum(size) - size
        joined = np.frombuffer(b"".join(data), np.uint8)
        if not len(joined):
            return [0 if self.counts_only else b""] * len(texts)
        cut = cuts_of(joined, at_marks)
        cut[start[size > 0]] = True
        at = np.flatnonzero(cut)
        chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(
            np.append(at, len(joined)).astype(np.int32)), pa.py_buffer(joined)]).dictionary_encode()
        number = chunks.indices.to_numpy()
        values = self.values_of(chunks.dictionary.to_numpy(zero_copy_only=False).tolist())
        first = np.append(np.searchsorted(at, start), len(at))  # the first chunk of each text
        if self.counts_only:
            total = np.append(0, np.cumsum(np.array(values, np.int64)[number]))
            return (total[first[1:]] - total[first[:-1]]).tolist()
        width = np.dtype(self.dtype).itemsize
        length = np.array([len(v) for v in values]) // width
        begin = (np.cumsum(length) - length)[number]
        length = length[number]
        end = np.cumsum(length)
        ids = np.frombuffer(b"".join(values), self.dtype)[
            np.repeat(begin - end + length, length) + np.arange(end[-1])]
        edge = np.append(0, end)[first].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edge, edge[1:])]

    def values_of(self, chunks: list[bytes]) -> list:
        """The values of distinct chunks; those that are not at hand are made, and kept."""
        values = list(map(self.recent.get, chunks))
        new = [c for c, v in zip(chunks, values) if v is None]
        if new:
            if len(self.recent) + len(new) > KEPT_CHUNKS:
                self.older, self.recent = self.recent, {}
            unknown = [c for c in new if c not in self.older]
            made = dict(zip(unknown, self.raw([c.decode("utf-8", "surrogatepass") for c in unknown])))
            made.update((c, self.older[c]) for c in new if c in self.older)
            self.recent.update(made)
            values = [made[c] if v is None else v for c, v in zip(chunks, values)]
        return values

    def many(self, texts: list[str]) -> list:
        """One value per text. Long texts are cut at safe places and short ones put together,
        so that every call encodes about the same number of bytes."""
        parts: list[list] = [[] for _ in texts]
        batch, owner, size = [], [], 0
        for number, text in enumerate(texts):
            for piece in safe_pieces(text) if self.cuts else [text]:
                if size + len(piece) > BATCH_BYTES and batch:
                    self.spread(batch, owner, parts)
                    batch, owner, size = [], [], 0
                batch.append(piece)
                owner.append(number)
                size += len(piece)
        self.spread(batch, owner, parts)
        join = sum if self.counts_only else b"".join
        return [p[0] if len(p) == 1 else join(p) for p in parts]

    def spread(self, batch: list[str], owner: list[int], parts: list[list]) -> None:
        for number, value in zip(owner, self.batch(batch)):
            parts[number].append(value)


def cuts_of(data: np.ndarray, at_marks: bool) -> np.ndarray:
    """Where a chunk of UTF-8 bytes begins: at white space after anything else, and at a mark
    after a letter from A to ÿ."""
    kind = KIND[data]
    space = kind == SPACE
    cut = np.zeros(len(data), bool)
    np.greater(space[1:], space[:-1], out=cut[1:])
    if at_marks:
        letter = kind == LETTER
        after = data[1:]  # À to ÿ are C3 and a byte from 80; × and ÷ are no letters
        letter[1:] |= (data[:-1] == 0xC3) & (after >= 0x80) & (after != 0x97) & (after != 0xB7)
        cut[1:] |= (kind[1:] == CUT_BEFORE) & letter[:-1]
    return cut


def safe_pieces(text: str, size: int = BATCH_BYTES // 4) -> Iterator[str]:
    """`text` in pieces of about `size` characters, cut only before a space or line feed
    that follows a character which is no white space. Texts without such places stay whole."""
    start = 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[start:cut]
        start = cut
    if start < len(text) or start == 0:
        yield text[start:]


def encoder(path: str, counts_only: bool = False) -> Encoder:
    """One encoder per Python worker and vocabulary, kept between tasks."""
    key = (path, counts_only)
    if key not in _encoders:
        _encoders[key] = Encoder(path, counts_only)
    return _encoders[key]
