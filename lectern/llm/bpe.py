"""BPE by dynamic programming over prefixes: each prefix of a word has one last token, found by automaton matches and pair tests."""

from __future__ import annotations

import json
import math
import os
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import Memory, pieces

#: Words and token pairs that a worker remembers at most; past that it starts anew.
WORD_CACHE, PAIR_CACHE = 100_000, 250_000


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A tokenizers file of kind BPE with word ends: NFC, lower case, split by pattern, bytes as letters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = np.full(max(named) + 1, None, dtype=object)
        self.tokens[list(named)] = list(named.values())
        self.ranks: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            made = vocab[a + b]
            self.ranks[vocab[a], vocab[b]] = rank
            self.parts.setdefault(made, (vocab[a], vocab[b], rank))
        # one letter for each byte, and one for each byte that ends a word
        self.letters = byte_letters()
        self.ends = [chr(0xF0000 + b) for b in range(256)]
        units: dict[int, str] = {}
        for b, c in enumerate(self.letters):
            for text, unit in ((c, c), (c + self.suffix, self.ends[b])):
                if text in vocab and vocab[text] not in self.parts:
                    units[vocab[text]] = unit
        for made, (a, b, _) in sorted(self.parts.items(), key=lambda x: x[1][2]):
            units[made] = units[a] + units[b]
        self.automaton = ahocorasick.Automaton()
        for i, u in units.items():
            self.automaton.add_word(u, (len(u), i))
        self.automaton.make_automaton()
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.words = Memory(self.word, WORD_CACHE).__getitem__
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.split_ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None
        #: What every special token starts with: a quick test for texts without any.
        self.mark = os.path.commonprefix(list(self.special))

    def spine(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The symbols that stand at a token's right (or left) edge while it is built, each with the rank of the merge that takes it up."""
        known = self.spines[right]
        if token not in known:
            out, taken, x = [], math.inf, token
            while True:
                out.append((x, taken))
                if x not in self.parts:
                    break
                a, b, taken = self.parts[x]
                x = b if right else a
            known[token] = out
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a: no merge across their border comes before those that build the two.

        At equal rank the leftmost merge is first: a's own goes before one across the border, and that before b's own.
        """
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            ranks, left = self.ranks, self.spine(b, False)
            found = True
            for x, x_end in self.spine(a, True):
                for y, y_end in left:
                    r = ranks.get((x, y))
                    if r is not None and r < x_end and r <= y_end:
                        found = False
                        break
                if not found:
                    break
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def encode_units(self, units: str) -> list[int]:
        """Ids of one word: the last token of each prefix, then back along them."""
        none, start = -1, -2
        last: list[int] = [none] * (len(units) + 1)
        last[0] = start
        back = [0] * (len(units) + 1)
        known, fits = self.pairs, self.fits
        for end, (length, token) in self.automaton.iter(units):
            i = end + 1
            if last[i] == none:
                j = i - length
                before = last[j]
                if before >= 0:
                    found = known.get(before << 32 | token)
                    if found or (found is None and fits(before, token)):
                        last[i], back[i] = token, j
                elif before == start:
                    last[i] = token
        ids, i = [], len(units)
        while i:
            if last[i] < 0:
                raise ValueError(f"no encoding of {units!r}")
            ids.append(last[i])
            i = back[i]
        return ids[::-1]

    def word(self, word: str) -> bytes:
        """Ids of one word as little-endian int32."""
        data = word.encode()
        ids = self.encode_units("".join([self.letters[b] for b in data[:-1]]) + self.ends[data[-1]])
        return np.array(ids, dtype="<i4").tobytes()

    def plain(self, text: str) -> Iterator[bytes]:
        if text.isascii():
            return map(self.words, self.split_ascii(text.lower()))
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # character by character: no final sigma
        return map(self.words, self.split(text.replace("Σ", "σ").lower()))

    def encode(self, text: str) -> np.ndarray:
        if self.cut and self.mark in text:
            out = []
            for k, part in enumerate(self.cut(text)):
                out += [np.array([self.special[part]], dtype="<i4").tobytes()] if k % 2 else self.plain(part)
        else:
            out = self.plain(text)
        return np.frombuffer(b"".join(out), dtype="<i4")

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """What the file asks for, which names no decoder: tokens with a space between, special ones too."""
        return " ".join(self.tokens[ids].tolist())


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``ids`` array<int> and, if asked for, ``decoded``, which is made from the ids.

    Whole texts; null counts as empty, and an empty text has no ids and decodes
    to an empty string. Repeated rows are encoded each; an empty table gives an
    empty result; further columns of ``docs`` are ignored. Nothing is shuffled.
    Each worker loads the file at ``path``, which must be there on every machine, once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    fields = [pa.field("_id", pa.int64()), pa.field("ids", pa.list_(pa.int32()))] + [pa.field("decoded", pa.string())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch, texts in pieces(batches, "_text"):
            ids = [bpe.encode(t) for t in texts]
            offsets = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype="<i4")
            columns = [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))]
            if decode:
                columns.append(pa.array([bpe.decode(x) for x in ids], type=pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = "_id bigint, ids array<int>" + ", decoded string" * decode
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
