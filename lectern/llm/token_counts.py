"""Token counts: a Viterbi pass that carries best score and piece count only, over matches of an Aho-Corasick automaton."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import Memory, pieces

SPACE = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
CHUNK_CACHE = 100_000


class UnigramCounter:
    """Counts the pieces of the best segmentation under a model file's pieces and scores.

    The text is that piece vocabulary's usual one: a space mark before the text,
    and one for each space. Rules for ties and unknowns are those of the
    unigram tokenizers: candidates for an end are tried from the longest piece
    on and only a strictly better score replaces one; a character without a piece
    of its own may be unknown, at ``UNKNOWN_PENALTY`` below the lowest score, and
    counts as many pieces as it has bytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in own}
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p in scores if len(p) == 1)
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        # no piece has a space mark behind another character, so none crosses from one chunk into the next
        assert not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.newline = any("\n" in p for p in scores)
        self.chunks = re.compile(f"{SPACE}+[^{SPACE}]*" if self.newline else f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+").findall
        self.known = Memory(self.count_chunk, CHUNK_CACHE).__getitem__

    def count_chunk(self, chunk: str) -> int:
        n = len(chunk)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        done = 0  # ends up to here have had their unknown candidate

        def settle(upto: int) -> None:
            for i in range(done + 1, upto + 1):
                if chunk[i - 1] not in self.single:
                    score = best[i - 1] + self.unknown
                    if best[i] is None or score > best[i]:
                        best[i], count[i] = score, count[i - 1] + len(chunk[i - 1].encode())

        for end, (length, piece_score) in self.automaton.iter(chunk):
            if end > done:
                settle(end)
                done = end
            i = end + 1
            score = best[i - length] + piece_score
            if best[i] is None or score > best[i]:
                best[i], count[i] = score, count[i - length] + 1
        settle(n)
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.known, self.chunks(marked))) + (0 if self.newline else marked.count("\n"))


_LOADED: dict[str, UnigramCounter] = {}


def loaded(path: str) -> UnigramCounter:
    if path not in _LOADED:
        _LOADED[path] = UnigramCounter(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``n_tokens`` long, of the whole text.

    Null counts as empty; empty text has 0 tokens. Repeated rows are counted
    each; an empty table gives an empty result; further columns of ``docs`` are
    ignored. Nothing is shuffled. Each worker loads the file at ``path`` once.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch, texts in pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([counter.count(t) for t in texts], type=pa.int64())], schema=schema)

    return rows.mapInArrow(run, "_id bigint, n_tokens bigint").withColumnRenamed("_id", id_col)
