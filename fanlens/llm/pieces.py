"""SentencePiece encoding and decoding by a distinct-chunk table.

No piece of the model crosses from a letter to a whitespace marker, so a marked
text falls into words ``▁+[^▁]*`` that are segmented independently.  Each task
keeps a table of the distinct marked words it has met; a word is segmented by
the library once, and a text's ids are the table's entries joined by position.
The decoded text is joined from the same table.

The table belongs to a task: one table for all rows would have to shuffle every
word occurrence.  It is emptied when it reaches ``TABLE_WORDS`` entries or
``TABLE_CHARS`` characters, which bounds its memory and changes no result; new
words of about ``BATCH_CHARS`` characters of text are segmented in one call.

Defined cases: a null text is encoded as an empty one (begin and end ids only);
whole texts are encoded however long; repeated rows are encoded alike; other
columns pass through, ``ids`` and ``decoded`` replace columns of those names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanlens.llm.common import bounded_batches, free_name

MARK = "▁"
TABLE_WORDS, TABLE_CHARS = 50_000, 4_000_000
BATCH_CHARS = 256_000


def crosses_marker(model) -> bool:
    """Whether some piece of the model has a marker after another character."""
    return any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))


class ChunkTable:
    """Ids and decoded text of each distinct marked word met so far."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if crosses_marker(self.model):
            raise ValueError("the model has pieces that cross whitespace markers")
        self.lone = [self.model.piece_to_id(MARK)]
        self.begin, self.end = (array("I", [i]).tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        self.table: dict[str, tuple[bytes, str]] = {}
        self.chars = 0

    def _learn(self, words: list[str]) -> None:
        # the library puts a marker before what it encodes: the word's first one
        found = [ids or self.lone for ids in self.model.encode(words, num_threads=1)]
        texts = self.model.decode(found, num_threads=1)
        self.table.update((w, (array("I", ids).tobytes(), " " + x)) for w, ids, x in zip(words, found, texts, strict=True))
        self.chars += 2 * sum(map(len, words)) + 4 * sum(map(len, found))

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids with begin and end ids (little-endian, 32 bits each) and its decoded text."""
        cut = [chunks(x) if x else [] for x in texts]
        distinct = set().union(*cut)
        new = distinct.difference(self.table)
        if len(self.table) + len(new) > TABLE_WORDS or self.chars > TABLE_CHARS:
            self.table, self.chars, new = {}, 0, distinct
        if new:
            self._learn(list(new))
        out = []
        for words in cut:
            found = [self.table[w] for w in words]
            out.append((self.begin + b"".join([x[0] for x in found]) + self.end, "".join([x[1] for x in found])[1:]))
        return out


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker.

    A marked word is a run of markers and what follows it."""
    words = text.split(" ")
    if "" not in words and MARK not in text:
        return words
    return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]


def batches(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of about ``BATCH_CHARS`` characters."""
    held, chars = [], 0
    for x in texts:
        held.append(x)
        chars += len(x or "")
        if chars >= BATCH_CHARS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", decode: bool = True) -> DataFrame:
    """``docs`` without ``text``, with ids (binary: little-endian unsigned 32-bit) and decoded (string)."""
    kept = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    source = free_name(docs, "source_text")
    fields = [docs.schema[c] for c in kept] + [T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.StringType())] if decode else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = ChunkTable(model_file)
        for pdf in frames:
            at = 0
            for texts in batches(pdf[source].tolist()):
                done = table.encode(texts)
                out = pdf[kept].iloc[at : at + len(texts)].assign(ids=[x[0] for x in done])
                yield out.assign(decoded=[x[1] for x in done]) if decode else out
                at += len(texts)

    return bounded_batches(docs).select(*kept, F.col(text).alias(source)).mapInPandas(run, T.StructType(fields))
