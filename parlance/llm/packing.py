"""Documents packed into sequences by concatenating their tokens and cutting at fixed windows.

The first pass turns texts into token ids and notes, for every partition, how many tokens came
before a document within it. One total per partition, summed up, gives the partitions their
places in the concatenation of all documents; the second pass adds them and cuts each document
where a window of ``length`` tokens ends. A document that crosses such a boundary leaves one
record on either side. Nothing is shuffled, no sequence but the last one is short, and a
document of any length is only ever cut, never kept whole in one sequence.

Distinct words (runs between ASCII white space, without the stops after them, in lower case) are
encoded once per worker while its table of words has room: the vocabulary's own splitting rule
never reaches over white space or from a letter to a stop, and lower-cases everything.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm import blocks
from parlance.llm.store import public_id, stored, with_id

LENGTH = 4096
#: The id that closes a document.
END = 2
PAD = 0
#: Words that a worker remembers, of at most so many bytes each; others are encoded again.
KNOWN_WORDS = 1 << 19
WORD_BYTES = 64
#: Words encoded in one call, and bytes of text split at once.
CALL_WORDS = 1 << 14
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\t-\r ]")
#: Where the splitting rule always cuts: between an ASCII letter or digit and such a stop.
_STOP = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?])")
#: Letters that compose with nothing and have one lower case form each.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: What special tokens begin with; texts that have it keep their case.
_SPECIAL = b"<|"

CODED = "part int, before long, id long, n long, tokens binary"
PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tokens binary"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """A tokenizer with a bounded table from words to their ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.code = "H" if self.coder.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(self.code).newbyteorder("<")
        spelled = lambda c: self.coder.pre_tokenizer.pre_tokenize_str(self.coder.normalizer.normalize_str(c))[0][0]
        self.letters = {i: spelled(chr(i)) for i in range(256) if _LETTERS.fullmatch(chr(i))}
        self.known: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids of each word; one of plain letters is a single pre-token, so it goes to the model at once."""
        texts = [w.decode() for w in words]
        plain = [_LETTERS.fullmatch(t) is not None for t in texts]
        coded = iter(self.coder.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        model = self.coder.model
        for text, one in zip(texts, plain):
            ids = [t.id for t in model.tokenize(text.translate(self.letters))] if one else next(coded).ids
            yield array(self.code, ids).tobytes()

    def encode(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part, one after another; parts end at white space or at a text's end."""
        split = [(p if _SPECIAL in p else _STOP.sub(b" ", p).lower()).split() for p in parts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        new = list(set().union(*split).difference(self.known))
        for at in range(0, len(new), CALL_WORDS):
            some = new[at : at + CALL_WORDS]
            self.known.update(zip(some, self._ids(some)))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > WORD_BYTES:
                del self.known[word]
        return out


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def parts_of(texts: list[str | None]) -> Iterator[list[tuple[int, bytes]]]:
    """Rows and parts of their texts, about ``PART_BYTES`` at a time, cut at white space only."""
    held, size = [], 0
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        at = 0
        while at < len(raw):
            gap = _SPACE.search(raw, at + PART_BYTES - size)
            end = gap.start() if gap else len(raw)
            held.append((row, raw[at:end]))
            size += end - at
            at = end
            if size >= PART_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _code(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = _words(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            tokens = [[] for _ in range(len(batch))]
            for some in parts_of(batch.column("text").to_pylist()):
                for (row, _), ids in zip(some, words.encode([raw for _, raw in some])):
                    tokens[row].append(ids)
            close = np.array([end], words.kind).tobytes()
            tokens = [np.frombuffer(b"".join([*t, close]), words.kind) for t in tokens]
            sizes = np.array([len(t) for t in tokens], np.int64)
            places = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(sizes), part, np.int32)), pa.array(places), batch.column("id"), pa.array(sizes),
                 pa.array([t.tobytes() for t in tokens], pa.binary())],
                names=["part", "before", "id", "n", "tokens"],
            )

    return run


def cut(places: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first token within it and size of every piece of documents at ``places``."""
    first, last = places // length, (places + sizes - 1) // length
    each = last - first + 1
    row = np.repeat(np.arange(len(places)), each)
    window = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each) + first[row]
    start = np.maximum(window * length - places[row], 0)
    stop = np.minimum((window + 1) * length - places[row], sizes[row])
    return row, start, stop - start


def _cut(length: int, carry: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, sizes = (batch.column(c).to_numpy().astype(np.int64) for c in ("place", "n"))
            row, start, size = cut(places, sizes, length)
            data, limits = blocks.column(batch.column("tokens"))
            width = np.diff(limits)[row] // sizes[row]  # bytes of a stored id
            begin = limits[:-1][row] + start * width
            spans = zip(begin.tolist(), (begin + size * width).tolist(), width.tolist())
            tokens = [data[a:b].view(f"<u{w}").astype("<u4").tobytes() for a, b, w in spans]
            at = places[row] + start
            columns = [
                batch.column("id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array([zlib.crc32(t) for t in tokens], pa.int64()),
                pa.array(sizes[row]), pa.array(at // length), pa.array(at % length),
                pa.array(tokens, pa.binary()) if carry else pa.nulls(len(row), pa.binary()),
            ]
            yield pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END,
    vocabulary: str | None = None, carry: bool = True,
) -> DataFrame:
    """One row per piece: ``id_col``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``tokens`` (little-endian 32-bit ids; null unless ``carry``).

    Every row is a document of its own, equal rows and rows without an id too. A null or empty
    text is a document of the one closing id. Sequences are numbered along the concatenation;
    each but the last holds ``length`` tokens, and a document's pieces are neighbours. An empty
    table has no pieces. Other columns are ignored.
    """
    spark = df.sparkSession
    docs = with_id(df, id_col, text=text_col)
    coded = stored(docs.select("id", "text").mapInArrow(_code(vocabulary or vocabulary_path(), end), CODED), "packing")
    totals = sorted(coded.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one number per task
    offsets = list(accumulate((t.n for t in totals), initial=0))
    rows = [(t.part, offset) for t, offset in zip(totals, offsets)]
    parts = spark.createDataFrame(rows, "part int, offset long")
    placed = coded.join(F.broadcast(parts), "part").select("id", "n", "tokens", (F.col("before") + F.col("offset")).alias("place"))
    pieces = placed.mapInArrow(_cut(length, carry), PIECES)
    return pieces.select(public_id(id_col), *[c.split()[0] for c in PIECES.split(", ")[1:]])


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = PAD) -> DataFrame:
    """``sequence_id``, ``n_tokens``, ``padded`` and ``tokens`` (binary, padded) of every sequence.

    Takes pieces with their tokens. A sequence is padded to ``length`` unless its size is a
    power of two, which suits a smaller batch shape. At most ``length`` pieces meet in a group.
    """
    held = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "tokens"))).alias("held")
    )
    n = F.col("n_tokens")
    padded = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(length).cast("long"))
    joined = F.aggregate("held", F.lit(b""), lambda all_, one: F.concat(all_, one["tokens"]))
    filled = F.concat(joined, F.expr(f"unhex(repeat('{pad.to_bytes(4, 'little').hex()}', int(padded - n_tokens)))"))
    return held.withColumn("padded", padded).select("sequence_id", "n_tokens", "padded", filled.alias("tokens"))


def digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of pieces that tell where every token went."""
    return pieces.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
