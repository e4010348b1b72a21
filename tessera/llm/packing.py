"""Tokenising and sum-of-squares packing of documents into training sequences."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.llm.common import prepare

SEQUENCE = 2048
#: Windows that a task keeps open (8 MB of ids).
OPEN_WINDOWS = 1024
#: Bytes of an id.
WIDTH = 4
#: Pretokens whose ids a worker keeps (about 45 MB); those that are met again, first come first kept.
CACHED_PRETOKENS = 200_000

# Pretokens of the vocabulary's own pattern, for lower-case text of ASCII and Latin-1 characters only.
_PLAIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿªµº]+|[0-9²³¹¼½¾]|[^\\sa-zß-öø-ÿªµº0-9²³¹¼½¾]+")
_ODD = re.compile("[^\t-\r -~¡-ÿ]")


class PretokenIds(dict):
    """Ids, as little-endian bytes, by pretoken: whitespace never reaches an id, so a text's are those of its pretokens in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.met = Tokenizer.from_file(path), bytearray(1 << 22)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(self) < CACHED_PRETOKENS:
            k = hash(word) & len(self.met) - 1
            if self.met[k]:
                self[word] = ids
            self.met[k] = 1
        return ids

    def encode(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str) -> bytes:
        if _ODD.search(text) or any(s in text for s in self.special):
            return self.encode(text)
        return b"".join(map(self.__getitem__, _PLAIN.findall(text.lower())))


_tokenizers: dict[str, PretokenIds] = {}


def pretoken_ids(path: str) -> PretokenIds:
    if path not in _tokenizers:
        _tokenizers[path] = PretokenIds(path)
    return _tokenizers[path]


class SumOfSquares:
    """Online packing after Csirik et al., On the Sum-of-Squares Algorithm for Bin Packing.

    ``levels[h]`` counts the windows filled to ``h``. An item goes where the sum of squared counts grows
    least, a fresh window being level 0; of equals, to the fullest. Full windows leave; ``add`` returns them.
    """

    def __init__(self, size: int):
        self.size, self.levels, self.open = size, np.zeros(size + 1, np.int64), [[] for _ in range(size + 1)]

    def add(self, item, length: int) -> list | None:
        size, levels = self.size, self.levels
        after = levels[length:]  # of level h + length
        growth = 2 * (after - levels[: size + 1 - length]) + 2
        growth[levels[: size + 1 - length] == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * after[0] + 1  # a fresh window; level 0 isn't counted
        if length < size:
            growth[-1] = 1 - 2 * levels[size - length] if levels[size - length] else np.iinfo(np.int64).max
        else:
            growth[-1] = 0
        h = size - length - int(np.argmin(growth[::-1]))
        window = self.open[h].pop() if h else []
        levels[h] -= h > 0
        window.append(item)
        if h + length == size:
            return window
        levels[h + length] += 1
        self.open[h + length].append(window)
        return None

    def drain(self, last: bool) -> Iterator[list]:
        """Empties the open windows, the fullest first, into full ones, items being cut at the edges.

        What is left over, less than a window, stays open; or, at the ``last``, is cut into windows of powers of
        two, which need no padding.
        """
        items = [item for h in range(self.size, 0, -1) for window in self.open[h] for item in window]
        whole, rest = divmod(int(np.dot(self.levels, np.arange(self.size + 1))), self.size)
        self.levels[:], self.open = 0, [[] for _ in range(self.size + 1)]
        lengths = [self.size] * whole
        if last:
            yield from _recut(items, lengths + [1 << b for b in range(rest.bit_length())[::-1] if rest >> b & 1])
            return
        for window in _recut(items, lengths + [rest] * (rest > 0)):
            if whole:
                whole -= 1
                yield window
            else:
                self.levels[rest] = 1
                self.open[rest].append(window)


def _recut(items: list[tuple], lengths: list[int]) -> Iterator[list[tuple]]:
    """Sequences of these lengths, which add up to the items' ids."""
    todo, sequence, room = iter(lengths), [], 0
    for doc_id, start, ids, total in items:
        while ids:
            room = room or next(todo)
            piece, ids = ids[: room * WIDTH], ids[room * WIDTH :]
            sequence.append((doc_id, start, piece, total))
            start, room = start + len(piece) // WIDTH, room - len(piece) // WIDTH
            if not room:
                yield sequence
                sequence = []


def pack(documents: Iterator[tuple[int | None, bytes]], size: int = SEQUENCE, most_open: int = OPEN_WINDOWS) -> Iterator[list[tuple]]:
    """Sequences, as lists of ``(doc_id, start, ids, doc_tokens)``, of documents given as ``(doc_id, ids)``.

    A document of more than ``size`` ids fills whole sequences first and places the remainder. Whenever more than
    ``most_open`` windows are open, and at the end, they are emptied and refilled in order. All sequences have
    ``size`` ids but the very last few, of a power of two each, so none is padded.
    """
    windows = SumOfSquares(size)
    for doc_id, ids in documents:
        total, start = len(ids) // WIDTH, 0
        while total - start >= size:
            yield [(doc_id, start, ids[start * WIDTH : (start + size) * WIDTH], total)]
            start += size
        if start == total:
            continue
        if full := windows.add((doc_id, start, ids[start * WIDTH :], total), total - start):
            yield full
        if windows.levels.sum() > most_open:
            yield from windows.drain(last=False)
    yield from windows.drain(last=True)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, a row per piece.

    Every task tokenises and packs its own rows with the sum-of-squares rule, so nothing is shuffled and no
    group is gathered; a bounded number of open windows is all a task keeps. ``ids`` are little-endian unsigned
    32-bit ids. Sequences hold ``size`` ids, save at most eleven a task that hold a power of two, so however the
    rows are dealt nothing is padded. Null texts count as empty and are the closing id alone; null and
    repeated ids, of any type, are carried along; an empty table gives no row; other columns aren't read.
    """
    prepare(docs.sparkSession)
    end, id_type = array("I", [end_id]).tobytes(), to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = pretoken_ids(tokenizer)
        sequence_id = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                yield from ((d, ids_of.text(t or "") + end) for d, t in zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True))

        rows: list[tuple] = []
        for sequence in pack(documents(), size):
            offset = 0
            for doc_id, start, ids, total in sequence:
                n = len(ids) // WIDTH
                rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence_id, offset, ids if with_ids else None))
                offset += n
            sequence_id += 1
            if len(rows) >= 4096:
                yield _batch(rows, id_type, with_ids)
                rows = []
        if rows:
            yield _batch(rows, id_type, with_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _batch(rows: list[tuple], id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    data = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:7]]
    return pa.RecordBatch.from_arrays(data + ([pa.array(cols[7], pa.binary())] if with_ids else []), ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)
