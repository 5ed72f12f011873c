"""Evaluation texts leaking into a corpus: pigeonhole pieces, then Myers' bit-parallel distance.

Every run of ``window`` words of a test item is a pattern that may be matched with up to
``errors`` word edits (a word changed, missing or added).  Split into errors + 1 pieces, a
matched pattern has at least one piece without an edit, so the exact hits of pieces find
every match.  Around a hit, the pattern's distance to the document's words is taken with
Myers' bit-parallel algorithm, one machine word per step, and kept if it is within the
budget.  With no errors allowed the one piece is the pattern itself, and its hit the match.

Words are compared as they look and regardless of case (``looks.words``).  A batch of documents
is searched at once: the words become numbers, rolling hashes of all runs of a piece's length
are looked up among the pieces' sorted hashes, and only what is hit is looked at word by word,
hits in equal surroundings of one document once.  So a text of one word repeated a million
times costs no more than its length.

The test items are the query set: the driver reads them in blocks of at most ``BLOCK_WORDS``
words, of which it holds one.  A single block is searched lazily; of several, each goes over
the corpus once and its matches are written, so a large set costs more passes, not more memory.
Documents are never shuffled, and a document is searched in the task that reads it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoloom.llm.looks import words
from ontoloom.sources.scratch import Scratch

#: Most words of test items in one block: bounds what the driver holds and sends (some 150 bytes a word, once indexed).
BLOCK_WORDS = 500_000
#: Words of documents that are searched at once (some 50 bytes a word); a longer document is searched whole.
SEARCHED_WORDS = 500_000
#: Odd numbers for rolling hashes modulo 2^64, for pieces and for their surroundings.
_BASE, _WIDE_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def distance(pattern: list[int], text: list[int]) -> int:
    """The least word edits that turn some part of ``text`` into ``pattern`` (Myers 1999)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    up, down, score = full, 0, m
    best = m
    for word in text:
        eq = masks.get(word, 0)
        vertical = eq | down
        horizontal = ((((eq & up) + up) ^ up) | eq) & full
        more = (down | ~(horizontal | up)) & full
        less = up & horizontal
        score += (more & top > 0) - (less & top > 0)
        more, less = more << 1 & full, less << 1 & full
        up = (less | ~(vertical | more)) & full
        down = more & vertical
        best = min(best, score)
    return best


def _rolling(values: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """The hash of every run of ``length`` values, by its start."""
    n = len(values) - length + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for k in range(length):
            out *= base
            out += values[k : k + n]
    return out


class Index:
    """The pieces of all windows of some test items, equal windows of one item once."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int, errors: int):
        self.window, self.errors = window, errors
        self.ids: dict[str, int] = {}
        #: (item id, the word numbers of a window)
        self.windows: list[tuple[int, tuple[int, ...]]] = []
        for item, own in items:
            numbers = [self.ids.setdefault(w, len(self.ids) + 2) for w in own]
            self.windows += [(item, w) for w in dict.fromkeys(tuple(numbers[at : at + window]) for at in range(len(own) - window + 1))]
        self.cuts = [window * k // (errors + 1) for k in range(errors + 2)]
        table = np.array([w for _, w in self.windows], dtype=np.uint64).reshape(len(self.windows), window)
        #: length -> (sorted hashes, window, offset) of the pieces
        self.pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for length in sorted({b - a for a, b in zip(self.cuts, self.cuts[1:])}):
            starts = [a for a, b in zip(self.cuts, self.cuts[1:]) if b - a == length]
            hashes = np.concatenate([self._hash(table[:, a : a + length]) for a in starts])
            which, offset = np.tile(np.arange(len(table)), len(starts)), np.repeat(starts, len(table))
            order = np.argsort(hashes, kind="stable")
            self.pieces[length] = hashes[order], which[order], offset[order]

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            out = out * _BASE + rows[:, k]
        return out

    def numbers(self, text: list[str]) -> np.ndarray:
        """The numbers of words; 1 is a word of no item."""
        return np.fromiter((self.ids.get(w, 1) for w in text), dtype=np.uint64, count=len(text))

    def search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, item id, least distance of a window of it) within the budget, each pair once; texts as ``numbers``."""
        # 0 stands between texts; the gap keeps surroundings within their text
        gap = np.zeros(self.window + self.errors, dtype=np.uint64)
        numbers = np.concatenate([gap, *(part for own in texts for part in (own, gap))])
        begins = len(gap) + np.cumsum([0, *(len(own) + len(gap) for own in texts[:-1])])
        known = np.concatenate([[0], np.cumsum(numbers > 1)])
        found: dict[tuple[int, int], int] = {}
        for length, (hashes, which, offset) in self.pieces.items():
            if len(hashes) and len(numbers) >= length:
                whole = np.flatnonzero(known[length:] - known[:-length] == length)
                rolled = _rolling(numbers, length, _BASE)[whole]
                low, high = np.searchsorted(hashes, rolled, "left"), np.searchsorted(hashes, rolled, "right")
                hit = high > low
                self._look(numbers, begins, whole[hit], low[hit], high[hit], which, offset, found)
        for (text, item), far in found.items():
            yield text, item, far

    def _look(self, numbers, begins, positions, low, high, which, offset, found) -> None:
        """Check what was hit, equal hits in equal surroundings of one text once."""
        if not len(positions):
            return
        texts = np.searchsorted(begins, positions, "right") - 1
        around = low.astype(np.uint64)
        if self.errors:
            reach = self.window + self.errors
            padded = np.concatenate([numbers, np.zeros(reach, dtype=np.uint64)])
            around = around * _BASE + _rolling(padded, 2 * reach, _WIDE_BASE)[positions - reach]
        _, first = np.unique(np.stack([texts.astype(np.uint64), low.astype(np.uint64), around]), axis=1, return_index=True)
        for n in first.tolist():
            text, at = int(texts[n]), int(positions[n])
            for entry in range(int(low[n]), int(high[n])):
                item, own = self.windows[which[entry]]
                if found.get((text, item)) == 0:
                    continue
                start = at - int(offset[entry])
                if self.errors:
                    far = distance(own, numbers[max(start - self.errors, 0) : start + self.window + self.errors].tolist())
                else:  # hashes can be equal by chance
                    far = 0 if tuple(numbers[start : start + self.window].tolist()) == own else 1
                if far <= self.errors and far < found.get((text, item), self.errors + 1):
                    found[text, item] = far


def _blocks(items: DataFrame, item_id: str, text: str, window: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Blocks of (item id, words); an item longer than a block is cut into parts that overlap by a window less a word."""
    block, size = [], 0
    for row in items.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).toLocalIterator():
        own = words(row[1])
        step = max(BLOCK_WORDS, window)
        for at in range(0, max(len(own) - window + 1, 1), max(step - window + 1, 1)):
            part = own[at : at + step]
            if block and size + len(part) > BLOCK_WORDS:
                yield block
                block, size = [], 0
            block.append((row[0], part))
            size += len(part)
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, window: int = 10, errors: int = 0, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits): each document and item with a matching window, and its least edits.

    Null, empty and short texts match nothing; items of fewer than ``window`` words have no window.
    Rows of one document id, and of one item id, count as one, so no pair of ids comes twice; only
    the pairs found are shuffled for that.  ``errors`` must be less than ``window``.
    """
    if not 0 <= errors < window:
        raise ValueError("errors must be at least 0 and less than window")
    spark = documents.sparkSession
    kinds = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits int"
    texts = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("text is not null")

    def searched(block) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast((block, window, errors))
        return texts.mapInArrow(_searcher(shared, uuid.uuid4().hex, schema), schema), shared

    blocks = _blocks(items, item_id, text, window)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return spark.createDataFrame([], schema)
    if second is None:
        out, _ = searched(first)
    else:
        scratch, number = Scratch(spark, "leaks"), 0
        while first is not None:
            part, shared = searched(first)
            scratch.save(part, f"blocks/block={number}")
            shared.destroy()
            first, second, number = second, next(blocks, None), number + 1
        out = scratch.read("blocks", part.schema)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


#: The last indexes of this process, which its tasks share.
_indexes: dict[str, Index] = {}


def _index(name: str, shared) -> Index:
    if name not in _indexes:
        while len(_indexes) > 1:
            del _indexes[next(iter(_indexes))]
        _indexes[name] = Index(*shared.value)
    return _indexes[name]


def _searcher(shared, name: str, schema: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(name, shared)
        for batch in batches:
            ids, rows, texts, begun, size = batch.column("doc_id").to_pylist(), [], [], 0, 0
            for n, t in enumerate(batch.column("text").to_pylist(), 1):
                texts.append(index.numbers(words(t)))
                size += len(texts[-1])
                if size > SEARCHED_WORDS or n == len(ids):
                    rows += [(ids[begun + k], item, far) for k, item, far in index.search(texts)]
                    texts, begun, size = [], n, 0
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, types)], schema=types)

    return run
