"""Token ids of whole texts by a public byte-level BPE vocabulary, with forced boundaries.

Two bytes that are never neighbours inside any token of the vocabulary can never be merged
into one, so a text may be cut between them, the pieces encoded on their own and the ids
joined.  The vocabulary's split pattern must see the pieces as it sees the text, hence cuts
are made only after a character that is no white space (the pattern looks ahead only behind white
space) and never before an apostrophe (which could begin a contraction).  In natural text
these cuts fall before nearly every word and sign, so a batch of texts has few distinct
fragments, and each is encoded once.

A batch is cut by one vectorised pass over its Arrow bytes; the fragments are views of the
same buffer, made unique by Arrow's hash table, and the ids are put together by index.
A long text without a cut is one fragment, which the encoder merges in n log n time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how this vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """A vocabulary file of ranks (a base64 token and its id per line), loaded once per process."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        pairs = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                pairs[b[:-1], b[1:]] = True
        free = ~pairs
        blanks = list(b" \t\n\x0b\x0c\r")
        free[blanks, :] = False
        free[:, ord("'")] = False
        free[:, 0x80:0xC0] = False  # inside a character
        self.free = free.ravel()

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """True at each byte before which a cut is certain."""
        out = np.zeros(len(data), dtype=bool)
        if len(data) < 2:
            return out
        before, after = data[:-1], data[1:]
        out[1:] = self.free[before.astype(np.uint16) * 256 + after]
        high = np.flatnonzero(out[1:] & (before >= 0x80))  # cuts behind a non-ASCII character, which may be a blank
        if len(high):
            one, two, three = data[high], data[np.maximum(high - 1, 0)], data[np.maximum(high - 2, 0)]
            blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
            blank |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
            blank |= (three == 0xE1) & (two == 0x9A) & (one == 0x80) | (three == 0xE2) & (two == 0x81) & (one == 0x9F) | (three == 0xE3) & (two == 0x80) & (one == 0x80)
            out[high[blank] + 1] = False
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        """A list of ids for each text; empty lists for empty and null ones."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, dtype=np.int32)), pa.array([], pa.int32()))
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, dtype=np.uint8)[low:high]
        start = self.cuts(data)
        bounds = offsets - low
        start[bounds[:-1][bounds[:-1] < len(data)]] = True
        at = np.append(np.flatnonzero(start), len(data)).astype(np.int64)
        fragments = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data))
        coded = fragments.dictionary_encode()
        ids = list(map(self.encoding.encode_ordinary, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter((i for part in ids for i in part), dtype=np.int32, count=int(sizes.sum()))
        begins = np.concatenate([[0], np.cumsum(sizes)])
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        values = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - begins[which], lengths)]
        return pa.LargeListArray.from_arrays(pa.array(ends[np.searchsorted(at, bounds)]), pa.array(values)).cast(pa.list_(pa.int32()))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(path, pattern)


def token_ids(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(doc_id, ids): the token ids of every text, without special tokens; whole texts, no shuffle.

    Null and empty texts have an empty list; strings of special tokens are ordinary text; repeated
    rows stay.  ``vocabulary`` is a path that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), encode(batch.column("text"))], names=["doc_id", "ids"])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")
