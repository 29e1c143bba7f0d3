"""Sum-of-squares online packing of tokenized documents into fixed windows.

Every scan partition packs its own documents as they stream by.  A document is cut into whole windows and a remainder;
the remainder goes to the fill level that minimises the sum of squared counts of partially filled windows, which a level
array of ``window`` counters tracks.  When the partition ends, windows still open are completed by cutting pieces of the
emptiest ones into the gaps of the fullest, so at most one window of a partition is padded.  No row is shuffled, and a
retried task repeats its windows exactly.

Defined results: a null or empty text still yields its end id; repeated rows are packed once each; an empty table gives
no rows; other columns are ignored.  Sequence numbers are ``partition * 2**32 + n``.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from framelake.session import ship_package, tidy

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
SPECIAL, BEYOND = "<|endoftext|>", re.compile("[^\x00-ɏ]")


def encoder(json_path: str, ranks_path: str | None):
    """text -> ids.  Latin texts go through the rank file of the same vocabulary, which is several times faster; texts
    beyond Latin or with a special token's string go through the JSON tokenizer itself.  Loading takes about 0.1 s a task;
    a kept one would hold its memory in idle workers."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(json_path)
    slow = lambda text: whole.encode(text, add_special_tokens=False).ids
    if not ranks_path:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if SPECIAL in text or BEYOND.search(text) else fast(text)


class Packer:
    """The windows of one partition; ``rows`` gathers the pieces of windows that are complete."""

    def __init__(self, window: int, first_id: int = 0):
        self.window, self.next_id, self.rows = window, first_id, []
        self.count = np.zeros(window + 1, dtype=np.int64)
        # what leaving a level and reaching a level add to the sum of squares
        self.leave = np.full(window + 1, np.iinfo(np.int64).max // 4)
        self.reach = np.ones(window + 1, dtype=np.int64)
        self.leave[0] = self.reach[window] = 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]

    def _move(self, level: int, by: int) -> None:
        n = self.count[level] = self.count[level] + by
        self.leave[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 4
        self.reach[level] = 2 * n + 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for at in range(0, n - n % w, w):
            self._emit([(doc, at, ids[at : at + w], n)])
        if n % w:
            self._place((doc, n - n % w, ids[n - n % w :], n))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = int(np.argmin(self.leave[: self.window - size + 1] + self.reach[size:]))
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self._move(level, -1)
        pieces.append(piece)
        if level + size == self.window:
            self._emit(pieces)
        else:
            self.open[level + size].append(pieces)
            self._move(level + size, 1)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def close(self) -> None:
        """Fullest windows take what they lack from the emptiest, cutting one piece at most each time."""
        left = [pieces for level in range(self.window, 0, -1) for pieces in self.open[level]]
        left = [(p, sum(len(x[2]) for x in p)) for p in left]
        i, j = 0, len(left) - 1
        while i <= j:
            pieces, level = left[i]
            while level < self.window and j > i:
                donor, has = left[j]
                doc, start, ids, total = donor.pop()
                take = min(len(ids), self.window - level)
                pieces.append((doc, start, ids[:take], total))
                if take < len(ids):
                    donor.append((doc, start + take, ids[take:], total))
                level, has = level + take, has - take
                if has:
                    left[j] = (donor, has)
                else:
                    j -= 1
            self._emit(pieces)
            i += 1
        self.open = [[] for _ in range(self.window + 1)]

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], NAMES)


def pack(docs: DataFrame, tokenizer: str, *, ranks: str | None = None, window: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents with their place: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizer JSON; ``ranks`` optionally that of the same vocabulary as ranks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(body.as_py() or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, dtype="<u4"))
            yield _batch(packer.drain())
        packer.close()
        yield _batch(packer.drain())

    ship_package(docs.sparkSession)
    return docs.selectExpr(f"cast(`{key}` as long) AS doc_id", f"`{text}` AS text").mapInArrow(tidy(run), SCHEMA)
