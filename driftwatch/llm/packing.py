"""Packing of documents into sequences by order-preserving dynamic programming.

The ids of documents follow each other in the order of ``doc_id``, each document
ended by ``end_id``. Windows of at most ``size`` tokens cut this stream. A cut
costs nothing at the end of a document, ``SENTENCE`` after a sentence or line;
only a sentence longer than a window may be cut inside, for ``INSIDE``. A window also costs its padding. The best cost up to a
cut is that of the best earlier cut within ``size`` tokens, plus what the
window costs. All that depends on the earlier cut is ``cost - (-position)``,
so the candidates lie in a monotone queue and each enters and leaves once.

Each task packs its rows in runs of about ``run_tokens`` tokens; a run that is
not the last of its task hands its unfinished last window to the next one, so
only the last window of a task can be padded for lack of further documents.
Memory is bounded by a run and one document. Places inside an over-long sentence are
candidates every ``STRIDE`` tokens. Documents follow each other within an input split: ordering them over
all splits would shuffle every text for one padded window less in each.

Nulls and empty texts are documents of one token. Equal ids are ordered by
their text; rows that repeat are packed as often. Extra columns are ignored and
an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.tokens import TextEncoder, text_encoder

SENTENCE, INSIDE, STRIDE = 4, 40, 128
#: A token that ends in one of these ends a sentence or a line.
ENDS = (b".", b"!", b"?", b"\n")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_cuts(places: np.ndarray, costs: np.ndarray, size: int) -> list[int]:
    """Cuts of least total cost. ``places`` ascend from 0 by at most ``size``; the last one is the end, and is cut for nothing."""
    at, price = places.tolist(), costs.tolist()
    n = len(at)
    total, came = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque()
    for j in range(1, n):
        score = total[j - 1] + at[j - 1]
        while queue and queue[-1][0] >= score:
            queue.pop()
        queue.append((score, j - 1))
        while at[queue[0][1]] < at[j] - size:
            queue.popleft()
        score, i = queue[0]
        total[j] = score + size - at[j] + (price[j] if j < n - 1 else 0.0)
        came[j] = i
    cuts, j = [], n - 1
    while j:
        cuts.append(at[j])
        j = came[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; yields pieces as ``PIECE`` names them."""

    def __init__(self, encoder: TextEncoder, size: int, end_id: int, run_tokens: int, task: int):
        self.encoder, self.size, self.end_id, self.run_tokens = encoder, size, end_id, run_tokens
        ends = [encoder.quick.decode_single_token_bytes(i).endswith(ENDS) for i in range(encoder.quick.n_vocab - 1)]
        self.ends = np.array([*ends, True])
        self.sequence = task << 33
        self.docs: deque[list] = deque()  # id, tokens, how many of them are packed
        self.waiting = 0

    def add(self, doc_id: int | None, text: str) -> Iterator[tuple]:
        """Takes one document; yields the pieces of the windows that became final."""
        ids = np.append(self.encoder.encode(text), np.uint32(self.end_id)).astype("<u4")
        self.docs.append([doc_id, ids, 0])
        self.waiting += len(ids)
        if self.waiting >= self.run_tokens:
            yield from self.pack(False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Packs what waits; unless it is the last of the task, the last window keeps waiting."""
        if not self.docs:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        n = len(stream)
        cost = np.full(n + 1, np.inf)
        cost[1:][self.ends[stream]] = SENTENCE
        cost[np.cumsum([len(ids) - done for _, ids, done in self.docs])] = 0
        cost[0] = 0
        ends, stride = np.flatnonzero(np.isfinite(cost)), min(STRIDE, self.size)
        for i in np.flatnonzero(np.diff(ends) > self.size):
            cost[ends[i] + stride : ends[i + 1] : stride] = INSIDE
        places = np.flatnonzero(np.isfinite(cost))
        cuts = best_cuts(places, cost[places], self.size)
        if not last:
            cuts.pop()
        start = 0
        for cut in cuts:
            yield from self._window(cut - start)
            start = cut

    def _window(self, length: int) -> Iterator[tuple]:
        offset = 0
        while offset < length:
            doc_id, ids, done = self.docs[0]
            take = min(length - offset, len(ids) - done)
            crc = zlib.crc32(ids[done : done + take].tobytes())
            yield doc_id, done, take, crc, len(ids), self.sequence, offset
            offset += take
            self.docs[0][2] += take
            if self.docs[0][2] == len(ids):
                self.docs.popleft()
        self.waiting -= length
        self.sequence += 1


def pack(
    docs: DataFrame,
    json_path: str,
    ranks_path: str,
    size: int = 1024,
    end_id: int = 0,
    run_tokens: int = 1 << 18,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """The pieces of all documents: each id of each document lies in exactly one."""
    names = [field.split(" ")[0] for field in PIECE.split(", ")]

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True) if pieces else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(text_encoder(json_path, ranks_path), size, end_id, run_tokens, TaskContext.get().partitionId())
        for batch in batches:
            pieces: list[tuple] = []
            for one, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces += packer.add(one, value or "")
            yield batch_of(pieces)
        yield batch_of([*packer.pack(True)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(packed, PIECE)
