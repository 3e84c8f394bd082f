"""Cost-balanced packing of documents into sequences of tokens.

A sequence costs, for each piece of ``n`` tokens in it, ``LINEAR * n + QUADRATIC * n * n``:
matrix products plus attention inside the piece. Of each document, whole multiples
of the sequence length are sequences of their own. What is left over is packed
group by group: in descending length, each goes to the sequence with the lowest cost among those that
have room for it. Those that fit nowhere are cut to fill the room that is left,
so that every sequence is full; the last tokens of a group, fewer than a
sequence, are cut into sequences whose lengths are powers of two, which take no padding.

A group is a run of documents of one task, of ``GROUP_TOKENS`` tokens at least (or the end of the
task): memory is bounded, nothing is shuffled. Tasks that are run again give the same pieces.

Null text counts as empty: its only token is the end token. Repeated rows are packed each by itself.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import common, vocab

LENGTH = 1024
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 2_000_000
END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def plan(lengths: np.ndarray, size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    pieces, count = [], 0
    for doc, n in enumerate(lengths.tolist()):
        for k in range(n // size):
            pieces.append((doc, k * size, size, count, 0))
            count += 1
    rest = lengths % size
    full = int(rest.sum()) // size
    room, spent = np.full(full, size, np.int64), np.zeros(full)
    waiting = []
    for doc in np.argsort(-rest, kind="stable").tolist():
        n, start = int(rest[doc]), int(lengths[doc] - rest[doc])
        if not n:
            break
        able = np.where(room >= n, spent, np.inf) if full else spent
        best = int(able.argmin()) if full else -1
        if best < 0 or able[best] == np.inf:
            waiting.append((doc, start, n))
            continue
        pieces.append((doc, start, n, count + best, size - int(room[best])))
        room[best] -= n
        spent[best] += cost(n)
    tail = [1 << b for b in reversed(range(size.bit_length())) if (int(rest.sum()) % size) >> b & 1]
    gaps = [(count + int(k), size - int(room[k]), int(room[k])) for k in np.argsort(spent, kind="stable") if room[k]]
    gaps += [(count + full + k, 0, n) for k, n in enumerate(tail)]
    at = 0
    for doc, start, n in waiting:
        while n:
            sequence, offset, free = gaps[at]
            took = min(n, free)
            pieces.append((doc, start, took, sequence, offset))
            start, n = start + took, n - took
            gaps[at] = (sequence, offset + took, free - took)
            at += gaps[at][2] == 0
    return pieces


def packed(docs: DataFrame, path: str | None = None, size: int = LENGTH) -> DataFrame:
    """The pieces of all documents: ``SCHEMA``, with token ids by the vocabulary at ``path``."""
    path = path or vocab.default_path()
    common.prepare(docs.sparkSession)

    def task(batches):
        from pyspark import TaskContext

        encode = vocab.fast_encoder(path)
        base, held, tokens = TaskContext.get().partitionId() << 40, [], 0
        end = np.array([END], np.uint32)

        def flush():
            nonlocal base, held, tokens
            lengths = np.array([len(ids) for _, ids in held], np.int64)
            pieces = plan(lengths, size)
            sums = [zlib.crc32(held[d][1][a : a + n].astype("<u4").tobytes()) for d, a, n, _, _ in pieces]
            doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([held[d][0] for d in doc.tolist()], pa.int64()), "start": start, "length": length, "ids_crc32": pa.array(sums, pa.int64()),
                "doc_tokens": lengths[doc], "sequence_id": base + sequence, "offset": offset,
            })
            base += int(sequence.max()) + 1
            held, tokens = [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text), end])
                held.append((doc_id, ids))
                tokens += len(ids)
                if tokens >= GROUP_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return common.doc_texts(docs).mapInArrow(task, SCHEMA)
