"""Byte-level BPE encoding and decoding through a pair occurrence index.

Texts of a task are gathered to about ``BUFFER`` bytes and cut into words. The words
not met before are laid end to end as a chain of byte symbols. An index maps
each pair that has a rank to the list of all its positions in that chain. Active ranks are taken in ascending
order from a heap; all occurrences of a pair merge at once, and the pairs that appear or
vanish next to them update the lists (vanished ones are noticed when their list is
read). Each word's ids are then kept for the task's later texts.

Special tokens of the vocabulary are found in a text first, as the tokenizers library does. A vocabulary file that asks
for other rules (a normalizer, another way to cut words, prefixes of subwords) is left to that library.

Null text counts as empty and has no ids. Every row is encoded; rows that share
a doc_id each give a row. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, vocab
from quarry.llm.wordbatch import ordered_set

BUFFER = 6 << 20
#: Words whose ids a task keeps.
KEPT = 300_000
SHIFT = np.int64(20)


class Encoder:
    """Encodes texts with the vocabulary at ``path``."""

    def __init__(self, path: str):
        import regex

        v = vocab.load(path)
        self.vocabulary = v
        self.library = None if v.plain else vocab.library(path)
        if self.library:
            return
        order = np.argsort((v.left << SHIFT) | v.right)
        self.pair = ((v.left << SHIFT) | v.right)[order]
        self.pair_rank = order
        self.words = regex.compile(vocab.WORDS.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None
        self.known: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """The words of a text; special tokens are words of their own."""
        if self.special is None or not self.special.search(text):
            return self.words.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(part)
            elif part:
                out += self.words.findall(part)
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        key = (left << SHIFT) | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where((self.pair[at] == key) & (left >= 0) & (right >= 0), self.pair_rank[at], -1) if len(self.pair) else np.full(len(key), -1)

    def learn(self, words: list[str]) -> None:
        """Finds the ids of the words and keeps them."""
        v = self.vocabulary
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        # One chain with a stop (-1) before each word and at the end.
        symbol = np.full(len(data) + len(raw) + 1, -1, np.int64)
        symbol[np.arange(len(data)) + np.repeat(np.arange(len(raw)), lengths) + 1] = v.byte_ids[data]
        following = np.arange(1, len(symbol) + 1)
        previous = np.arange(-1, len(symbol) - 1)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def index(rank: np.ndarray, at: np.ndarray) -> None:
            good = rank >= 0
            rank, at = rank[good], at[good]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            rank, at = rank[order], at[order]
            first = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]).tolist()
            for a, b in zip(first, [*first[1:], len(rank)], strict=True):
                r = int(rank[a])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(at[a:b])

        index(self._ranks(symbol[:-1], symbol[1:]), np.arange(len(symbol) - 1))
        while heap:
            r = heapq.heappop(heap)
            found = lists.pop(r)
            at = ordered_set(np.concatenate(found))  # a pair can be listed from either side
            left, right, merged = int(v.left[r]), int(v.right[r]), int(v.merged[r])
            at = at[symbol[at] == left]
            at = at[symbol[following[at]] == right]
            if left == right and len(at) > 1:  # in a run of one symbol every second pair, from its start
                chained = np.r_[False, following[at[:-1]] == at[1:]]
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(chained, 0, number))) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbol[at], symbol[gone] = merged, -2
            after = following[gone]
            following[at] = after
            previous[after] = at
            before = previous[at]
            index(np.r_[self._ranks(symbol[before], symbol[at]), self._ranks(symbol[at], symbol[after])], np.r_[before, at])
        ids = symbol[symbol != -2]
        stops = np.flatnonzero(ids == -1)
        flat = ids.astype("<i4").tobytes()
        for word, a, b in zip(words, stops.tolist(), stops[1:].tolist(), strict=False):
            self.known[word] = flat[4 * a + 4 : 4 * b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if self.library:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]
        if len(self.known) > KEPT:
            self.known.clear()
        for token, i in self.vocabulary.special.items():
            self.known[token] = i.to_bytes(4, "little")
        cuts = [self.cut(text) for text in texts]
        new: set[str] = set()
        for words in cuts:
            new.update(words)
        new.difference_update(self.known)
        if new:
            self.learn(sorted(new))
        known = self.known
        return [b"".join([known[w] for w in words]) for words in cuts]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        if self.library:
            return self.library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        table = self.vocabulary.token_bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _buffered(batches, column: int):
    """Rows of batches, gathered to about BUFFER bytes of text."""
    held, size = [], 0
    for batch in batches:
        for part in common.steps(batch, batch.schema.names[column], BUFFER):
            held.append(part)
            size += part.nbytes
            if size >= BUFFER:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of each row's whole text."""
    path = path or vocab.default_path()
    common.prepare(docs.sparkSession)

    def task(batches):
        encoder = Encoder(path)
        for table in _buffered(batches, 1):
            out = encoder.encode(table.column(1).to_pylist())
            yield from pa.Table.from_pydict({"doc_id": table.column(0), "ids": pa.array(out, pa.binary())}).combine_chunks().to_batches(common.BATCH_ROWS)

    return common.doc_texts(docs).mapInArrow(task, "doc_id long, ids binary")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of each row of ``encoded``."""
    path = path or vocab.default_path()
    common.prepare(ids.sparkSession)

    def make():
        encoder = Encoder(path)

        def work(batch):
            return {"doc_id": batch.column(0), "ids": batch.column(1), "text": pa.array([encoder.decode(x) for x in batch.column(1).to_pylist()], pa.string())}

        return work

    return common.map_steps(ids.select("doc_id", "ids"), make, "doc_id long, ids binary, text string", "ids")


def digests(texts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the rows of ``decoded``."""
    return texts.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


