"""Language-model scores from a hierarchical Pitman-Yor model of words.

Tokens of a text are its words (A-Z as a-z) and one end. A token's context is the word before it, whichever it is (the first token's: the start of the text).
The 2**BITS[0] - 2 most common words of a sample are contexts by number, all others by BITS[1] - 1 bits of their hash.
Each context is a restaurant; all share
one parent, the restaurant of words without context, whose own base gives each known word, and
all unknown ones together, 1 / (V + 1).

Seating. Customers of a dish (a word in a context) sit down by the Chinese-restaurant rule: at a table
of that dish with weight (customers - discount x tables), at a new one with weight
(strength + discount x tables of the restaurant) x the parent's probability of the dish. Each new table sends a customer to the
parent. A Gibbs sweep takes all customers of a dish out and seats them anew, given all
others' tables; dishes are worked on side by side, with the restaurants' totals of the sweep before. Customers after the
first ``exact`` (128) sit down in groups of 1/64 of those seated, within which the odds hold, so that
time grows with the logarithm of a count; a larger ``exact`` seats more of them one by one. Discounts follow from the numbers of dishes with one and two
customers. After BURN sweeps, KEPT seatings are kept, and predictive probabilities are averaged over them.

Distribution. Words are known by 64-bit hashes. Each task counts its (word, context) pairs and sends one
packed row to each bucket; a bucket holds all counts of its words and is seated by
itself, with only the totals of restaurants shared. Those of numbered contexts go to all tasks; for the others, at any number of them, each
bucket asks before every sweep and at the end: its contexts and sums travel to the contexts' groups, are added there, and the totals travel back. It asks for the contexts of held-out
tokens too (they are dealt as pairs with no customers), so every token to be scored finds its restaurant. The HOT most common words of a sample would make hot buckets; their pairs
are dealt to buckets by word and context, and their places at the parent are totals as those of contexts are, seated on the driver. To score, pairs of hot words
with very many customers go to all tasks as one table, PAIRS at most; other tokens travel, packed, to their pair's bucket, and sums of log probabilities travel back to the documents' chunk.
Buckets follow from the bytes of text (BUCKET_BYTES each); a run of tokens is dealt to FAN of them at most, and where there are more, in two steps: to groups of buckets,
where runs are joined, and from there to buckets; sums come back the same way. Rows grow with the input, not with its square.
All texts, all tokens and all counts take part, at any size.

Null text counts as empty: its one token is the end. A null doc_id is in training. Repeated
rows are learnt and scored each by itself. With no training rows all
tokens are unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, wordbatch

#: Bits of a numbered context and of any context; groups of the contexts that have no number, and buckets for one more.
BITS = (17, 40)
GROUPS, GROUP_BUCKETS = 1024, 4
HOT, SAMPLE = 16_384, 20_000
PAIRS = 1 << 20
BURN, KEPT = 2, 2
STRENGTH = (1.0, 1.0)  # of the parent, of contexts
EXACT = 128
TOKENS = 3_000_000
CHUNK_BYTES = 8 << 20
BUCKET_BYTES, LEAST_BUCKETS, FAN = 16 << 20, 16, 2048
END = wordbatch.mix(np.array([1], np.uint64))[0]
START_CONTEXT = 0


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


class Bits(int):
    """The bits of a context, with the sorted hashes of the words that are contexts by number."""

    numbered: np.ndarray

    def __new__(cls, bits: int, numbered: np.ndarray):
        self = super().__new__(cls, bits)
        self.numbered = numbered
        return self

    def __reduce__(self):
        return Bits, (int(self), self.numbered)


def contexts(word: np.ndarray, bits: int) -> np.ndarray:
    """The context that each word is: its number from 1 on, or bits of its hash after a first bit that is set."""
    top = 1 << (int(bits) - 1)
    own = (wordbatch.mix(word + np.uint64(77)) & np.uint64(top - 1)).astype(np.int64) | top
    numbered = getattr(bits, "numbered", own[:0])
    if not len(numbered):
        return own
    at = np.minimum(np.searchsorted(numbered, word), len(numbered) - 1)
    return np.where(numbered[at] == word, at + 1, own)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, text number) of every token, the end of each text included."""
    words = wordbatch.split(texts)
    place = np.arange(len(words.owner)) + words.owner
    last = np.cumsum(words.per_text() + 1) - 1
    word = np.empty(len(words.owner) + len(texts), np.uint64)
    owner = np.empty(len(word), np.int32)
    word[last], owner[last] = END, np.arange(len(texts))
    word[place], owner[place] = words.hashes(), words.owner
    return word, owner


def _after(word: np.ndarray, bits: int) -> np.ndarray:
    """The context of a token that comes after each word; after an end it is the start of the next text."""
    return np.where(word == END, START_CONTEXT, contexts(word, bits))


def tokens(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, text number) of every token, the end of each text included."""
    word, owner = _words(texts)
    return word, np.r_[np.full(min(1, len(word)), START_CONTEXT), _after(word[:-1], bits)], owner


@dataclass
class Piece:
    """Tokens in few bytes each, as tasks hold many and run side by side in an executor."""

    words: np.ndarray  # the distinct ones, in order
    context: np.ndarray  # that a token after each of them has
    at: np.ndarray  # each token's place among the words, and that of the word before it
    before: np.ndarray
    mark: np.ndarray  # of each token: its text's number, or what the caller needs instead

    def only(self, some: np.ndarray) -> Piece:
        """Some of the tokens, with the words that they need."""
        if some.all():
            return self
        at, before = self.at[some], self.before[some]
        there = np.zeros(len(self.words), bool)
        there[at] = there[before] = True
        place = np.cumsum(there, dtype=np.int32) - np.int32(1)
        return Piece(self.words[there], self.context[there], place[at], place[before], self.mark[some])

    def used(self) -> np.ndarray:
        """The words that tokens have."""
        there = np.zeros(len(self.words), bool)
        there[self.at] = True
        return self.words[there]


def pieces_of(texts: list[bytes], bits: int, most: int) -> Iterator[Piece]:
    """The tokens of the texts in order, in pieces of ``most`` or less."""
    word, owner = _words(texts)
    for a in range(0, len(word), most):
        words, at = np.unique(np.r_[word[a - 1] if a else END, word[a : a + most]], return_inverse=True)
        at = at.astype(np.int32)
        yield Piece(words, _after(words, bits), at[1:], at[:-1], owner[a : a + most])


def _bunches(held: list[Piece], most: int) -> Iterator[list[Piece]]:
    """Takes the pieces out in order, together until they are ``most`` tokens or more."""
    while held:
        n = np.cumsum([len(p.at) for p in held])
        last = min(int(np.searchsorted(n, most)) + 1, len(held))
        bunch, held[:last] = held[:last], []
        yield bunch


@dataclass
class Deal:
    """How pairs are named and dealt. A pair's key is ``place of its word << bits | context``: places under ``places`` are those of hot words, others follow a row's own list of words."""

    bits: Bits
    buckets: int
    hot: np.ndarray  # sorted hashes, ``places`` at most
    places: int
    group: int  # buckets that are dealt to as one in the first step
    wide: int  # numbers of contexts; the last stands for all contexts without a number together

    @property
    def groups(self) -> int:
        """Groups of the contexts without a number."""
        return max(min(self.buckets, GROUPS), self.buckets // GROUP_BUCKETS)

    def asked(self, key: np.ndarray) -> np.ndarray:
        """The contexts without a number among the keys', in order."""
        context = key & ((1 << self.bits) - 1)
        return wordbatch.ordered_set(context[context >= self.wide])

    def fits(self, words: int) -> None:
        """Keys are 63 bits; runs of TOKENS and buckets of BUCKET_BYTES are far below that."""
        if self.places + words >= 1 << (63 - self.bits):
            raise ValueError(f"{words} words in one list are too many for their keys")

    def named(self, word: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own words in order, key of each token)."""
        order = np.argsort(word)
        words = word[order]
        first = _groups(words)
        words = words[first]
        at = np.minimum(np.searchsorted(self.hot, words), max(len(self.hot) - 1, 0))
        hot = self.hot[at] == words if len(self.hot) else np.zeros(len(words), bool)
        place = np.where(hot, at, self.places + np.cumsum(~hot) - 1)
        self.fits(int((~hot).sum()))
        key = np.empty(len(word), np.int64)
        key[order] = np.repeat(place, np.diff(first, append=len(word)))
        del order
        key <<= int(self.bits)
        key |= context
        return words[~hot], key

    def listed(self, pieces: list[Piece]) -> tuple[np.ndarray, Callable[[Piece], np.ndarray]]:
        """(own words of all pieces in order, what gives the key of each token of a piece)."""
        every = wordbatch.ordered_set(np.concatenate([p.used() for p in pieces]))
        words, place = self.named(every, np.zeros(len(every), np.int64))
        return words, lambda p: place[np.minimum(np.searchsorted(every, p.words), len(every) - 1)][p.at] | p.context[p.before]

    def pieces(self, words: np.ndarray, key: np.ndarray, first: int, count: int, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket // size, its words, places in ``key``, its keys) for the buckets first .. first + count of sorted keys."""
        floor = self.places << self.bits
        cut = int(np.searchsorted(key, floor))
        edges = np.minimum(np.arange(first, first + count + size, size), first + count)
        bucket = (wordbatch.mix(key[:cut].astype(np.uint64)) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        hot = np.searchsorted(bucket[order], edges)
        own = np.searchsorted(bucket_of(words, self.buckets), edges)
        pair = cut + np.searchsorted(key[cut:], (self.places + own) << self.bits)
        for k in range(len(edges) - 1):
            at = np.r_[np.sort(order[hot[k] : hot[k + 1]]), np.arange(pair[k], pair[k + 1])]
            if len(at):
                mine = key[at]
                mine[hot[k + 1] - hot[k] :] -= own[k] << self.bits
                yield int(edges[k]) // size, words[own[k] : own[k + 1]], at, mine


def bucket_of(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word that isn't hot; it grows with the hash."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(x).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts, in four bytes each where they fit."""
    return b"8" + _pack(x.astype("<u8")) if len(x) and int(x.max()) >> 32 else b"4" + _pack(x.astype("<u4"))


def _unpack_counts(data: bytes) -> np.ndarray:
    return _unpack(data[1:], "<u8" if data[:1] == b"8" else "<u4").astype(np.int64)


def _pack_keys(key: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences: 16 low bits as they are, the rest packed."""
    step = np.diff(key, prepend=0)
    return (step & 0xFFFF).astype("<u2").tobytes(), _pack((step >> 16).astype("<u4" if not len(step) or int(step.max()) < 1 << 48 else "<u8"))


def _unpack_keys(low: bytes, high: bytes) -> np.ndarray:
    rest = zlib.decompress(high)
    n = len(low) // 2
    step = np.frombuffer(rest, "<u8" if n and len(rest) == 8 * n else "<u4").astype(np.int64) << 16
    return np.cumsum(step | np.frombuffer(low, "<u2"))


def _groups(column: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, column[1:] != column[:-1]]) if len(column) else np.zeros(0, np.int64)


def _joined(deal: Deal, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """One list of words for several (words, keys), and the keys by it."""
    words = wordbatch.ordered_set(np.concatenate([w for w, _ in parts]))
    deal.fits(len(words))
    out = []
    for own, key in parts:
        place = key >> deal.bits
        new = np.where(place < deal.places, place, deal.places + np.searchsorted(words, own)[np.maximum(place - deal.places, 0)] if len(own) else place)
        out.append((new << deal.bits) | (key & ((1 << deal.bits) - 1)))
    return words, out


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key = key[order]
    first = _groups(key)
    count = count[order]
    del order
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _pairs(key: np.ndarray, learnt: np.ndarray | slice, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, of learnt tokens with their counts and of ``other`` (distinct, in order) with 0. Few arrays of a key for each token live at once: tasks run side by side in an executor. A slice of ``key`` is sorted where it lies."""
    key = key[learnt]
    key.sort()
    first = _groups(key)
    count = np.diff(first, append=len(key))
    key = key[first]
    del first
    if len(other):
        at = np.searchsorted(key, other)
        new = np.ones(len(other), bool)
        there = at < len(key)
        new[there] = key[at[there]] != other[there]
        key, count = np.insert(key, at[new], other[new]), np.insert(count, at[new], 0)
    return key, count


COUNTS = "bucket int, words binary, low binary, high binary, count binary"


def _counts_row(bucket: int, words: np.ndarray, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    low, high = _pack_keys(key)
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "words": [words.tobytes()], "low": pa.array([low], pa.binary()), "high": [high], "count": [_pack(count.astype("<u8"))]})


def _read_counts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["words"], np.uint64), _unpack_keys(row["low"], row["high"]), _unpack(row["count"], "<u8").astype(np.int64)


def counted(docs: DataFrame, deal: Deal) -> DataFrame:
    """A row for each bucket of each run of a task's training tokens: its pairs and their counts, packed. Pairs of held-out tokens whose context has no number go along with a count of 0."""
    shared = docs.sparkSession.sparkContext.broadcast(deal)  # HOT hashes

    def task(batches):
        deal, held, size = shared.value, [], 0

        def flush():
            common.give_back()
            words, keys = deal.listed(held)
            key, other, n = [np.empty(sum(int(p.mark.sum()) for p in held), np.int64)], [], 0
            while held:
                piece = held.pop()
                mine = keys(piece)
                other.append(wordbatch.ordered_set(mine[~piece.mark]))
                mine = mine[piece.mark]
                key[0][n : n + len(mine)] = mine
                n += len(mine)
            del piece, mine, keys
            key, count = _pairs(key.pop(), slice(None), wordbatch.ordered_set(np.concatenate(other)))
            for b, own, at, mine in deal.pieces(words, key, 0, deal.buckets, deal.group):
                yield _counts_row(b, own, mine, count[at])

        for batch in batches:
            for part in common.steps(batch):
                learn = np.array([not held_out(i) for i in part.column(0).to_pylist()], bool)
                for piece in pieces_of(common.text_bytes(part), deal.bits, TOKENS):
                    piece.mark = learn[piece.mark]
                    some = piece.mark | (piece.context[piece.before] >= deal.wide)
                    if some.any():
                        held.append(piece.only(some))
                        size += len(held[-1].at)
                    if size >= TOKENS:
                        yield from flush()
                        size = 0
        if held:
            yield from flush()

    rows = docs.mapInArrow(common.lean(task), COUNTS)
    size = deal.group
    if size == 1:
        return rows

    def again(batches):
        """Joins what groups of buckets have got, and deals it to the buckets."""
        deal, group, held, pairs = shared.value, None, [], 0

        def flush():
            words, keys = _joined(deal, [(w, k) for w, k, _ in held])
            key, count = _summed(np.concatenate(keys), np.concatenate([c for _, _, c in held]))
            first = group * size
            for b, own, at, mine in deal.pieces(words, key, first, min(size, deal.buckets - first), 1):
                yield _counts_row(b, own, mine, count[at])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"] != group or pairs >= TOKENS):
                    yield from flush()
                    held, pairs = [], 0
                group = row["bucket"]
                held.append(_read_counts(row))
                pairs += len(held[-1][1])
        if held:
            yield from flush()

    salt = F.pmod(F.xxhash64("low", "words"), F.lit(max(1, size // 4)))
    return rows.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket").drop("salt").mapInArrow(common.lean(again), COUNTS)


#: also: contexts of held-out tokens, which have no number and no pair here; kept_rare: tables of all asked contexts, of kept seatings.
STATE = "bucket int, words binary, low binary, high binary, count binary, tables binary, parent binary, kept array<binary>, kept_parent array<binary>, also array<binary>, kept_rare array<binary>, sums binary, facts array<long>"
#: Places in ``facts``: words that aren't hot, pairs with 1 and 2 customers, words with 1 and 2 customers at the parent, the parent's tables of these words; then pairs of hot words by count.
_LEVELS, _N_LEVELS = 6, 256
_N_FACTS = _LEVELS + _N_LEVELS


def level(count: np.ndarray) -> np.ndarray:
    """Counts on a scale of quarter octaves."""
    return np.floor(4 * np.log2(np.maximum(count, 1))).astype(np.int64)


@dataclass
class Totals:
    """What all buckets share: numbers for each numbered context and hot word, and a few more."""

    customers: np.ndarray  # by number of a context; the last are those of all other contexts
    tables: np.ndarray
    hot_counts: np.ndarray
    hot_customers: np.ndarray  # at the parent
    hot_parent: np.ndarray  # tables
    words: int
    discount: tuple[float, float]  # of the parent, of contexts
    parent_tables: int
    levels: np.ndarray

    @property
    def base(self) -> float:
        return 1 / (self.words + 1)

    def parent_probability(self, customers, tables):
        d, s = self.discount[0], STRENGTH[0]
        return (customers - d * tables + (s + d * self.parent_tables) * self.base) / (s + self.tables.sum())

    def probability(self, count, tables, context, parent):
        return self.served(count, tables, self.customers[context], self.tables[context], parent)

    def served(self, count, tables, customers, all_tables, parent):
        """The probability of a dish in a restaurant with so many customers and tables."""
        d, s = self.discount[1], STRENGTH[1]
        return (count - d * tables + (s + d * all_tables) * parent) / (s + customers)


def reseat(customers: np.ndarray, others: np.ndarray, discount: float, strength: float, base, draw: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """Tables of each dish after its customers have sat down, the first ``exact`` one by one; ``others``: tables of other dishes in its restaurant."""
    order = np.argsort(-customers, kind="stable")
    c, others, base = customers[order], others[order].astype(np.float64), np.broadcast_to(base, customers.shape)[order]
    tables = np.minimum(c, 1).astype(np.int64)
    seated = 1
    while True:
        live = int(np.searchsorted(-c, -seated, side="left"))
        if not live:
            break
        step = max(1, seated // 64) if seated >= exact else 1
        t = tables[:live]
        new = (strength + discount * (others[:live] + t)) * base[:live]
        p = new / (new + seated - discount * t)
        tables[:live] += draw.random(live) < p if step == 1 else draw.binomial(np.minimum(step, c[:live] - seated), p)
        seated += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _state(deal: Deal, bucket: int, words, key, count, tables, parent, kept: list, kept_parent: list, also: list, kept_rare: list) -> dict:
    """A bucket's row; ``parent`` has the words that aren't hot."""
    wide = deal.wide
    context, place = np.minimum(key & ((1 << deal.bits) - 1), wide - 1), key >> deal.bits
    hot = place < deal.places
    sums = np.concatenate([
        np.bincount(context, count, wide), np.bincount(context, tables, wide), np.bincount(place[hot], count[hot], deal.places), np.bincount(place[hot], tables[hot], deal.places),
    ]).round().astype("<i8")
    n = np.bincount(place[~hot] - deal.places, tables[~hot], len(words)).round()
    facts = np.zeros(_N_FACTS, np.int64)
    facts[:_LEVELS] = len(words), (count == 1).sum(), (count == 2).sum(), (n == 1).sum(), (n == 2).sum(), parent.sum()
    facts[_LEVELS:] = np.bincount(level(count[hot]), minlength=_N_LEVELS)
    low, high = _pack_keys(key)
    return {
        "bucket": pa.array([bucket], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "low": pa.array([low], pa.binary()), "high": [high], "count": [_pack(count.astype("<u8"))],
        "tables": [_pack(tables.astype("<u8"))], "parent": [_pack(parent.astype("<u8"))], "kept": pa.array([kept], pa.list_(pa.binary())), "kept_parent": pa.array([kept_parent], pa.list_(pa.binary())),
        "also": pa.array([also], pa.list_(pa.binary())), "kept_rare": pa.array([kept_rare], pa.list_(pa.binary())),
        "sums": [_pack(sums)], "facts": pa.array([facts.tolist()], pa.list_(pa.int64())),
    }


def gathered(counts: DataFrame, deal: Deal) -> DataFrame:
    """The state of each bucket: all its pairs with their counts, each pair at one table and each word at one of the parent's."""
    shared = counts.sparkSession.sparkContext.broadcast(deal)

    def merge(table: pa.Table) -> pa.Table:
        deal = shared.value
        parts = [_read_counts(r) for r in table.to_pylist()]
        words, keys = _joined(deal, [(w, k) for w, k, _ in parts])
        key, count = _summed(np.concatenate(keys), np.concatenate([c for _, _, c in parts]))
        asked = deal.asked(key)
        key, count = key[count > 0], count[count > 0]
        also = np.setdiff1d(asked, deal.asked(key), assume_unique=True)
        place = key >> deal.bits
        used = np.zeros(len(words), bool)
        used[place[place >= deal.places] - deal.places] = True
        gone = np.cumsum(~used)  # words that only held-out tokens have
        own = place >= deal.places
        key[own] -= gone[place[own] - deal.places] << deal.bits
        words = words[used]
        return pa.Table.from_pydict(_state(deal, table["bucket"][0].as_py(), words, key, count, np.ones(len(key), np.int64), np.ones(len(words), np.int64), [], [], [*_pack_keys(also)], []), schema=_SCHEMA)

    return counts.groupBy("bucket").applyInArrow(common.lean(merge), STATE)


_KINDS = {"int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in STATE.split(", ")])


ASKED = "group int, bucket int, contexts_low binary, contexts_high binary, customers binary, tables binary"
ANSWERS = "bucket int, group int, customers binary, tables binary"


def asked(state: DataFrame, deal: Deal) -> DataFrame:
    """A row for each bucket and group of contexts without a number: the contexts that the bucket asks for, and its customers and tables in each."""
    shared = state.sparkSession.sparkContext.broadcast(deal)

    def task(batches):
        deal = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                _, key, count = _read_counts(row)
                ask = _asked(deal, key, row["also"])
                context = key & ((1 << deal.bits) - 1)
                rare = np.flatnonzero(context >= deal.wide)
                at = np.searchsorted(ask, context[rare])
                sums = [np.bincount(at, x[rare], len(ask)).round().astype(np.int64) for x in (count, _unpack(row["tables"], "<u8").astype(np.int64))]
                half = int(deal.bits) - 1
                group = ((ask - (1 << half)) >> max(0, half - 32)) * deal.groups >> min(half, 32)  # it grows with the context
                first = _groups(group)
                rows = []
                for a, b in zip(first.tolist(), [*first[1:].tolist(), len(ask)], strict=False):
                    rows.append((int(group[a]), row["bucket"], *_pack_keys(ask[a:b]), _pack_counts(sums[0][a:b]), _pack_counts(sums[1][a:b])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _ASKED, strict=True)], names=[x.split()[0] for x in ASKED.split(", ")])

    return state.select("bucket", "words", "low", "high", "count", "tables", "also").mapInArrow(common.lean(task), ASKED)


_ASKED = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _asked(deal: Deal, key: np.ndarray, also: list) -> np.ndarray:
    """The contexts without a number that a bucket needs, in order."""
    return wordbatch.ordered_set(np.concatenate([deal.asked(key), _unpack_keys(*also)]))


def answered(asked: DataFrame) -> DataFrame:
    """For each row of ``asked`` the customers and tables that its contexts have in all buckets. No bucket asks twice for a context, so groups are as even as the hash."""

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpack_keys(r["contexts_low"], r["contexts_high"]) for r in rows]
        some, place = np.unique(np.concatenate(parts), return_inverse=True)
        edge = np.cumsum([0, *map(len, parts)])
        out = {"bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "group": pa.array([r["group"] for r in rows], pa.int32())}
        for name in ("customers", "tables"):
            sums = np.bincount(place, np.concatenate([_unpack_counts(r[name]) for r in rows]), len(some)).round().astype(np.int64)[place]
            out[name] = pa.array([_pack_counts(sums[a:b]) for a, b in zip(edge, edge[1:], strict=False)], pa.binary())
        return pa.Table.from_pydict(out)

    return asked.groupBy("group").applyInArrow(common.lean(add), ANSWERS)


def _read_answers(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of the contexts that a bucket has asked for, in their order."""
    rows = sorted(rows, key=lambda r: r["group"])
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate([*(_unpack_counts(r[name]) for r in rows), *none]) for name in ("customers", "tables"))


def swept(state: DataFrame, deal: Deal, totals: Totals, sweep: int, keep: bool, seed: int = 1, exact: int = EXACT) -> DataFrame:
    """One Gibbs sweep over all buckets."""
    shared = state.sparkSession.sparkContext.broadcast((deal, totals))  # two numbers for each numbered context and hot word

    def task(bucket: pa.Table, replies: pa.Table) -> pa.Table:
        deal, now = shared.value
        _, rare_tables = _read_answers(replies.to_pylist())
        out = []
        for row in bucket.to_pylist():
            words, key, count = _read_counts(row)
            tables, parent = _unpack(row["tables"], "<u8").astype(np.int64), _unpack(row["parent"], "<u8").astype(np.int64)
            draw = np.random.default_rng([seed, sweep, row["bucket"]])
            place, context = key >> deal.bits, key & ((1 << deal.bits) - 1)
            own = np.flatnonzero(place >= deal.places)
            hot = np.flatnonzero(place < deal.places)
            at_parent = np.empty(len(key), np.int64)  # the dish's customers and tables at the parent
            seats = np.empty(len(key), np.int64)
            mine = place[own] - deal.places
            at_parent[own], seats[own] = np.bincount(mine, tables[own], len(words)).astype(np.int64)[mine], parent[mine]
            at_parent[hot], seats[hot] = now.hot_customers[place[hot]], now.hot_parent[place[hot]]
            many = np.flatnonzero(count > 1)
            all_tables = now.tables[np.minimum(context[many], deal.wide - 1)]
            rare = np.flatnonzero(context[many] >= deal.wide)
            all_tables[rare] = rare_tables[np.searchsorted(_asked(deal, key, row["also"]), context[many[rare]])]
            left = np.maximum(at_parent[many] - tables[many], 0)  # without this context's
            base = now.parent_probability(left, np.minimum(seats[many], left))
            tables[many] = reseat(count[many], all_tables - tables[many], now.discount[1], STRENGTH[1], base, draw, exact)
            customers = np.bincount(mine, tables[own], len(words)).astype(np.int64)
            parent = reseat(customers, now.parent_tables - parent, now.discount[0], STRENGTH[0], now.base, draw, exact)
            kept = [*row["kept"], _pack(tables.astype("<u4"))] if keep else row["kept"]
            kept_parent = [*row["kept_parent"], _pack(np.column_stack([customers, parent]).astype("<u4"))] if keep else row["kept_parent"]
            kept_rare = [*row["kept_rare"], _pack_counts(rare_tables)] if row["kept"] else []  # of the seating before
            out.append(pa.Table.from_pydict(_state(deal, row["bucket"], words, key, count, tables, parent, kept, kept_parent, row["also"], kept_rare), schema=_SCHEMA))
        return pa.concat_tables(out) if out else _SCHEMA.empty_table()

    answers = answered(asked(state, deal))
    return state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(common.lean(task), STATE)


def _totals(state: DataFrame, deal: Deal, seed: int, exact: int) -> Totals:
    """Sums over all buckets, 32 at a time, so that no task and not the driver holds many."""
    rows, many = state.select("bucket", "sums", "facts"), deal.buckets

    def add(table: pa.Table) -> pa.Table:
        sums = sum(_unpack(x, "<i8") for x in table["sums"].to_pylist())
        facts = np.array(table["facts"].to_pylist()).sum(axis=0)
        return pa.Table.from_pydict({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "sums": [_pack(sums)], "facts": pa.array([facts.tolist()], pa.list_(pa.int64()))})

    while many > 32:
        many = -(-many // 32)
        rows = rows.withColumn("bucket", F.floor(F.col("bucket") / 32).cast("int")).groupBy("bucket").applyInArrow(add, "bucket int, sums binary, facts array<long>")
    wide = deal.wide
    sums, facts = np.zeros(2 * wide + 2 * deal.places, np.int64), np.zeros(_N_FACTS, np.int64)
    for r in rows.select("sums", "facts").toLocalIterator():  # 32 rows
        sums += _unpack(r["sums"], "<i8")
        facts += np.array(r["facts"])
    customers, tables, hot_counts, hot_customers = np.split(sums, [wide, 2 * wide, 2 * wide + deal.places])
    words, one, two, single, double, parent = facts[:_LEVELS].tolist()
    rate = lambda a, b: min(0.95, max(0.05, (a + 0.5) / (a + 2 * b + 1)))
    there = hot_counts > 0
    words += int(there.sum())
    single, double = single + int((hot_customers == 1).sum()), double + int((hot_customers == 2).sum())
    discount = (rate(single, double), rate(one, two))
    # The parent's tables of hot words; twice, as each needs the others'.
    hot_parent = np.minimum(hot_customers, 1)
    for turn in range(2):
        draw = np.random.default_rng([seed, turn, int(tables.sum())])
        others = parent + hot_parent.sum() - hot_parent
        hot_parent = np.where(there, reseat(np.maximum(hot_customers, 0), others, discount[0], STRENGTH[0], 1 / (words + 1), draw, exact), 0)
    return Totals(customers, tables, hot_counts, hot_customers, hot_parent, words, discount, parent + int(hot_parent.sum()), facts[_LEVELS:])


@dataclass
class Fitted:
    state: DataFrame
    samples: list[Totals]
    deal: Deal

    @property
    def last(self) -> Totals:
        return self.samples[-1]


def common_words(docs: DataFrame, rows: int, most: int) -> np.ndarray:
    """Hashes of the most common tokens of about SAMPLE texts, the most common one first."""

    def make():
        def work(batch):
            word, _ = _words(common.text_bytes(batch))
            words, count = np.unique(word, return_counts=True)
            return {"word": pa.array(words.view(np.int64)), "count": pa.array(count)}

        return work

    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, rows // SAMPLE))) == 0)
    found = common.map_steps(some, make, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))
    return found.orderBy(F.desc("count"), "word").limit(most).toArrow()["word"].to_numpy().view(np.uint64)


def dealing(docs: DataFrame) -> Deal:
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    wide = 1 << min(BITS[0], BITS[1] - 1)
    words = common_words(docs, rows, max(HOT, wide - 2))
    return Deal(Bits(BITS[1], np.sort(words[: wide - 2])), buckets, np.sort(words[:HOT]), HOT, -(-buckets // FAN), wide)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is written inside leaves no shuffle files behind."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fit(docs: DataFrame, seed: int = 1, exact: int = EXACT) -> Fitted:
    """Counts, seats and keeps KEPT seatings for the training rows of ``docs`` (doc_id, text)."""
    deal = dealing(docs)
    with _shuffles_dropped(docs.sparkSession):
        state = common.written(gathered(counted(docs, deal), deal), "seats")
    totals, samples = _totals(state, deal, seed, exact), []
    for sweep in range(BURN + KEPT):
        with _shuffles_dropped(docs.sparkSession):
            after = common.written(swept(state, deal, totals, sweep, sweep >= BURN, seed, exact), "seats")
        common.forget(state)
        state, totals = after, _totals(after, deal, seed, exact)
        if sweep >= BURN:
            samples.append(totals)
    return Fitted(state, samples, deal)


class Bucket:
    """A bucket's pairs, ready to give predictive probabilities; without a row it knows no word."""

    def __init__(self, deal: Deal, samples: list[Totals], row: dict | None, answers: list[dict] = ()):
        self.deal, self.samples = deal, samples
        self.hot = [s.parent_probability(s.hot_customers, s.hot_parent) for s in samples]
        self.hot_counts = samples[-1].hot_counts
        self.words, self.key, self.count = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) if row is None else _read_counts(row)
        self.tables = [_unpack(x, "<u4").astype(np.int64) for x in row["kept"]] if row else [self.count for _ in samples]
        seats = [_unpack(x, "<u4").reshape(-1, 2).astype(np.int64) for x in row["kept_parent"]] if row else [np.zeros((0, 2), np.int64) for _ in samples]
        self.parents = [s.parent_probability(p[:, 0], p[:, 1]) for s, p in zip(samples, seats, strict=True)]
        place = self.key >> deal.bits
        self.asked = _asked(deal, self.key, row["also"]) if row and answers else self.key[:0]
        self.rare_customers, last = _read_answers(answers)
        self.rare_tables = [*(_unpack_counts(x) for x in row["kept_rare"]), last] if row and answers else [last for _ in samples]
        self.total = np.bincount(place[place >= deal.places] - deal.places, self.count[place >= deal.places], len(self.words)).round().astype(np.int64)

    def scores(self, words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of the word, log10 probability) of each key; ``words``: the keys' own."""
        bits, places = self.deal.bits, self.deal.places
        place, context = key >> bits, key & ((1 << bits) - 1)
        at = np.minimum(np.searchsorted(self.words, words), max(len(self.words) - 1, 0))
        known = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        own = np.flatnonzero(place >= places)
        mine = place[own] - places
        seen = np.empty(len(key), np.int64)
        hot = np.flatnonzero(place < places)
        seen[hot] = self.hot_counts[place[hot]]
        seen[own] = np.where(known, self.total[at], 0)[mine] if len(self.words) else 0
        asked = key.copy()
        asked[own] = np.where(known[mine], ((places + at[mine]) << bits) | context[own], -1)
        found = np.minimum(np.searchsorted(self.key, asked), max(len(self.key) - 1, 0))
        there = self.key[found] == asked if len(self.key) else np.zeros(len(key), bool)
        count = np.where(there, self.count[found], 0) if len(self.key) else np.zeros(len(key), np.int64)
        number = np.minimum(context, self.deal.wide - 1)
        rare = np.flatnonzero(context >= self.deal.wide)
        at_rare = np.searchsorted(self.asked, context[rare])
        total = np.zeros(len(key))
        for s, tables, parents, of_hot, rare_tables in zip(self.samples, self.tables, self.parents, self.hot, self.rare_tables, strict=True):
            above = np.full(len(key), s.parent_probability(0, 0))
            above[hot] = np.where(seen[hot] > 0, of_hot[place[hot]], above[hot])
            above[own[known[mine]]] = parents[at[mine[known[mine]]]] if len(self.words) else 0
            customers, all_tables = s.customers[number], s.tables[number]
            customers[rare], all_tables[rare] = self.rare_customers[at_rare], rare_tables[at_rare]
            total += s.served(count, np.where(there, tables[found], 0) if len(self.key) else 0, customers, all_tables, above)
        return seen, np.log10(total / len(self.samples))


def common_pairs(fitted: Fitted) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, log10 probability) of the most common pairs of hot words in numbered contexts: PAIRS at most."""
    above = np.cumsum(fitted.last.levels[::-1])[::-1]
    least = int(np.argmax(above <= PAIRS)) if (above <= PAIRS).any() else _N_LEVELS
    shared = fitted.state.sparkSession.sparkContext.broadcast((fitted.deal, fitted.samples))

    def task(batches):
        deal, samples = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                bucket = Bucket(deal, samples, row)
                key = bucket.key[(bucket.key >> deal.bits < deal.places) & (bucket.key & ((1 << deal.bits) - 1) < deal.wide) & (level(bucket.count) >= least)]
                if len(key):
                    _, score = bucket.scores(np.zeros(0, np.uint64), key)
                    yield pa.RecordBatch.from_pydict({"key": pa.array(key), "score": pa.array(score, pa.float32())})

    rows = fitted.state.select("bucket", "words", "low", "high", "count", "kept", "kept_parent", "also", "kept_rare").mapInArrow(common.lean(task), "key long, score float").toArrow()
    key, score = rows["key"].to_numpy(), rows["score"].to_numpy()
    order = np.argsort(key)
    return key[order], score[order]


PARTS = "to long, bucket int, docs binary, chunk binary, doc binary, words binary, low binary, high binary, place binary"


def _part(to: int, bucket: int, docs=None, chunk=None, doc=None, words=None, low=None, high=None, place=None) -> pa.RecordBatch:
    blobs = {"docs": docs, "chunk": chunk, "doc": doc, "words": words, "low": low, "high": high, "place": place}
    return pa.RecordBatch.from_pydict({"to": pa.array([to], pa.int64()), "bucket": pa.array([bucket], pa.int32())} | {k: pa.array([v], pa.binary()) for k, v in blobs.items()})


def _tokens_row(to: int, bucket: int, words: np.ndarray, key: np.ndarray, chunk: np.ndarray, doc: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Tokens of a bucket, and the documents they are of: chunk (one for all, or for each) and place in it. ``place``: of each token, among the documents given."""
    some, own = np.unique(place, return_inverse=True)
    low, high = _pack_keys(key)
    chunk = chunk if len(chunk) == 1 else chunk[some]
    narrow = "<u2" if len(some) <= 65536 else "<u4"
    return _part(to, bucket, None, chunk.astype("<i8").tobytes(), doc[some].astype("<u4").tobytes(), words.tobytes(), low, high, own.astype(narrow).tobytes())


def dealt(docs: DataFrame, table, fitted: Fitted) -> DataFrame:
    """Of each chunk of documents: one row with their sums over common pairs, and a row for each bucket with the other tokens."""
    totals = fitted.last
    denominator = float(np.log10(totals.customers.sum() + totals.words + 1))
    shared = docs.sparkSession.sparkContext.broadcast((fitted.deal, *table, np.log10(totals.hot_counts + 1.0) - denominator))

    def task(batches):
        from pyspark import TaskContext

        deal, keys, scores, base_of = shared.value
        chunk = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[Piece] = []
        size = 0

        def flush():
            nonlocal chunk
            common.give_back()
            sums = np.zeros((5, len(ids)))
            every = np.arange(len(ids))
            for bunch in _bunches(held, TOKENS):
                words, keys_of = deal.listed(bunch)
                of = np.concatenate([p.mark for p in bunch])
                sums[0] += np.bincount(of, minlength=len(ids))
                key, n = np.empty(len(of), np.int64), 0
                while bunch:
                    piece = bunch.pop(0)
                    key[n : n + len(piece.at)] = keys_of(piece)
                    n += len(piece.at)
                del piece, keys_of
                order = np.argsort(key, kind="stable")
                key, of = key[order], of[order]
                del order
                cut = int(np.searchsorted(key, deal.places << deal.bits))
                at = np.minimum(np.searchsorted(keys, key[:cut]), max(len(keys) - 1, 0))
                often = np.flatnonzero(keys[at] == key[:cut]) if len(keys) else np.zeros(0, np.int64)
                if len(often):
                    o = of[often]
                    sums[1] += np.bincount(o, minlength=len(ids))
                    sums[2] += np.bincount(o, base_of[key[often] >> deal.bits], len(ids))
                    sums[3] += np.bincount(o, scores[at[often]].astype(np.float64), len(ids))
                other = np.ones(len(key), bool)
                other[often] = False
                key, of = key[other], of[other]
                for b, own, at, mine in deal.pieces(words, key, 0, deal.buckets, deal.group):
                    yield _tokens_row(chunk, b, own, mine, np.array([chunk]), every, of[at])
            blob = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], "<i8").tobytes() + sums.tobytes()
            yield _part(chunk, chunk % deal.buckets // deal.group, docs=blob)
            chunk += 1

        for batch in batches:
            for part in common.steps(batch):
                for piece in pieces_of(common.text_bytes(part), deal.bits, TOKENS):
                    piece.mark += np.int32(len(ids))
                    held.append(piece)
                ids += part.column(0).to_pylist()
                size += part.nbytes
                if size >= CHUNK_BYTES:
                    yield from flush()
                    ids, held, size = [], [], 0
        if ids:
            yield from flush()

    rows = docs.mapInArrow(common.lean(task), PARTS)
    if fitted.deal.group == 1:
        return rows
    size = fitted.deal.group

    def again(batches):
        """Joins what groups of buckets have got from many chunks, and deals it to the buckets. Sums come back to a number of the joined rows' own, under 0."""
        from pyspark import TaskContext

        deal = shared.value[0]
        number = -1 - (TaskContext.get().partitionId() << 32)
        group, held, count = None, [], 0

        def flush():
            nonlocal number
            words, keys = _joined(deal, [(np.frombuffer(r["words"], np.uint64), _unpack_keys(r["low"], r["high"])) for r in held])
            docs = [np.frombuffer(r["doc"], "<u4") for r in held]
            chunk = np.concatenate([np.broadcast_to(np.frombuffer(r["chunk"], "<i8"), len(d)) for r, d in zip(held, docs, strict=True)])
            begin = np.cumsum([0, *map(len, docs)])
            place = np.concatenate([np.frombuffer(r["place"], "<u2" if len(r["place"]) == 2 * len(k) else "<u4").astype(np.int64) + b for r, k, b in zip(held, keys, begin, strict=False)])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.argsort(key, kind="stable")
            first = group * size
            for b, own, at, mine in deal.pieces(words, key[order], first, min(size, deal.buckets - first), 1):
                yield _tokens_row(number, b, own, mine, chunk, doc, place[order][at])
            number -= 1

        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"] is not None:
                    yield _part(row["to"], row["to"] % deal.buckets, docs=row["docs"])
                    continue
                if held and (row["bucket"] != group or count >= TOKENS):
                    yield from flush()
                    held, count = [], 0
                group = row["bucket"]
                held.append(row)
                count += len(row["low"]) // 2
        if held:
            yield from flush()

    salt = F.pmod(F.xxhash64("to"), F.lit(max(1, size // 4)))
    return rows.withColumn("salt", salt).repartition("bucket", "salt").sortWithinPartitions("bucket").drop("salt").mapInArrow(common.lean(again), PARTS)


SUMS = "to long, docs binary, chunk binary, doc binary, known binary, base binary, score binary"


def scored(docs: DataFrame, seed: int = 1, exact: int = EXACT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""
    common.prepare(docs.sparkSession)
    texts = common.doc_texts(docs)
    fitted = fit(texts, seed, exact)
    last = fitted.last
    shared = docs.sparkSession.sparkContext.broadcast((fitted.deal, fitted.samples))
    total = int(last.customers.sum())
    denominator = float(np.log10(total + last.words + 1))
    parts = dealt(texts, common_pairs(fitted), fitted)
    state = fitted.state.select("bucket", "words", "low", "high", "count", "kept", "kept_parent", "also", "kept_rare")
    answers = answered(asked(fitted.state, fitted.deal))
    blank = [F.lit(None).cast("binary").alias(c) for c in ("docs", "chunk", "doc", "words")]
    parts = parts.unionByName(answers.select(F.col("group").cast("long").alias("to"), "bucket", *blank, F.col("customers").alias("low"), F.col("tables").alias("high"), F.lit(None).cast("binary").alias("place")))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over a bucket's tokens for each chunk; rows with documents go on as they are."""
        deal, samples = shared.value
        out: dict[str, list] = {x.split()[0]: [] for x in SUMS.split(", ")}
        is_answer = pc.and_(pc.is_null(right["docs"]), pc.is_null(right["place"]))
        answers = [{"group": r["to"], "customers": r["low"], "tables": r["high"]} for r in right.filter(is_answer).select(["to", "low", "high"]).to_pylist()]
        right = right.filter(pc.invert(is_answer))
        bucket = Bucket(deal, samples, left.to_pylist()[0] if left.num_rows else None, answers)
        for batch in right.to_batches(max_chunksize=64):
            for r in batch.to_pylist():
                if r["docs"] is not None:
                    values = (r["docs"], None, None, None, None, None)
                else:
                    key = _unpack_keys(r["low"], r["high"])
                    seen, score = bucket.scores(np.frombuffer(r["words"], np.uint64), key)
                    place = np.frombuffer(r["place"], "<u2" if len(r["place"]) == 2 * len(key) else "<u4").astype(np.int64)
                    n, base = len(r["doc"]) // 4, np.log10(seen + 1.0) - denominator
                    values = (None, r["chunk"], r["doc"], np.bincount(place, seen > 0, n).astype("<u4").tobytes(), np.bincount(place, base, n).tobytes(), np.bincount(place, score, n).astype("<f4").tobytes())
                out["to"].append(r["to"])
                for name, value in zip(list(out)[1:], values, strict=True):
                    out[name].append(value)
        return pa.Table.from_pydict({k: pa.array(v, pa.int64() if k == "to" else pa.binary()) for k, v in out.items()})

    partial = state.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(common.lean(match), SUMS)

    def gather(table: pa.Table) -> pa.Table:
        """Of rows of several chunks, from several buckets, one row for each chunk; others stay."""
        rows = [r for r in table.to_pylist() if r["docs"] is None]
        if not rows or table["to"][0].as_py() >= 0:
            return table
        docs = [np.frombuffer(r["doc"], "<u4").astype(np.int64) for r in rows]
        chunk = np.concatenate([np.broadcast_to(np.frombuffer(r["chunk"], "<i8"), len(d)) for r, d in zip(rows, docs, strict=True)])
        doc = np.concatenate(docs)
        order = np.lexsort((doc, chunk))
        chunk, doc = chunk[order], doc[order]
        first = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (doc[1:] != doc[:-1])])
        sums = [np.add.reduceat(np.concatenate([np.frombuffer(r[c], k) for r in rows]).astype(np.float64)[order], first) for c, k in (("known", "<u4"), ("base", "<f8"), ("score", "<f4"))]
        chunk, doc = chunk[first], doc[first]
        edge = np.append(_groups(chunk), len(chunk)).tolist()
        out = [
            (int(chunk[a]), None, chunk[a : a + 1].astype("<i8").tobytes(), doc[a:b].astype("<u4").tobytes(), sums[0][a:b].astype("<u4").tobytes(), sums[1][a:b].tobytes(), sums[2][a:b].astype("<f4").tobytes())
            for a, b in zip(edge, edge[1:], strict=False)
        ]
        return pa.Table.from_pydict({k: pa.array(v, t) for k, v, t in zip(table.column_names, zip(*out, strict=True), table.schema.types, strict=True)})

    if fitted.deal.group > 1:
        partial = partial.groupBy("to").applyInArrow(gather, SUMS)

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        blob = next(r["docs"] for r in rows if r["docs"] is not None)
        n = len(blob) // 56
        ids, null = np.frombuffer(blob, "<i8", 2 * n).reshape(2, n)
        sums = np.frombuffer(blob, np.float64, 5 * n, 16 * n).reshape(5, n).copy()
        for r in rows:
            if r["docs"] is None:
                at = np.frombuffer(r["doc"], "<u4")
                sums[1][at] += np.frombuffer(r["known"], "<u4")
                sums[2][at] += np.frombuffer(r["base"], np.float64)
                sums[3][at] += np.frombuffer(r["score"], "<f4")
        doc = [None if gone else i for i, gone in zip(ids.tolist(), null.tolist(), strict=True)]
        return pa.Table.from_pydict({
            "doc_id": pa.array(doc, pa.int64()), "held_out": [held_out(i) for i in doc], "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].round().astype(np.int64),
            "train_tokens": np.full(n, total, np.int64), "base_score": sums[2], "score": sums[3],
        })

    return partial.groupBy("to").applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, perplexity, base_perplexity, n_tokens: over the tokens of all texts."""
    power = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(power("score").alias("perplexity"), power("base_score").alias("base_perplexity"), F.sum("n_tokens").alias("n_tokens"))
