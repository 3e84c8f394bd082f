"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's features are the hashed words it holds, their first four and five bytes, their last
two and some indicators of shape (repetition, capitals, signs), each counted once.
One weight vector serves all grades:

    P(grade >= k) = sigmoid(w . x - threshold[k]),  threshold[1] <= threshold[2] <= ...

Weights are fitted by proximal AdaGrad with an L1 penalty: features that say
nothing keep weight zero, so that long texts do not gather noise. Selection is by
the tail probability of the best grade.

The fit takes at most ``sample`` labelled ids, the first by a hash of the id, one text for each (of texts that share an id the
smallest by digest), and of these so many as have IDS features together: the documented bounds of what
comes to the driver. Features are made and stored by the executors. Every document is scored, over its whole text.

Null text counts as empty; such a text has no features and gets the thresholds' own
probabilities. With no labels, or labels of one grade only, the thresholds follow the
observed shares and weights stay zero. Null labels are left out; an id that is
labelled more than once counts with its lowest grade.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, wordbatch

SAMPLE = 12_000
#: Features of the sample that the driver holds at most, four bytes each.
IDS = 40_000_000
BITS = 20
GRADES = 3
#: A text is selected if the best grade has this probability.
KEEP = 0.6
#: Features of the sample that a step of the fit works on at once.
BLOCK = 1 << 20

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True


@dataclass
class Model:
    weights: np.ndarray  # float32, 2**BITS
    thresholds: np.ndarray  # GRADES - 1, ascending


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature id) of every distinct feature of each text, sorted by text."""
    words = wordbatch.split(texts)
    start, end, owner = words.start, words.end, words.owner
    whole = words.hashes()
    parts = [(whole, owner)]
    for n, salt in ((4, 11), (5, 12)):
        parts.append((wordbatch.mix(wordbatch.span_hashes(words.data, start, np.minimum(end, start + n)) + np.uint64(salt)), owner))
    parts.append((wordbatch.mix(wordbatch.span_hashes(words.data, np.maximum(start, end - 2), end) + np.uint64(13)), owner))
    n = np.maximum(words.per_text(), 1)
    same = np.zeros(len(whole), bool)
    same[1:] = (whole[1:] == whole[:-1]) & (owner[1:] == owner[:-1])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.cumsum(lengths) - lengths
    capital = np.add.reduceat((raw >= 65) & (raw <= 90), first, dtype=np.int64) if len(texts) else np.zeros(0)
    sign = np.add.reduceat(_SIGNS[raw], first, dtype=np.int64) if len(texts) else np.zeros(0)
    shapes = (np.bincount(owner[same], minlength=len(texts)) / n, capital / lengths, sign / lengths, np.log2(n) / 16)
    for k, share in enumerate(shapes):
        level = np.minimum(np.asarray(share) * 8, 7).astype(np.uint64)
        parts.append((wordbatch.mix(level + np.uint64(1000 * (k + 1))), np.arange(len(texts))))
    ids = np.concatenate([x for x, _ in parts]) & np.uint64((1 << BITS) - 1)
    pairs = wordbatch.ordered_set((np.concatenate([x for _, x in parts]).astype(np.uint64) << np.uint64(BITS)) | ids)
    return (pairs >> np.uint64(BITS)).astype(np.int64), (pairs & np.uint64((1 << BITS) - 1)).astype(np.int64)


def fit(rows: list[np.ndarray], grades: np.ndarray, rounds: int = 100, rate: float = 0.1, strength: float = 0.06) -> Model:
    """Proximal AdaGrad on the mean negative log likelihood plus a penalty times the weights' absolute sum.

    The penalty is ``strength`` over the square root of the number of rows, as the noise of the mean is.
    """
    penalty = strength / np.sqrt(max(len(rows), 1))
    weights = np.zeros(1 << BITS, np.float64)
    total = max(len(grades), 1)
    at_least = np.array([(np.sum(grades >= k) + 0.5) / (total + 1) for k in range(1, GRADES)])
    thresholds = -np.log(at_least / (1 - at_least))
    thresholds = np.maximum.accumulate(thresholds)
    if len(np.unique(grades)) < 2:
        return Model(weights.astype(np.float32), thresholds)
    # Only features that occur have weights; they are held by row and by feature, and sums run over either in order.
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    there = np.zeros(1 << BITS, bool)
    for r in rows:
        there[r] = True
    found, number = np.flatnonzero(there), (np.cumsum(there) - 1).astype(np.uint32)
    place = np.empty(int(lengths.sum()), np.uint32)
    at = 0
    for r in rows:
        place[at : at + len(r)] = number[r]
        at += len(r)
    by_row = _cut(place, lengths)
    by_feature = _cut(_owners(place, lengths, len(found)), np.bincount(place, minlength=len(found)))
    small = np.zeros(len(found))
    squares, threshold_squares = np.full(len(found), 1e-10), np.full(GRADES - 1, 1e-10)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    every = np.arange(len(rows))
    for _ in range(rounds):
        score = _sums(by_row, small)
        tail = np.column_stack([np.ones(len(rows)), *(sigmoid(score - t) for t in thresholds), np.zeros(len(rows))])
        here = np.maximum(tail[every, grades] - tail[every, grades + 1], 1e-12)
        slope = tail * (1 - tail)
        by_score = -(slope[every, grades] - slope[every, grades + 1]) / here / len(rows)
        gradient = _sums(by_feature, by_score)
        squares += gradient**2
        pace = rate / np.sqrt(squares)
        small -= pace * gradient
        small = np.sign(small) * np.maximum(np.abs(small) - pace * penalty, 0)
        for k in range(1, GRADES):
            g = (np.sum(slope[grades == k, k] / here[grades == k]) - np.sum(slope[grades == k - 1, k] / here[grades == k - 1])) / len(rows)
            threshold_squares[k - 1] += g**2
            thresholds[k - 1] -= rate / np.sqrt(threshold_squares[k - 1]) * g
        thresholds = np.maximum.accumulate(thresholds)
    weights[found] = small
    return Model(weights.astype(np.float32), thresholds)


def _owners(place: np.ndarray, lengths: np.ndarray, many: int) -> np.ndarray:
    """The rows that hold each feature, feature by feature: a counting sort, BLOCK places at a time."""
    count = np.bincount(place, minlength=many)
    free = np.cumsum(count) - count
    small = np.uint16 if len(lengths) < 1 << 16 else np.uint32
    out, ends = np.empty(len(place), small), np.cumsum(lengths)
    for low in range(0, len(place), BLOCK):
        part = place[low : low + BLOCK]
        order = np.argsort(part, kind="stable")
        part = part[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        n = np.diff(np.r_[first, len(part)])
        to = np.arange(len(part)) - np.repeat(first, n) + free[part]
        out[to] = np.searchsorted(ends, low + order, side="right").astype(small)
        free[part[first]] += n
    return out


def _cut(index: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, lengths) of runs of groups, about BLOCK indices at a time."""
    ends = np.cumsum(lengths)
    edges = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BLOCK, int(ends[-1]) + BLOCK, BLOCK)) + 1, len(lengths)].clip(max=len(lengths)))
    return [(index[(ends[a - 1] if a else 0) : ends[b - 1]], lengths[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def _sums(cut: list[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """The sum of values[index] of each group."""
    out = []
    for index, lengths in cut:
        total = np.zeros(len(lengths))
        some = lengths > 0
        if some.any():
            total[some] = np.add.reduceat(values[index], (np.cumsum(lengths) - lengths)[some])
        out.append(total)
    return np.concatenate(out)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 toxic, 1 poor, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model to at most ``sample`` ids of ``ratings`` (doc_id, grade) that have a document, and to at most IDS features."""
    common.prepare(docs.sparkSession)
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = common.doc_texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by ``sample``
    picked = common.written(labelled.select("doc_id", "grade", F.md5(F.col("text").cast("binary")).alias("key"), "text"), "quality-sample")
    first = picked.groupBy("doc_id").agg(F.min("key").alias("key"))
    texts = picked.join(F.broadcast(first), ["doc_id", "key"]).select("doc_id", "grade", "text")  # ``sample`` rows again

    def make():
        def work(batch):
            owner, ids = features(common.text_bytes(batch))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            blobs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            return {"doc_id": batch.column(0), "grade": batch.column(1), "ids": pa.array(blobs, pa.binary())}

        return work

    made = common.written(common.map_steps(texts, make, "doc_id long, grade int, ids binary").dropDuplicates(["doc_id"]).withColumn("place", F.xxhash64("doc_id")), "quality-features")
    sizes = made.select("place", "doc_id", (F.length("ids") / 4).cast("long").alias("n")).orderBy("place", "doc_id").toArrow()  # ``sample`` rows
    fits = int(np.searchsorted(np.cumsum(sizes["n"].to_numpy()), IDS, side="right"))
    if fits < sizes.num_rows:
        made = made.where((F.col("place") < sizes["place"][fits].as_py()) | ((F.col("place") == sizes["place"][fits].as_py()) & (F.col("doc_id") < sizes["doc_id"][fits].as_py())))
    table = made.select("doc_id", "grade", "ids").toArrow()
    order = np.argsort(table["doc_id"].to_numpy())
    rows = [np.frombuffer(x.as_buffer(), "<u4") if len(x.as_buffer()) else np.zeros(0, "<u4") for x in table["ids"]]  # where they lie in the table
    model = fit([rows[k] for k in order.tolist()], table["grade"].to_numpy()[order].astype(np.int64))
    common.forget(picked)
    common.forget(made)
    return model


def probabilities(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(score, P(grade >= 1..)) of each text."""
    owner, ids = features(texts)
    score = np.bincount(owner, model.weights[ids].astype(np.float64), minlength=len(texts))
    return score, 1 / (1 + np.exp(-np.clip(score[:, None] - model.thresholds[None, :], -40, 40)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, expected_grade, p_poor_or_better, p_good of each row, from its whole text."""
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)  # fixed size: 2**BITS weights

    def make():
        def work(batch):
            score, tail = probabilities(shared.value, common.text_bytes(batch))
            return {"doc_id": batch.column(0), "score": score, "expected_grade": tail.sum(axis=1), "p_poor_or_better": tail[:, 0], "p_good": tail[:, -1]}

        return work

    return common.map_steps(common.doc_texts(docs), make, "doc_id long, score double, expected_grade double, p_poor_or_better double, p_good double")


def selected(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, whose tail probability of the best grade is ``least`` or more."""
    shared = common.prepare(docs.sparkSession).sparkContext.broadcast(model)

    def make():
        def work(batch):
            _, tail = probabilities(shared.value, common.text_bytes(batch))
            return batch.filter(pa.array(tail[:, -1] >= least))

        return work

    return common.map_steps(docs, make, docs.schema)
