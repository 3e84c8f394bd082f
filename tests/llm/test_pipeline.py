import re

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import common, linededup, pii, quality, queries, wordbatch
from tests.llm.test_lines_and_packing import _brute_lines, _check_pieces
from tests.llm.test_models import _patterns, _plain_features, _viterbi
from tests.conftest import SMALL

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "pii", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == columns
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    quality = kept["quality_classifier"]
    good = [i for i, x in labels.items() if x["quality"] == 1 and not x["toxic"]]
    bad = [i for i, x in labels.items() if x["quality"] == 0 or x["toxic"]]
    assert sum(i in quality for i in good) >= 0.99 * len(good) and sum(i in quality for i in bad) <= 0.25 * len(bad)
    assert all(quality[i] == before[i] for i in quality)
    lines = kept["line_dedup"]
    assert lines.keys() == quality.keys() and any(lines[i] != quality[i] for i in lines)
    near = kept["simhash_near_dedup"]
    groups = {}
    for i, t in sorted(lines.items()):
        groups.setdefault(t, i)
    assert set(near) <= set(groups.values()) and len(near) > 0.7 * len(lines)
    assert kept["pii"].keys() == near.keys()
    assert not any(pii.base_spans(t) for t in kept["pii"].values())
    strip = lambda t: re.sub(r"\[[A-Z]+\]", "", t)
    changed = [i for i in near if kept["pii"][i] != near[i]]
    assert changed and all(len(strip(kept["pii"][i])) < len(near[i]) for i in changed)


def test_run_packs_all(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    total = rows.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count()
    assert total == 0 and rows.count() > 0
    assert queries.pipeline(spark, SMALL).columns == rows.columns


def test_odd_and_empty_tables(spark, odd, nothing):
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = docs.columns
            docs = common.written(stage(spark, docs, SMALL), name)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()


def test_names_that_stages_use_themselves(spark):
    names = ["id", "text_key", "n", "stays", "first", "component", "digest", "place", "bad_0", "bad_id_0", "n_removed", "__bad", "keep", "grade", "p_good", "spans", "bucket", "chunk", "salt", "size"]
    rows = [(k, "some words that are shared by all\nown words of text " + " ".join(f"w{k * j}" for j in range(30)), f"s{k}", *range(len(names))) for k in (1, 2, 3, 3)] + [(9, None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        if name != "quality_classifier":  # made-up words are no good text
            docs = common.written(stage(spark, docs, SMALL), name)
        else:
            stage(spark, docs, SMALL).collect()
        assert docs.columns == columns and all(tuple(r)[3:] == tuple(range(len(names))) for r in docs.collect())
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2, 3, 9]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 4


def _plain_redaction(field, text):
    """Patterns as they are written, labels by Viterbi over all words, offsets by counting."""
    raw = text.encode()
    words = wordbatch.split([raw], lower=False)
    labels = _viterbi(field, words)
    spans, k = _patterns(text), 0
    base = list(spans)
    while k < len(labels):
        stop = k + 1
        while stop < len(labels) and labels[stop] == labels[k]:
            stop += 1
        if labels[k]:
            a, b = int(words.start[k]), int(words.end[stop - 1])
            while b > a and raw[b - 1 : b] in (b".", b",", b";", b":", b"!", b"?", b'"', b"'", b")", b"]"):
                b -= 1
            while a < b and raw[a : a + 1] in (b'"', b"'", b"(", b"["):
                a += 1
            x, y = len(raw[:a].decode()), len(raw[:b].decode())
            if a < b and not any(p <= x and y <= q for _, p, q in base):
                spans.append((pii.LABELS[labels[k]], x, y))
        k = stop
    return pii.redact(text, spans)


def _first_of_each(texts):
    """Ids that stay: of texts linked by a similarity of 0.8 the smallest."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small < 0.8 * large:
                continue
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i for i in texts if top(i) == i}


@pytest.mark.parametrize("folder", [SMALL, FOLDER])
def test_each_stage_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: (r["text"], r["source"]) for r in docs.collect()}
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    stage = dict(corpus_pipeline.STAGES)
    after = {}
    for name in list(stage)[:-1]:
        docs = common.written(stage[name](spark, docs, folder), name)
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}

    least = {}
    for i, (text, _) in rows.items():
        score = sum(float(model.weights[k]) for k in set(_plain_features(text)))
        least[i] = 1 / (1 + np.exp(model.thresholds[-1] - score))
    assert set(after["quality_classifier"]) == {i for i, p in least.items() if p >= quality.KEEP}

    kept = [(i, t, rows[i][1]) for i, t in after["quality_classifier"].items()]
    assert after["line_dedup"] == dict(_brute_lines(kept, linededup.SITES))

    stay = _first_of_each(after["line_dedup"])
    assert after["simhash_near_dedup"] == {i: after["line_dedup"][i] for i in stay} and len(stay) < len(after["line_dedup"])

    field = pii.train()
    assert after["pii"] == {i: _plain_redaction(field, t) for i, t in after["simhash_near_dedup"].items()}

    padding, tokens = _check_pieces(stage["packing"](spark, docs, folder).collect(), after["pii"])
    assert padding == 0 and tokens > 0
