import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from quarry.llm import ann, queries, simhash
from quarry.llm.components import components
from tests.conftest import SMALL


def _exact(rows, k=5, wanted=lambda i: True):
    ids = np.array([i for i, v in rows])
    x = np.array([v for _, v in rows], float)
    out = {}
    for q in range(len(ids)):
        if wanted(ids[q]):
            score = ann.cosine(x[q], x)
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
            out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def _found(df):
    out = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return dict(out)


def _recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_op4_recall(spark, folder):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got, want = _found(queries.op4_ivfpq(spark, folder)), _exact(rows, wanted=lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert _recall(got, want) >= 0.9
    exact = {(q, i): s for q, w in want.items() for i, s in w}
    assert all(abs(s - exact[q, i]) < 1e-12 for q, v in got.items() for i, s in v if (q, i) in exact)


def test_common_vector_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "UNIT", (100, 200))  # so that the common vector's cell is cut
    monkeypatch.setattr(ann, "QUERIES", 4)  # and units are copied
    draw = np.random.default_rng(3)
    same = draw.normal(size=8).tolist()
    rows = [(i, same if i % 3 == 0 else draw.normal(size=8).tolist()) for i in range(1500)]
    odd = [(5001, None), (5002, [0.0] * 8), (5003, [None, *[1.0] * 7]), (5004, [float("nan")] * 8), (5005, [float("inf"), *[1.0] * 7]), (5006, [1.0] * 9), (None, [1.0] * 8), (5050, [0.0] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in [*rows, *odd]], "vec_id long, embedding array<double>, cell int")
    got = _found(ann.search(df, df.where("vec_id % 50 = 0")))
    want = _exact(rows, wanted=lambda i: i % 50 == 0)
    assert got.keys() == want.keys() and _recall(got, want) >= 0.9
    assert got[0] == want[0] and [i for i, _ in got[0]] == [3, 6, 9, 12, 15]


def _shaped(kind, draw, n=2000, d=32):
    if kind == "uniform":
        return draw.normal(size=(n, d))
    centres = draw.normal(size=(40, d))
    clustered = centres[draw.integers(0, 40, n)] + draw.normal(size=(n, d)) * 0.02
    if kind == "mixed":
        clustered[: n // 3] = draw.normal(size=(n // 3, d))
    if kind == "outliers":
        clustered = np.concatenate([clustered, draw.normal(size=(40, d))])
    return clustered


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("kind", ["uniform", "clustered", "mixed", "outliers"])
def test_recall_of_the_final_five(spark, kind, seed):
    x = _shaped(kind, np.random.default_rng(seed))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = _found(ann.search(df, df.where("vec_id % 10 = 0"))), _exact(rows, wanted=lambda i: i % 10 == 0)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    assert _recall(got, want) >= 0.95


def test_two_levels_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "FLAT", 20)
    monkeypatch.setattr(ann, "PRODUCTS", 200)
    x = _shaped("mixed", np.random.default_rng(5), 4000, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = _found(ann.search(df, df.where("vec_id % 50 = 0"))), _exact(rows, wanted=lambda i: i % 50 == 0)
    assert _recall(got, want) >= 0.95
    assert ann.cells_for(10**8, 10**6) == 10**4 and ann.cells_for(10**12, 10**6) == ann.CELLS


def test_five_rows_although_cells_are_empty(spark):
    draw = np.random.default_rng(6)
    far = np.eye(16)[:10] * np.arange(1, 11)[:, None]  # each alone in its cell
    x = np.concatenate([draw.normal(size=(1, 16)) + draw.normal(size=(3000, 16)) * 0.01, far])
    rows = [(50 * i if i >= 3000 else 50 * i + 1, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[-1]] * 6  # an id that is repeated
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = _found(ann.search(df, df.where("vec_id % 50 = 0")))
    assert len(got) == 10 and all(len(v) == 5 for v in got.values())


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = _found(ann.search(df, df.where("vec_id % 50 = 0")))
    assert [i for i, _ in got[0]] == [3, 50] and [i for i, _ in got[50]] == [3, 0]
    assert ann.search(df.limit(0), df).count() == 0
    one = df.where("vec_id = 0")
    assert ann.search(one, one).count() == 0


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints, radius=3):
    ids = list(prints)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= radius:
                x, y = top(ids[a]), top(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_op9_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    prints = {i: _fingerprint(t) for i, t in docs.items()}
    want = _classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_pivots(spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in docs}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("tile, most", [(16, 16), (2048, 16), (8, 2), (4, 1)])
def test_large_groups_of_near_copies(spark, monkeypatch, tile, most):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "MOST_TILES", most)
    draw = random.Random(5)
    base = [draw.choice("abcdefghijklmnop") * draw.randint(1, 5) for _ in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(i % 3):
            words[draw.randrange(120)] = "z" * draw.randint(1, 9)
        texts.append((i, " ".join(words)))
    texts += [(1000 + i, " ".join(draw.choice("qrstuv") * draw.randint(1, 6) for _ in range(40))) for i in range(50)]
    want = _classes({i: _fingerprint(t) for i, t in texts})
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()} == want


def test_odd_and_empty(spark, odd, nothing):
    got = [(r["doc_id"], r["f"], r["component_id"]) for r in simhash.near_components(odd).select("doc_id", simhash.hex_print().alias("f"), "component_id").collect()]
    assert len(got) == odd.count()
    named = {i: c for i, f, c in got if i is not None}
    assert named[2] == named[3] == named[4] == named[9] == 2 and named[6] == 1 and {f for i, f, _ in got if i in (2, 3)} == {"0" * 16}
    assert simhash.near_components(nothing).count() == 0
    left = simhash.one_of_each(odd)
    assert left.columns == odd.columns and {r["doc_id"] for r in left.collect()} == {1, 2, 5, 7, 8, None}
    assert simhash.one_of_each(nothing).count() == 0


def _jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_similarity_form_finds_near_copies_and_leaves_others(spark):
    draw = random.Random(6)
    lexicon = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    rows, near, far = [], [], []
    for i in range(200):
        words = [draw.choice(lexicon) for _ in range(draw.choice([60, 200, 700]))]
        rows.append((3 * i, " ".join(words)))
        copy = list(words)
        for _ in range(max(1, len(words) // 90)):
            copy[draw.randrange(len(copy))] = "changed"
        rows.append((3 * i + 1, " ".join(copy)))
        mixed = words[: len(words) // 2] + [draw.choice(lexicon) for _ in range(len(words) // 2)]
        rows.append((3 * i + 2, " ".join(mixed)))
    by = dict(rows)
    near = [(3 * i, 3 * i + 1) for i in range(200) if _jaccard(by[3 * i], by[3 * i + 1]) >= 0.8]
    far = [(3 * i, 3 * i + 2) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity=0.8).collect()}
    assert len(near) > 150
    assert np.mean([got[a] == got[b] for a, b in near]) >= 0.97
    assert np.mean([got[a] == got[b] for a, b in far]) <= 0.02


def test_components_on_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000), (7, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("tile, most", [(8, 16), (1024, 16), (4, 1)])
def test_similarity_form_is_exact_at_the_threshold(spark, monkeypatch, tile, most):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "MOST_TILES", most)
    draw = random.Random(8)
    lexicon = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 8))) for _ in range(900)]
    texts = {}
    for g in range(12):
        base = [draw.choice(lexicon) for _ in range(150)]
        for k in range(40):
            words = list(base)
            for _ in range(k % 9):
                words[draw.randrange(150)] = f"new{draw.randrange(10**6)}"
            texts[100 * g + k] = " ".join(words)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 5, similarity=0.8).collect()}
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for g in range(12):
        for a in range(40):
            for b in range(a):
                x, y = 100 * g + a, 100 * g + b
                if _jaccard(texts[x], texts[y]) >= 0.8:
                    root[max(top(x), top(y))] = min(top(x), top(y))
    want = {i: top(i) for i in texts}
    assert 12 < len(set(want.values())) < 300
    assert got == want


def test_common_shingles_both_ways():
    draw = np.random.default_rng(4)
    sets = [np.unique(draw.integers(0, 300, draw.integers(0, 200))).astype("<u4").tobytes() for _ in range(60)]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    c = simhash.Common(sets)
    real = [set(np.frombuffer(x, "<u4").tolist()) for x in sets]
    want = [len(real[i] & real[j]) / len(real[i] | real[j]) if real[i] | real[j] else 1.0 for i, j in zip(a, b, strict=True)]
    assert np.allclose(c.pairs(a, b), want)
    assert np.allclose(np.concatenate([c.pairs(a[k : k + 100], b[k : k + 100]) for k in range(0, 3600, 100)]), want)


def test_equal_fingerprints_of_different_sets_do_not_link(spark):
    draw = random.Random(9)
    texts = [(i, " ".join([f"w{draw.randrange(10**9)}" for _ in range(100)] + ["again"] * 124)) for i in range(6)]
    texts.append((7, texts[2][1]))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(texts, "doc_id long, text string"), 5, similarity=0.8).collect()}
    assert got == {i: i for i in range(6)} | {7: 2}


def test_repeated_passages_do_not_part_near_copies(spark):
    draw = random.Random(10)
    rows = []
    for i in range(12):
        words = [f"w{draw.randrange(10**9)}" for _ in range(100)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + words[-10:] * 20))]
    assert all(_jaccard(rows[2 * i][1], rows[2 * i + 1][1]) == 0.96 for i in range(12))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity=0.8).collect()}
    assert got == {i: i - i % 2 for i in range(24)}


def test_no_link_at_the_threshold_is_lost(spark):
    draw = random.Random(11)
    rows, shapes = [], [(8, 1), (16, 3), (44, 10)]  # words, and words added at the end: a similarity of 0.8 each
    for i in range(450):
        words, more = shapes[i % 3]
        text = [f"w{draw.randrange(10**9)}" for _ in range(words + more)]
        rows += [(2 * i, " ".join(text[:words])), (2 * i + 1, " ".join(text))]
    assert all(_jaccard(rows[2 * i][1], rows[2 * i + 1][1]) == 0.8 for i in range(450))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, similarity=0.8).collect()}
    lost = [i for i in range(450) if got[2 * i + 1] != 2 * i]
    assert not lost, f"{len(lost)} of 450 lost"


def test_drops_are_by_row(spark):
    draw = random.Random(12)
    a, b, c, d = (" ".join(f"w{draw.randrange(10**9)}" for _ in range(40)) for _ in range(4))
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, c, "s"), (3, c, "s"), (3, c + " more", "s"), (None, a, "s"), (None, d, "s"), (None, d, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    third = min((c, c + " more"), key=lambda t: __import__("hashlib").md5(t.encode()).hexdigest())
    assert got == sorted([(1, a), (2, b), (3, third), (None, d)], key=repr)


def test_bound_leaves_no_link_out():
    draw = np.random.default_rng(5)
    kept = total = 0
    for n in (5, 40, 700):
        sets = []
        for _ in range(40):
            base = draw.integers(0, 2**63, n).astype(np.uint64)
            sets += [np.unique(base), np.unique(np.r_[base[: n - n // 9], draw.integers(0, 2**63, n // 9).astype(np.uint64)]), np.unique(np.r_[base[: n // 2], draw.integers(0, 2**63, n // 2).astype(np.uint64)])]
        a, b = np.triu_indices(len(sets), 1)
        unit = np.repeat(np.arange(len(a)), 2)
        rows = np.column_stack([a, b]).ravel()
        sizes, classes = np.array([len(sets[i]) for i in rows]), [simhash.classes_of(sets[i]) for i in rows]
        found = simhash.promising(unit, np.zeros(len(rows), int), rows, sizes, classes, 0.8)[::2]
        links = np.array([len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b, strict=True)])
        assert links.sum() >= 20 and found[links].all()
        kept, total = kept + (found & ~links).sum(), total + (~links).sum()
    assert kept < 0.2 * total


def test_one_shingle_in_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ENTRIES", 50)
    monkeypatch.setattr(simhash, "OFTEN", 0)
    draw = random.Random(13)
    rows = []
    for i in range(300):  # all share one passage, every third has a near copy
        words = ["the", "same", "five", "words", "again", *(f"w{draw.randrange(10**9)}" for _ in range(12))]
        rows.append((2 * i, " ".join(words)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join([*words, "more"])))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), 5, similarity=0.8).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_rows_of_a_hot_block_grow_with_its_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MOST_TILES", 2)
    monkeypatch.setattr(simhash, "TILE", 16)
    made = {}
    for n in (400, 800):
        prints = [(1 << (k % 20)) | (1 << (20 + k // 20 % 20)) | (1 << (40 + k // 400)) for k in range(n)]  # all within a few bits of zero
        rows = spark.createDataFrame([(k, [p]) for k, p in enumerate(prints)], "rep long, prints array<long>")
        keyed = simhash._pigeonhole(rows, 3, n)
        first = simhash._tiled(keyed, 2)
        classes = components(simhash._edges(first, 3, 1).distinct())
        made[n] = first.count() + simhash._rest_of_hot(keyed, classes).count()
    assert made[800] < 2.6 * made[400]


@pytest.mark.parametrize("entries", [7, 50, 1 << 18])
def test_a_hash_of_many_texts_is_one_block(spark, monkeypatch, entries):
    monkeypatch.setattr(simhash, "ENTRIES", entries)
    rows = [(k, [77, 1000 + k // 2], 10 + k // 40, k) for k in range(300)] + [(500 + k, [78], 4 ** (k + 1), 500 + k) for k in range(4)] + [(600 + k, [79], 9, 600) for k in range(100)]
    placed = spark.createDataFrame(rows, "rep long, rare array<long>, size int, component long").repartition(1)
    blocks = defaultdict(set)
    for r in simhash._shared_rare(placed, 0.8).collect():
        blocks[r["block"]].add(r["rep"])
    found = sorted(map(sorted, blocks.values()), key=len)
    assert found[-1] == list(range(300))  # all share 77; sizes go on without a gap
    assert sorted(found[:-1]) == [[k, k + 1] for k in range(0, 300, 2)]  # 78: sizes apart; 79: one component
