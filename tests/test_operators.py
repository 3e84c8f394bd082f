"""Small cases with results known by hand, and properties."""

import math
import random
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vector as V
from quarry.operators import arrays, entities, fusion, graph, guards, integrity, keyword, lifecycle, markdown, migrate, temporal, vector_index, vector_search
from quarry.sources import tables


def test_bm25_prefers_more_hits_and_skips_none(spark):
    docs = spark.createDataFrame([(1, "rust rust rust code"), (2, "rust code here now"), (3, "python only")], "id long, text string")
    got = keyword.top(keyword.bm25(docs, "rust"), 5).collect()
    assert [r["id"] for r in got] == [1, 2]
    n, df = 3, 2
    assert got[1]["score"] == pytest.approx(keyword.idf(n, df) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / (10 / 3))))


def test_cosine_of_zero_is_zero(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "z array<float>, a array<float>, b array<float>")
    got = row.select(V.cosine(F.col("z"), F.col("a")), V.cosine(F.col("a"), F.col("b")), V.l2(F.col("a"), F.col("b"))).first()
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2] == pytest.approx(math.sqrt(5))


def test_zero_query_finds_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert vector_search.flat_topk(rows, [0.0, 0.0], 3).count() == 0


def _points(kind, draw, n=600, width=16):
    if kind == "uniform":
        return [[draw.gauss(0, 1) for _ in range(width)] for _ in range(n)]
    centres = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(12)]
    return [[x + draw.gauss(0, 0.02) for x in centres[i % 12]] if i % 50 else [draw.gauss(0, 1) for _ in range(width)] for i in range(n)]


@pytest.mark.parametrize("kind", ["uniform", "clustered"])
def test_index_searches_are_exact_at_their_defaults(spark, tmp_path, kind):
    draw = random.Random(1)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(_points(kind, draw))] + [(9000, [0.0] * 16)], "id long, embedding array<double>")
    plain = vector_index.VectorIndex.build(rows, f"file://{tmp_path}/a")
    several = vector_index.VectorIndex.build(rows, f"file://{tmp_path}/b", copies=2)
    for key in (5, 50, 77):
        q = vector_search.vector_of(rows, key)
        want = [(r["id"], pytest.approx(r["score"])) for r in vector_search.flat_topk(rows, q, 10).collect()]
        for found in (plain.search(q, 10), several.search(q, 10), plain.search(q, 10, codes=True), several.search(q, 10, codes=True, candidates=20)):
            assert [(r["id"], r["score"]) for r in found.collect()] == want
    if kind == "clustered":  # clustered rows are read in part
        q = vector_search.vector_of(rows, 5)
        read = []
        plain._inside, inside = lambda lists: read.append(len(lists)) or inside(lists), plain._inside
        plain.search(q, 10).collect()
        assert max(read) < len(plain.lists())


def test_index_is_kept_grows_and_shrinks(spark, tmp_path):
    draw = random.Random(2)
    points = _points("uniform", draw, 300)
    rows = spark.createDataFrame(list(enumerate(points)), "id long, embedding array<double>")
    index = vector_index.VectorIndex.build(rows.where("id < 200"), f"file://{tmp_path}/i", lists=9)
    index.insert(rows.where("id >= 200"))
    index.delete(rows.where("id % 4 = 0"))
    q = points[8]
    want = [r["id"] for r in vector_search.flat_topk(rows.where("id % 4 <> 0"), q, 12).collect()]
    again = vector_index.VectorIndex.open(spark, f"file://{tmp_path}/i")
    small = again.compact(f"file://{tmp_path}/j")
    for x in (index, again, small):
        assert [r["id"] for r in x.search(q, 12, codes=True).collect()] == want
    assert tuple(again.stats().first())[:2] == (225, 75) and tuple(small.stats().first())[:2] == (225, 0)
    table = small.offsets().orderBy("list").collect()
    assert sum(r["n"] for r in table) == 225 and all(b["start"] == a["start"] + a["n"] for a, b in zip(table, table[1:], strict=False))
    largest, mean, balanced = small.balance().first()
    assert largest == max(r["n"] for r in table) and mean == 225 / 9 and balanced == (largest <= 3 * mean)


def test_strategies_agree(spark, monkeypatch):
    assert [vector_search.choose_strategy(n) for n in (10, 9_999, 10_000, 100_000, 100_001)] == ["flat", "flat", "prenormalised", "prenormalised", "ivfpq"]
    draw = random.Random(3)
    rows = spark.createDataFrame(list(enumerate(_points("uniform", draw, 200))), "id long, embedding array<double>")
    q = vector_search.vector_of(rows, 3)
    found = [[r["id"] for r in vector_search.search(rows, q, 7, s).collect()] for s in ("flat", "prenormalised", "ivfpq", None)]
    assert found[0] == found[1] == found[2] == found[3]


def test_many_queries_by_blocks(spark, monkeypatch):
    draw = random.Random(4)
    rows = spark.createDataFrame(list(enumerate(_points("uniform", draw, 150))) + [(900, [0.0] * 16)], "id long, embedding array<double>")
    for earlier in (False, True):
        once = sorted(map(tuple, vector_search.multi_topk(rows, rows, 3, earlier).collect()))
        with monkeypatch.context() as m:
            m.setattr(vector_search, "QUERY_BLOCK", 10)
            m.setattr(vector_search, "ROW_BLOCK", 32)
            blocks = sorted(map(tuple, vector_search.multi_topk(rows, rows, 3, earlier).collect()))
            with pytest.raises(ValueError, match="10 queries"):
                vector_search.distances(rows, rows)
        assert [r[:3] for r in once] == [r[:3] for r in blocks] and [r[3] for r in once] == pytest.approx([r[3] for r in blocks])


def test_minmax_of_equal_scores_is_zero(spark):
    assert fusion.minmax(spark.createDataFrame([(1, 0.7)], "id long, score double")).first()["score"] == 0.0


def test_confidence_gap_and_floor(spark):
    s = spark.createDataFrame([(1, 0.9), (2, 0.5), (3, 0.3)], "id long, score double")
    assert [r["id"] for r in fusion.confident(s).collect()] == [1, 2]
    assert fusion.confident(s.where("id = 3"), least=0.5).count() == 0


def test_temporal_decay_halves(spark):
    got = spark.range(1).select(fusion.temporal_decay(F.lit(0.0), 86400.0).alias("a"), fusion.temporal_decay(F.lit(9e9), 0.0).alias("b")).first()
    assert got["a"] == pytest.approx(0.5) and got["b"] == 1.0


def test_gate(spark):
    texts = [("", "empty input"), ("OK!", "trivial phrase"), ("so what", "too few words"), ("the a an is it", "trivial words"), ("please read the index file", None)]
    rows = spark.createDataFrame([(t,) for t, _ in texts], "text string").select(T.gate_reason(F.col("text")).alias("r")).collect()
    assert [r["r"] for r in rows] == [w for _, w in texts]


def test_expansion_is_ranked_and_limited(spark):
    got = T.expanded(spark.createDataFrame([(1, "find the API bug")], "query_id long, text string")).orderBy("rank").collect()
    assert got[0]["kind"] == "acronym" and got[0]["text"] == "find the Application Programming Interface bug"
    assert len(got) == 5 and all(r["kind"] == "synonym" for r in got[1:])


def test_bfs_depths_grow_with_depth(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (9, 9, 1.0)], "src long, tgt long, weight double")
    seed = spark.createDataFrame([(1,)], "id long")
    assert sorted(map(tuple, graph.bfs(edges, seed, 2).collect())) == [(2, 1), (3, 2)]
    assert graph.subgraph(edges, seed, 2).count() == 2


def test_spread_adds_up(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0)], "src long, tgt long, weight double")
    got = {r["id"]: r["activation"] for r in graph.spread(edges, spark.createDataFrame([(1, 1.0)], "id long, activation double"), 1).collect()}
    assert got == {1: 1.0, 2: 1.0}


def test_overlap_join_equals_theta_join(spark):
    draw = random.Random(3)
    make = lambda n: [(i, s := draw.uniform(0, 100), s + draw.uniform(0, 30)) for i in range(n)]
    a, b = make(40), make(30)
    schema = "id long, start_ts double, end_ts double"
    got = {tuple(r) for r in temporal.overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 7.0).collect()}
    assert got == {(i, j) for i, s, e in a for j, t, f in b if s <= f and t <= e}


def test_windowed_counts_equal_brute_force(spark):
    draw = random.Random(4)
    ts = [float(draw.randint(0, 600)) for _ in range(300)]
    got = {r["id"]: r["n"] for r in guards.windowed_counts(spark.createDataFrame(list(enumerate(ts)), "id long, ts double"), 60).collect()}
    assert got == {i: sum(t - 60 <= u <= t for u in ts) for i, t in enumerate(ts)}


def test_consolidation_respects_capacity(spark):
    rows = spark.createDataFrame([(i, "working" if i % 2 else "episodic", i % 10 / 10, i % 14, 0.0) for i in range(200)], "id long, tier string, importance double, access long, last_ts double")
    got = {r["tier"]: r["n"] for r in lifecycle.tier_stats(lifecycle.consolidated(rows, 10.0, 20, 15)).collect()}
    assert got["episodic"] <= 15 and got.get("working", 0) <= 20


def test_numbered_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("id"))
    got = lifecycle.numbered(rows, ["id"]).collect()
    assert all(r["id"] == r["row_no"] for r in got)


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4), st.integers(1, 4), st.integers(1, 3)), min_size=1, max_size=3))
def test_hyperslab_size(dims):
    dims = [(s, max(t, b), c, b) for s, t, c, b in dims]
    slab = arrays.Hyperslab(*(tuple(x) for x in zip(*dims, strict=True)))
    n = 1
    for s, t, c, b in dims:
        n *= sum(1 for i in range(60) if i >= s and (i - s) % t < b and (i - s) // t < c)
    assert slab.size() == n


def test_hyperslab_refuses_overlap():
    with pytest.raises(ValueError, match="stride"):
        arrays.Hyperslab((0,), (1,), (2,), (2,))


def test_morton(spark):
    row = spark.createDataFrame([(3, 5)], "x long, y long").select(arrays.morton(4, F.col("x"), F.col("y")).alias("z")).first()
    assert row["z"] == 0b100111


def test_unpack_keeps_fill_without_attributes(spark):
    row = spark.createDataFrame([(-999.0,)], "v double")
    assert row.select(arrays.unpacked(F.col("v"), fill=-999.0).alias("x")).first()["x"] == -999.0
    assert math.isnan(row.select(arrays.unpacked(F.col("v"), 2.0, fill=-999.0).alias("x")).first()["x"])


def test_conversion_cost():
    assert [arrays.conversion_cost(*x) for x in (("i32", "i32"), ("i32", "i64"), ("i64", "i32"), ("i64", "f64"), ("f64", "i32"), ("i32", "f64"), ("u8", "i16"))] == ["none", "widening", "narrowing", "lossy", "lossy", "widening", "widening"]


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8])
def test_tree_proofs(spark, count):
    leaves = spark.createDataFrame([(i, f"leaf {i}") for i in range(count)], "idx long, data string").select("idx", integrity.leaf_hash(F.col("data")).alias("hash"))
    tree = integrity.levels(leaves, count).collect()
    by = {(r["level"], r["idx"]): r["hash"] for r in tree}
    depth = max(r["level"] for r in tree)
    for i in range(count):
        path = [by[k, (i >> k) ^ 1] for k in range(depth)]
        assert integrity.verified(by[0, i], i, path, by[depth, 0])
        assert depth == 0 or not integrity.verified("00" * 32, i, path, by[depth, 0])


def test_fnv1a(spark):
    row = spark.createDataFrame([("",), ("a",)], "t string").select(guards.fnv1a64(F.col("t")).alias("h")).collect()
    assert [r["h"] & 0xFFFFFFFFFFFFFFFF for r in row] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]


def test_markdown_round_trip(spark):
    docs = spark.createDataFrame([(1, "intro\n# A\nbody\n## B\nmore")], "id long, text string")
    s = markdown.sections(docs)
    assert [(r["heading"], r["level"], r["body"], r["first_line"]) for r in s.orderBy("first_line").collect()] == [(None, 0, "intro", 0), ("A", 1, "body", 1), ("B", 2, "more", 3)]
    assert markdown.exported(s).first()["text"] == "intro\n# A\nbody\n## B\nmore"


def test_entities():
    got = entities.extract("we met Ada Lovelace of Acme Labs on 2024-01-31 and used Python with my-tool and DataFrame")
    assert [(t, k) for t, k, *_ in got] == [("Ada Lovelace", "person"), ("Acme Labs", "organisation"), ("2024-01-31", "date"), ("Python", "technology"), ("my-tool", "project"), ("DataFrame", "project")]
    assert all(a[3] <= b[2] for a, b in zip(got, got[1:], strict=False))


def test_sqlite_and_incremental_load(spark, tmp_path):
    path = str(tmp_path / "m.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE memory_chunks (id INTEGER PRIMARY KEY, chunk TEXT, deleted INTEGER)")
        db.executemany("INSERT INTO memory_chunks VALUES (?, ?, ?)", [(i, f"text {i}", i % 3 == 0) for i in range(50)])
    rows = tables.read_sqlite(spark, path, "memory_chunks", "id long, chunk string", ["id", "chunk"], "deleted = 0", key="id")
    assert rows.count() == 33 and tables.sqlite_counts(path, ["memory_chunks"]) == {"memory_chunks": 50}
    old = rows.where("id < 20")
    assert migrate.loaded(rows, old).count() == 33
    assert {r["problem"]: r["n"] for r in migrate.mismatches(rows, rows, "id", ["chunk"], []).collect()} == {"same": 33}


def test_snapshots(spark, tmp_path):
    tables.snapshot(spark.range(3), str(tmp_path), 1)
    tables.snapshot(spark.range(5), str(tmp_path), 2)
    assert tables.restored(spark, str(tmp_path)).count() == 5 and tables.restored(spark, str(tmp_path), 1).count() == 3


def test_floats(spark):
    import struct

    row = spark.createDataFrame([(struct.pack("<3f", 1, 2, 3) + b"x",)], "b binary")
    assert row.select(migrate.floats("b", 2).alias("v")).first()["v"] == [1.0, 2.0]


def test_array_files(spark, tmp_path):
    import numpy as np

    from quarry.sources import arrayfile

    arrayfile.register(spark)
    path = str(tmp_path / "a.npy")
    grid = np.arange(60, dtype="<f4").reshape(20, 3)
    np.save(path, grid)
    rows = spark.read.format("arrayfile").option("chunk", "4").load(path)
    assert rows.columns == ["i0", "i1", "value"] and rows.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, rows.collect())) == [(i, j, float(grid[i, j])) for i in range(20) for j in range(3)]
    some = spark.read.format("arrayfile").option("chunk", "4").option("from", "7").option("to", "9").load(path)
    assert some.rdd.getNumPartitions() == 1 and some.agg(F.sum("value")).first()[0] == grid[7:9].sum()
    out = str(tmp_path / "out")
    rows.write.format("arrayfile").mode("append").save(out)
    assert sum(len(np.load(f)) for f in __import__("pathlib").Path(out).glob("*.npy")) == 60


def test_coding(spark):
    import numpy as np

    from quarry.functions import coding

    row = spark.createDataFrame([(np.array([1, 2**63], "<u8").tobytes(), np.array([1.5, -2], ">f4").tobytes() + b"z", b"abcdefg")], "u binary, f binary, s binary")
    got = row.select(coding.numbers(F.col("u"), "u8").alias("u"), coding.numbers(F.col("f"), "f4", True).alias("f"), coding.byte_shuffled(F.col("s"), 3).alias("s"), coding.fletcher32(F.lit(b"abcde").cast("binary")).alias("c")).first()
    assert [int(x) for x in got["u"]] == [1, 2**63] and got["f"] == [1.5, -2.0] and bytes(got["s"]) == b"adbecfg"
    words = [0x6162, 0x6364, 0x6500]
    a = b = 0
    for w in words:
        a = (a + w) % 65535
        b = (b + a) % 65535
    assert got["c"] == b << 16 | a


def test_replay_and_profile(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    log = spark.createDataFrame([(1, "save", 3, "c"), (2, "delete", 1, None), (3, "save", 2, "x"), (4, "save", 2, "y")], "seq long, op string, id long, value string")
    assert sorted(map(tuple, tables.replayed(base, log).collect())) == [(2, "y"), (3, "c")]


def test_merge_refuses_duplicates(spark):
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    with pytest.raises(Exception, match="duplicate x"):
        tables.merged([a, a]).collect()


@given(st.lists(st.integers(1, 40), min_size=1, max_size=3), st.sampled_from([1, 4, 8]), st.integers(1, 2000))
def test_verification_grid_follows_its_rule(shape, element, target):
    grid = arrays.verification_grid(tuple(shape), element, target)
    whole = math.prod(shape) * element
    assert (grid is None) == (whole <= target * math.sqrt(2) or whole**2 <= 2 * target**2)
    if grid:
        cut = next(k for k, (n, g) in enumerate(zip(shape, grid, strict=True)) if g != 1 or n == 1 or k == len(shape) - 1)
        assert all(g == 1 for g in grid[:cut]) or all(n == 1 for n in shape[:cut])
        assert math.prod(grid) * element <= max(2 * target, element * 2)


def test_leaves_lie_end_to_end(spark):
    assert arrays.verification_grid((1000, 1000, 1000), 4, 1 << 20) == (1, 250, 1000)
    shape = (7, 10, 4)
    grid = arrays.verification_grid(shape, 4, 64)
    tiles = math.prod(-(-n // g) for n, g in zip(shape, grid, strict=True))
    start, size = arrays.leaf_bytes(F.col("id"), shape, grid, 4)
    rows = [tuple(r) for r in spark.range(tiles).select(start, size).collect()]
    at = 0
    for a, n in sorted(rows):
        assert a == at and n > 0
        at += n
    assert at == math.prod(shape) * 4 and rows == sorted(rows)
