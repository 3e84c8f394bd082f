import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import linededup, packing, queries, vocab
from tests.conftest import SMALL, normal


def _brute_lines(rows, sites):
    spread = defaultdict(set)
    for _, text, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(" \t\r") and source is not None:
                spread[line.strip(" \t\r")].add(source)
    bad = {x for x, s in spread.items() if len(s) >= sites}
    return [(i, None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r") not in bad)) for i, text, _ in rows]


def test_op1_oracle(spark, duck):
    got = queries.op1_line_dedup(spark, SMALL).toPandas()
    assert normal(got) == normal(duck.sql(queries.ORACLE_SQL["op1_line_dedup"]).df())
    assert got["n_removed"].sum() > 0


@pytest.mark.parametrize("few", [0, linededup.FEW])
@pytest.mark.parametrize("sites", [2, 4, 6])
def test_lines_near_the_threshold_are_exact(spark, monkeypatch, sites, few):
    monkeypatch.setattr(linededup, "FEW", few)  # both ways to the same rows
    rows = [(100 * n + k, f"own {n} {k}\n  shared by {n}\t\n\nshared by {n}", f"s{k}") for n in range(1, 9) for k in range(n)] + [(9000, None, None), (9001, "", "s1"), (9002, "shared by 8", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["doc_id"], r["text"]) for r in linededup.without_boilerplate(docs, sites).collect()}
    assert got == set(_brute_lines(rows, sites))


@pytest.mark.parametrize("few", [0, linededup.FEW])
def test_clashing_names(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    rows = [(k, "shared\nown", f"s{k}", 7, "b", 3, "x") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int, __bad string, bad_0 int, key string")
    out = linededup.without_boilerplate(docs, 3, count=None)
    assert out.columns == docs.columns and {tuple(r)[1:2] + tuple(r)[3:] for r in out.collect()} == {("", 7, "b", 3, "x")}
    counted = linededup.without_boilerplate(docs, 3)
    assert counted.columns == [*(c for c in docs.columns if c != "n_removed"), "n_removed"] and {r["n_removed"] for r in counted.collect()} == {2}


@pytest.mark.parametrize("few", [0, linededup.FEW])
def test_lines_odd_and_empty(spark, monkeypatch, odd, nothing, few):
    monkeypatch.setattr(linededup, "FEW", few)
    out = linededup.without_boilerplate(odd, 2)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == odd.count()
    texts = {(r["doc_id"], r["source"]): r["text"] for r in out.collect()}
    assert texts[2, "s1"] is None and texts[1, "s0"] == "" and texts[6, "s4"] == "" and texts[9, "s7"] == "\n\n\n"
    assert linededup.without_boilerplate(nothing).count() == 0


def _check_pieces(rows, texts):
    slow = vocab.library(vocab.default_path())
    encode = lambda text: slow.encode(text, add_special_tokens=False).ids
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    for doc, text in texts.items():
        ids = np.append(encode(text or ""), 0).astype("<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = [sum(r["length"] for r in p) for p in by_sequence.values()]
    return sum(0 if n & (n - 1) == 0 else 1024 - n for n in used), sum(used)


def test_op2_pieces(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op2_cost_packing(spark, SMALL).collect()
    padding, tokens = _check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert tokens > 50_000 and padding < 0.02 * tokens


def test_packing_odd_and_empty(spark, odd, nothing):
    one = odd.where("doc_id <> 6 and doc_id is not null")
    padding, _ = _check_pieces(packing.packed(one).collect(), {r["doc_id"]: r["text"] for r in one.collect()})
    assert padding == 0 and packing.packed(nothing).count() == 0
    assert packing.packed(odd).where("doc_id = 6").groupBy("start").count().where("count <> 2").count() == 0


def test_plan_is_balanced():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 900, 500)
    pieces = np.array(packing.plan(lengths))
    spent = np.bincount(pieces[:, 3], packing.cost(pieces[:, 2].astype(float)))
    used = np.bincount(pieces[:, 3], pieces[:, 2])
    assert (used <= 1024).all() and used.sum() == lengths.sum()
    full = spent[used == 1024]
    assert full.std() / full.mean() < 0.1


def _plain_plan(lengths, size):
    """The documented rule, one document at a time: whole sequences, then descending to the cheapest with room, then what fits nowhere into the gaps of the cheapest first."""
    pieces, count = [], 0
    for doc, n in enumerate(lengths):
        for k in range(n // size):
            pieces.append((doc, k * size, size, count, 0))
            count += 1
    rest = [(n % size, doc, n - n % size) for doc, n in enumerate(lengths) if n % size]
    total = sum(n for n, _, _ in rest)
    held = [[] for _ in range(total // size)]
    spent = lambda s: sum(packing.cost(n) for n in s)
    waiting = []
    for n, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        able = [(spent(s), k) for k, s in enumerate(held) if sum(s) + n <= size]
        if not able:
            waiting.append((doc, start, n))
            continue
        k = min(able)[1]
        pieces.append((doc, start, n, count + k, sum(held[k])))
        held[k].append(n)
    return pieces, waiting, {count + k: size - sum(s) for k, s in enumerate(held)}


@pytest.mark.parametrize("size", [16, 1024])
def test_plan_follows_its_rule(size):
    draw = np.random.default_rng(size)
    for _ in range(20):
        lengths = draw.integers(1, 3 * size, int(draw.integers(1, 60)))
        pieces = packing.plan(lengths, size)
        want, waiting, room = _plain_plan(lengths.tolist(), size)
        assert pieces[: len(want)] == want
        rest = pieces[len(want) :]
        assert sum(p[2] for p in rest) == sum(n for _, _, n in waiting)
        filled = defaultdict(int)
        for _, _, n, sequence, _ in rest:
            filled[sequence] += n
        assert all(filled[k] == n for k, n in room.items())  # no gap is left
        tail = [n for k, n in filled.items() if k not in room]
        assert all(n & (n - 1) == 0 for n in tail) and len(tail) == len(set(tail))


def test_long_white_space_and_special_tokens():
    import tokenizers

    slow = tokenizers.Tokenizer.from_file(vocab.default_path())
    encode = vocab.fast_encoder(vocab.default_path())
    for text in ["<|endoftext|> a", " " * 50_000 + "x", "\x1c\x85\u2028 a", "ab" * 3000, "it's 'LL ９٣"]:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids
