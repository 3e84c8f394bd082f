"""Registered queries that SQL cannot express, against plain Python over the same tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from quarry.functions import constants as K
from quarry.operators import entities, integrity, keyword, keyword_index, temporal
from quarry.plans import retrieval
from quarry.plans.catalog import ORACLE_SQL, QUERIES
from tests.conftest import SMALL


def _rows(sql):
    return duckdb.sql(sql.replace("{}", SMALL)).fetchall()


def _fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h - 2**64 if h >> 63 else h


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLE_SQL) == {"fnv1a_hash", "crc_checksums", "query_expand", "entity_extract", "ivf_balance"}


def test_fnv1a_hash(spark):
    want = {i: _fnv(t.encode()) for i, t in _rows("SELECT doc_id, text FROM '{}/documents.parquet'")}
    assert {r["doc_id"]: r["hash"] for r in QUERIES["fnv1a_hash"](spark, SMALL).collect()} == want


def test_crc_checksums(spark):
    want = {i: zlib.crc32(t.encode()) for i, t in _rows("SELECT doc_id, text FROM '{}/documents.parquet'")}
    assert {r["doc_id"]: r["crc32"] for r in QUERIES["crc_checksums"](spark, SMALL).collect()} == want


def _variants(text):
    """(weight, text, kind) of the variants of a text, rule by rule."""
    rules = [("synonym", 0.7, old, new, True) for group in K.SYNONYM_GROUPS for old in group for new in group if new != old]
    rules += [("acronym", 0.8, old, new, False) for old, new in K.ACRONYMS]
    rules += [("temporal", 0.6, old, new, True) for old, several in K.TEMPORAL_EXPANSIONS for new in several]
    low, found = text.lower(), []
    for kind, weight, old, new, bounded in rules:
        at = low.find(old.lower())
        if at < 0:
            continue
        before, after = low[at - 1 : at] if at else "", low[at + len(old) : at + len(old) + 1]
        if bounded and (re.fullmatch("[a-z0-9]", before) or re.fullmatch("[a-z0-9]", after)):
            continue
        found.append((text[:at] + new + text[at + len(old) :], kind, weight))
    for word in re.findall(r"[^\W_]+", text):
        for end, several in K.MORPHOLOGY:
            if word.lower().endswith(end) and len(word) > len(end) + 2:
                at = low.find(word.lower())
                found.append((text[:at] + word.lower()[: len(word) - len(end)] + several[0] + text[at + len(word) :], "morphological", 0.5))
                break
    out, seen = [], set()
    for v in found:
        if v[0].lower() != low and v[0].lower() not in seen:
            seen.add(v[0].lower())
            out.append(v)
    return sorted(out, key=lambda v: -v[2])[:5]


def test_query_expand(spark):
    asked = dict(_rows("SELECT conv_id * 1000 + turn, text FROM '{}/conversations.parquet' WHERE role = 'user'")) | dict(retrieval.ASKED)
    got = defaultdict(list)
    for r in QUERIES["query_expand"](spark, SMALL).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["text"], r["kind"], r["weight"]))
    want = {i: _variants(t) for i, t in asked.items()}
    assert dict(got) == {i: v for i, v in want.items() if v}


def _technologies(text):
    """Start and end of each name with no letter or digit beside it, the longest at each place."""
    out, at = [], 0
    plain = lambda c: c.isascii() and c.isalnum()
    while at < len(text):
        here = [t for t in entities.TECHNOLOGIES if text.startswith(t, at) and not plain(text[at + len(t) : at + len(t) + 1]) and not (at and plain(text[at - 1]))]
        at += len(max(here, key=len)) if here else 1
        if here:
            out.append((at - len(max(here, key=len)), at))
    return out


def test_entity_extract(spark):
    texts = dict(_rows("SELECT doc_id, text FROM '{}/documents.parquet'"))
    got = defaultdict(list)
    for r in QUERIES["entity_extract"](spark, SMALL).collect():
        got[r["id"]].append((r["start"], r["end"], r["kind"], r["text"], r["confidence"]))
    for i, text in texts.items():
        spans = sorted(got[i])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert all(text[a:b] == found for a, b, _, found, _ in spans)
        covered = lambda a, b: any(x < b and a < y for x, y, *_ in spans)
        assert all(covered(*m.span()) for m in re.finditer(r"(?<!\w)\d{4}[-/]\d{2}[-/]\d{2}(?!\w)", text))
        names = _technologies(text)
        assert all(covered(*x) for x in names)
        assert all((a, b) in names for a, b, kind, _, _ in spans if kind == "technology")
    assert sum(map(len, got.values())) > 100


def test_ivf_balance(spark):
    largest, mean, balanced = QUERIES["ivf_balance"](spark, SMALL).first()
    from quarry.operators import vector_index

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id AS id", "embedding")
    sizes = Counter(r["list"] for r in vector_index.kept_index(rows).stored().select("list").collect())
    assert (largest, mean, balanced) == (max(sizes.values()), sum(sizes.values()) / 16, max(sizes.values()) <= 3 * sum(sizes.values()) / 16)


def test_keyword_index_leaves_blocks_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 16)
    draw = random.Random(3)
    texts = [(i, " ".join(draw.choice(["red", "green", "blue", "grey", "black", "white"]) for _ in range(draw.randint(5, 60))) + (" rare rare rare" if i % 97 == 0 else "")) for i in range(2000)]
    docs = spark.createDataFrame(texts, "id long, text string")
    index = keyword_index.KeywordIndex.build(docs, f"file://{tmp_path}/k")
    for words in ("rare", "red rare", "red red blue", "absent", "", "absent green"):
        read = []
        got = [(r["id"], pytest.approx(r["score"])) for r in keyword_index.KeywordIndex.open(spark, index.folder).search(words, 7, read).collect()]
        assert [(r["id"], r["score"]) for r in keyword.top(keyword.bm25(docs, words), 7).collect()] == got
        if words == "red rare":
            assert read[0] == 125 and read[1] < 40


@pytest.mark.parametrize("n", [1, 5, 200])
def test_session_chains_of_any_length(spark, n):
    rows = [(k, k - 1 if k else None) for k in range(n)] + [(9000, 9001), (9001, 9000), (9100, 5555), (9100, 5555)]
    sessions = spark.createDataFrame(rows, "session_id long, parent_session long")
    walk = lambda leaf: [r["session_id"] for r in temporal.session_chain(sessions, leaf).orderBy("depth").collect()]
    assert walk(n - 1) == list(range(n)) and walk(9000) == [9001, 9000] and walk(9100) == [9100] and walk(-1) == []


@pytest.mark.parametrize("width", [3, 10, 10**6])
def test_segments_change_nothing(spark, width):
    draw = random.Random(width)
    left = [(draw.randrange(4), i, float(draw.randrange(60))) for i in range(200)]
    right = [(draw.randrange(4), float(draw.randrange(60)), float(draw.randrange(1000))) for _ in range(60)]
    got = {(r["k"], r["id"]): r["value"] for r in temporal.asof_join(spark.createDataFrame(left, "k int, id long, ts double"), spark.createDataFrame(right, "k int, ts double, value double"), "k", width).collect()}
    want = {(k, i): max(((t, v) for q, t, v in right if q == k and t <= ts), default=(0, None))[1] for k, i, ts in left}
    assert got == want

    versions = [(draw.randrange(3), s, draw.randrange(50)) for s in range(150)]
    got = {tuple(r)[:3] for r in integrity.rollbacks(spark.createDataFrame(versions, "chunk int, seq long, version int"), width).select("chunk", "seq", "version").collect()}
    assert got == {(c, s, v) for c, s, v in versions if any(c2 == c and s2 < s and v2 > v for c2, s2, v2 in versions)}

    events = [(draw.randrange(4), i, float(draw.randrange(200))) for i in range(120)]
    got = sorted(tuple(r)[2:] + (r["user_id"],) for r in temporal.sessionised(spark.createDataFrame(events, "user_id int, id long, ts double"), 4.0, width).collect())
    want = []
    for user in range(4):
        run = []
        for t in sorted(t for u, _, t in events if u == user):
            if run and t - run[-1] > 4:
                want.append((run[0], run[-1], len(run), user))
                run = []
            run.append(t)
        if run:
            want.append((run[0], run[-1], len(run), user))
    assert got == sorted(want)
