import hashlib
import math
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bpe, chat, media, queries, vocab
from tests.conftest import SMALL

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def _expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), SHA("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), SHA("".join(x for r, x in t if r == "assistant")), len(chat.render(t))) for c, t in by.items()}


def test_op3_digests(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "\\### Assistant: </turn> ok"
    want = _expected([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in queries.op3_chat_spans(spark, SMALL).collect()}
    assert got == want


def test_long_and_odd_conversations(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} \\</turn>### <") for k in range(300)]
    rows += [(2, 0, "user", None), (2, 0, "user", None), (2, 0, None, "x"), (3, 0, "we:ird\\", ""), (4, 5, "assistant", "y" * 200_000)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, start string")
    turns = chat.formatted(docs, window=chat.WINDOW)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat.digests(turns).collect()}
    assert got == _expected(rows)
    assert turns.where("rewrites").count() == 0 and chat.digests(chat.formatted(docs.limit(0))).count() == 0
    some = docs.where("conv_id <> 1 or turn < 40")
    whole = sorted(map(tuple, chat.formatted(some).collect()), key=repr)
    assert whole == sorted(map(tuple, chat.formatted(some, window=chat.WINDOW).collect()), key=repr) and len(whole) == 45


TEMPLATES = {
    "numbered": lambda turns: "".join(f"[{k}|{r}]{t}\n" for k, (r, t) in enumerate(turns)),
    "first named": lambda turns: "".join(f"<{turns[0][1]}|{r}>{t}\n" for r, t in turns),
    "end mark": lambda turns: "BOS" + "".join(f"<{r}>{t}</>" for r, t in turns) + "<END>",
    "trims after ten": lambda turns: "".join(f"<{r}>{t if len(turns) - k <= 10 else t[:2]}</>" for k, (r, t) in enumerate(turns)),
    "forgets": lambda turns: "".join(f"<{r}>{t}</>" for r, t in turns[-6:]),
    "counts": lambda turns: f"{len(turns)} turns:" + "".join(f"<{r}>{t}</>" for r, t in turns),
}


@pytest.mark.parametrize("name", TEMPLATES)
@pytest.mark.parametrize("n", [12, 300])
def test_whole_output_of_any_template(name, n):
    renderer = TEMPLATES[name]
    turns = [("assistant" if k % 2 else "user", f"{'ab<'[k % 3]} text {k} {'x' * (k % 5)}") for k in range(n)]
    whole, found = chat.spans(renderer, turns)
    assert whole == renderer(turns) == "".join(whole[a:b] for a, b, *_ in found)
    assert any(x[-1] for x in found) == (name not in ("numbered", "first named"))
    if name not in ("trims after ten", "forgets"):
        assert [whole[c:d] for _, _, c, d, _ in found] == [t for _, t in turns]
    else:
        assert [whole[c:d] for _, _, c, d, _ in found[-6:]] == [t for _, t in turns[-6:]]
        assert all(found[k][-1] for k in range(10, n))


def test_a_window_must_be_true(spark):
    rows = spark.createDataFrame([(1, k, "user", f"turn {k}") for k in range(40)], "conv_id long, turn long, role string, text string")
    for name in ("numbered", "end mark", "trims after ten"):
        with pytest.raises(Exception, match="window|looks back"):
            chat.formatted(rows, TEMPLATES[name], window=8).collect()
    assert "".join(r["formatted"] for r in chat.formatted(rows, TEMPLATES["end mark"]).orderBy("turn").collect()) == TEMPLATES["end mark"]([("user", f"turn {k}") for k in range(40)])


def test_op3_renders_whole_prefixes(spark, tmp_path, monkeypatch):
    """A template whose turns have numbers is read back by the query as it is for all turns, beyond any window."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} </turn>") for k in range(40)] + [(2, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"file://{tmp_path}/conversations.parquet")
    real, numbered = chat.formatted, lambda turns: chat.render([(f"{k} {r}", t) for k, (r, t) in enumerate(turns)])
    monkeypatch.setattr(chat, "formatted", lambda rows, **k: real(rows, numbered, **k))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["formatted_chars"]) for r in queries.op3_chat_spans(spark, f"file://{tmp_path}").collect()}
    turns = [(f"{k} {r}", t) for _, k, r, t in rows[:40]]
    assert got[1] == (40, SHA("".join(f"{r}\n{t}\n" for r, t in turns)), sum(len(t) for _, t in turns[1::2]), len(chat.render(turns)))


def test_common_starts():
    import os.path

    for n in (0, 1, 255, 256, 257, 511, 768, 5000):
        for k in {0, n // 2, max(0, n - 1), n}:
            a, b = "é" * n, "é" * k + "b" * 700
            assert chat._shared(a, b) == chat._shared(b, a) == len(os.path.commonprefix([a, b])) == min(k, n)


def test_templates_that_rewrite_are_found():
    trimming = lambda turns: "".join(f"<{r}>{t if k == len(turns) - 1 else t[:3]}</{r}>" for k, (r, t) in enumerate(turns))
    before = [("user", "long question")]
    whole, start, a, b, rewrites = chat.locate(trimming, before, "assistant", "an answer")
    assert rewrites and whole[a:b] == "an answer" and start == len("<user>lon")
    appending = lambda turns: "BOS" + "".join(f"[{r}]{t}[/]" for r, t in turns)
    whole, start, a, b, rewrites = chat.locate(appending, before, "assistant", "[/]")
    assert not rewrites and whole[a:b] == "[/]" and start == len(appending(before))


@given(st.lists(st.tuples(st.text("a:\\#< /turn>\n"), st.text("a\\#< /turn>\n:")), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_template_round_trip(turns):
    assert chat.parse(chat.render(turns)) == turns


ODD = ["", "a", "aaaaaaa" * 50, " \x1c\x1d x \x85 y᠎ z ​   \n\n  a", "<|endoftext|> a<|endoftext|>", "it's 'LL we'll  ９٣ ②x", "é́ न्दी 漢字", "\U0001f600\U0001f468", "  " * 3000 + "x", "ab" * 5000, "\x00\x01\r\n\t\v\f", "  ﻿", "ͅªᛮⅠ\U00010d40〇"]


def _slow():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(vocab.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library():
    slow, encoder = _slow(), bpe.Encoder(vocab.default_path())
    for text, ids in zip(ODD, encoder.encode(ODD), strict=True):
        want = slow.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert encoder.decode(ids) == slow.decode(want, skip_special_tokens=False)
    assert encoder.decode(np.array([94, 200, 50256], "<u4").tobytes()) == slow.decode([94, 200, 50256], skip_special_tokens=False)


@given(st.lists(st.text(), max_size=5))
@settings(max_examples=60, deadline=None)
def test_bpe_equals_the_library_on_any_text(texts):
    slow = _slow()
    got = bpe.Encoder(vocab.default_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_left_to_the_library():
    import public_tokenizers
    import tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    slow = tokenizers.Tokenizer.from_file(path)
    encoder, fast = bpe.Encoder(path), vocab.fast_encoder(path)
    texts = ["", "Some Words, it's 12!", "\u6f22\u5b57 \u00e9", "<|endoftext|> x"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        want = slow.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want == fast(text).tolist()
        assert encoder.decode(ids) == slow.decode(want, skip_special_tokens=False)
    assert vocab.load(vocab.default_path()).plain


def test_op6(spark, odd, nothing):
    slow = _slow()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op6_pair_index_bpe(spark, SMALL).collect():
        ids = slow.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == SHA(slow.decode(ids, skip_special_tokens=False))
    assert bpe.digests(bpe.decoded(bpe.encoded(odd))).count() == odd.count()
    assert bpe.digests(bpe.decoded(bpe.encoded(nothing))).count() == 0


def test_op7(spark, odd, nothing):
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    rows = media.featured(media.stored(odd)).collect()
    assert len(rows) == odd.count() and media.featured(media.stored(nothing)).count() == 0
    want = {}
    for doc, text in texts:
        raw = (text or "").encode()
        pay = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        want.setdefault(doc, set()).add((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:])))
    for r in rows:
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) in want[r["doc_id"]]
    same = {(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (1, 6)}
    assert len(same) == 1


def test_png_checks_and_filters():
    data = media.write_png(media.payload(b"abc" * 500))
    assert media.read_png(data).tobytes() == media.payload(b"abc" * 500)
    for at in (3, 20, len(data) // 2, len(data) - 3):
        with pytest.raises((ValueError, zlib.error)):
            media.read_png(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    draw = np.random.default_rng(2)
    pixels = draw.integers(0, 256, (10, 12), dtype=np.uint8)
    lines = []
    for k, row in enumerate(pixels.astype(int)):  # each filter by its definition
        kind, up = k % 5, pixels[k - 1].astype(int) if k else np.zeros(12, int)
        out = [kind]
        for x in range(12):
            a, b, c = row[x - 3] if x >= 3 else 0, up[x], up[x - 3] if x >= 3 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((row[x] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines.append(bytes(out))
    head = struct.pack(">IIBBBBB", 4, 10, 8, 2, 0, 0, 0)
    png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.read_png(png) == pixels).all()


def _plain_hash(pixels):
    """The documented feature, number by number."""
    high = len(pixels)
    grey = [[sum(int(v) for v in row[3 * x : 3 * x + 3]) / 3 for x in range(64)] for row in pixels]
    small = []
    for y in range(32):
        low = int(y * high / 32)
        part = grey[low : max(math.ceil(y * high / 32 + high / 32), low + 1)]
        small.append([sum(r[2 * x] + r[2 * x + 1] for r in part) / (2 * len(part)) for x in range(32)])
    wave = lambda u, x: math.cos(math.pi * (2 * x + 1) * u / 64)
    waves = [sum(small[y][x] * wave(u, y) * wave(v, x) for y in range(32) for x in range(32)) for u in range(8) for v in range(8)]
    middle = sorted(waves[1:])[31]
    return f"{int(''.join('01'[k > 0 and w > middle] for k, w in enumerate(waves)), 2):016x}"


def test_feature_by_its_definition():
    draw = np.random.default_rng(8)
    for text in (b"some words " * 900, bytes(range(256)) * 7, draw.integers(0, 256, 5000, dtype=np.uint8).tobytes()):
        pixels = media.read_png(media.write_png(media.payload(text)))
        assert media.cosine_hash(pixels) == _plain_hash(pixels)


def test_hash_is_perceptual():
    a = media.read_png(media.write_png(media.payload(b"some text of words " * 400)))
    b = a.copy()
    b[5] = b[6]
    far = media.read_png(media.write_png(media.payload(b"QZ%%!! " * 900)))
    bits = lambda x, y: (int(media.cosine_hash(x), 16) ^ int(media.cosine_hash(y), 16)).bit_count()
    assert bits(a, b) < bits(a, far)
