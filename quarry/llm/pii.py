"""Personal data: fixed patterns and a linear-chain conditional random field over word shapes.

Patterns find e-mail addresses, IP addresses, card numbers and phone numbers; their spans always
stay. The field adds spans that patterns miss (keys and tokens, numbers that look like
cards or phones but break a rule): kinds ``x_email``, ``x_ip``, ``x_card``, ``x_phone`` and
``secret``, where no pattern's span covers them. Unbroken digits that fail the card test are no cards.

The field's labels are LABELS. Its features of a word are indicators of the word's shape
(counts of digits, letters and signs, in steps); its weights are fitted by gradient
ascent on the likelihood of a small labelled table (``labelled``). Whole texts are
decoded by Viterbi in numpy, all words of a batch at once: a word whose
"none" no two transitions could outweigh has that label in the best path, so
the chain falls apart there, exactly, into short runs. Runs are decoded
side by side, one step of all runs at a time. Words are marked, and may have another label, by a digit, @, = or +, or by
LONG bytes or more with CHANGES capitals after small letters; of a field that does not hold the others free, all words of a text are one run.

Offsets are code points, end exclusive. Null text counts as empty and has no
spans. Repeated rows give a row each; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import common, wordbatch

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", "x_email", "x_ip", "x_card", "x_phone", "secret")
ALL_KINDS = (*KINDS, *LABELS[1:])

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left over local characters, to the right over a domain: time in proportion to the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", max(at + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return out


# --- word shapes -----------------------------------------------------------

#: Counted classes of bytes, and the steps their counts fall into.
_CLASSES = {
    "digit": b"0123456789", "hex": b"abcdefABCDEF", "letter": bytes([*range(65, 91), *range(97, 123), *range(128, 256)]),
    "upper": bytes(range(65, 91)), "at": b"@", "dot": b".", "dash": b"-_", "plus": b"+", "paren": b"()", "equal": b"=:", "quote": b"\"'`",
}
_STEPS = {"digit": (1, 2, 3, 4, 5, 8, 12, 16, 17, 20), "hex": (1, 4, 8, 16), "letter": (1, 2, 4, 8, 16, 32), "upper": (1, 4, 8, 12), "at": (1,), "dot": (1, 2, 3, 4), "dash": (1, 2), "plus": (1,), "paren": (1, 2), "equal": (1,), "quote": (1, 2)}
#: Words without a marked byte that are marked nevertheless: bytes, and capitals after small letters, at least.
LONG, CHANGES = 16, 3
_STEPS["change"] = (1, 2, 3, 4, 6, 9)
_MARKED = np.zeros(256, bool)
_MARKED[list(b"0123456789@=+")] = True
_WIDTHS = {name: len(steps) + 1 for name, steps in _STEPS.items()}
#: A feature for each class and step, one that says the word has no marked byte, and pairs of digit and letter steps.
FEATURES = 1 + sum(_WIDTHS.values()) + _WIDTHS["digit"] * _WIDTHS["letter"]


def shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which words are marked, feature ids of those: n x k); other words have feature 0 alone."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros((0, len(_STEPS) + 1), np.int64)
    signs = np.flatnonzero(_MARKED[data])
    capital = (data >= 65) & (data <= 90)
    capital[1:] &= (data[:-1] >= 97) & (data[:-1] <= 122)
    capital[:1] = False
    changes = np.flatnonzero(capital)
    turns = np.searchsorted(changes, end) - np.searchsorted(changes, start)
    marked = np.flatnonzero((np.searchsorted(signs, end) > np.searchsorted(signs, start)) | ((end - start >= LONG) & (turns >= CHANGES)))
    a, b = start[marked], end[marked]
    length = b - a
    if not len(marked):
        return marked, np.zeros((0, len(_STEPS) + 1), np.int64)
    offset = np.cumsum(length) - length
    inside = data[np.arange(int(length.sum())) - np.repeat(offset, length) + np.repeat(a, length)]
    columns, base, level = [], 1, {}
    for name, members in _CLASSES.items():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        level[name] = np.searchsorted(_STEPS[name], np.add.reduceat(table[inside], offset), side="right")
        columns.append(base + level[name])
        base += _WIDTHS[name]
    columns.append(base + np.searchsorted(_STEPS["change"], turns[marked], side="right"))
    base += _WIDTHS["change"]
    columns.append(base + level["digit"] * _WIDTHS["letter"] + level["letter"])
    return marked, np.column_stack(columns)


# --- the field -------------------------------------------------------------


@dataclass
class Field:
    emit: np.ndarray  # FEATURES x labels
    move: np.ndarray  # labels x labels
    begin: np.ndarray  # labels


def labelled() -> list[tuple[str, list[str]]]:
    """The small labelled table: sentences, and the label of each of their words."""
    draw = np.random.default_rng(7)
    digits = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    hexes = lambda n: "".join(draw.choice(list("0123456789abcdef"), n))
    # Words around personal data, and numbers that are none.
    plain = "the of and to in is was on for with call write my number mail card address at from until who said that here der die und ist la de et los".split()
    harmless = ["1", "12", "3.", "4.0", "2.0.", "1999", "2024", "(2)", "10:30", "3.14", "100%", "1,000", "v1.2.3", "no.7", "2024-01-31", "$15", "x=1", "a=b", "+5", "@home", "50-60", "12:", "ISO-8601", "CC-BY-4.0", "3rd", "[12]", "mp3", "section2", "COVID-19", "AbstractFactoryBeanProvider", "JavaScriptObjectNotation", "GitHubStackOverflowYouTube", "OneTwoThreeFourFive", "TABLE3", "abandonment7", "UNDERSTANDING!!2", "chapter10:", "H2O"]
    mixed = lambda letters, n: "".join(draw.choice(list(letters + "0123456789"), n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    secrets = [
        lambda: f'"{hexes(40)}"', lambda: hexes(int(draw.choice([32, 40, 64]))).upper(), lambda: hexes(int(draw.choice([16, 32, 40]))), lambda: "sk-" + hexes(32), lambda: "key=" + hexes(16),
        lambda: mixed(upper, 20), lambda: mixed(upper, int(draw.integers(16, 30))), lambda: mixed(upper + lower, int(draw.integers(20, 41))), lambda: "pw=" + mixed(lower, 18),
        lambda: "".join(draw.choice(list(upper + lower), int(draw.integers(24, 41)))),
    ]
    kinds = {
        "x_email": lambda: [f"{draw.choice(plain)}{digits(2)}@{draw.choice(plain)}{draw.choice(['', '.local', '.example.org'])}"],
        "x_ip": lambda: [".".join(digits(int(draw.integers(1, 4))) for _ in range(4))],
        "x_card": lambda: [str(draw.choice(list("._"))).join(digits(4) for _ in range(4))] if draw.random() < 0.4 else [digits(4) for _ in range(4)],
        "x_phone": lambda: draw.choice(["555-" + digits(4), f"({digits(3)})-{digits(3)}-{digits(4)}", "0" + digits(9), f"{digits(3)}-{digits(3)}-{digits(4)}"], 1).tolist() if draw.random() < 0.6 else [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
        "secret": lambda: [str(draw.choice(secrets)())],
    }
    out = []
    for _ in range(600):
        words, labels = [], []
        for _ in range(int(draw.integers(2, 5))):
            n = int(draw.integers(1, 5))
            words += draw.choice(plain, n).tolist()
            labels += ["none"] * n
            if draw.random() < 0.55:
                kind = str(draw.choice(LABELS[1:]))
                more = kinds[kind]()
                if draw.random() < 0.3:
                    more[-1] += str(draw.choice(list(".,;!")))
            else:
                # an unbroken run of digits that is a card is found by the patterns; others are numbers of another kind
                kind, more = "none", [digits(int(draw.integers(10, 20))) if draw.random() < 0.15 else str(draw.choice(harmless))]
            words += more
            labels += [kind] * len(more)
        out.append((" ".join(words), labels))
    return out


def _emissions(field: Field, words: wordbatch.Words) -> tuple[np.ndarray, np.ndarray]:
    marked, ids = shapes(words.data, words.start, words.end)
    return marked, field.emit[ids].sum(axis=1)


def train(table: list[tuple[str, list[str]]] | None = None, rounds: int = 150, rate: float = 0.4, penalty: tuple[float, float, float] = (2e-4, 3e-2, 3e-2)) -> Field:
    """Maximum likelihood by AdaGrad, with forward and backward sums over all sentences at once.

    ``penalty``: of the squares of emission, transition and start weights; transitions
    are held small, so that a word without marks surely is free (see ``decode``).
    """
    table = table if table is not None else labelled()
    words = wordbatch.split([s.encode() for s, _ in table], lower=False)
    gold = np.array([LABELS.index(x) for _, labels in table for x in labels], np.int64)
    n, most = len(LABELS), int(words.per_text().max())
    design = np.zeros((len(words.start), FEATURES))
    marked, ids = shapes(words.data, words.start, words.end)
    design[:, 0] = 1
    design[marked, 0] = 0
    np.put_along_axis(block := np.zeros((len(marked), FEATURES)), ids, 1.0, axis=1)
    design[marked] = block
    place = np.concatenate([np.arange(k) for k in words.per_text()])
    grid = np.zeros((len(table), most), bool)
    grid[words.owner, place] = True
    theta = [np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros(n)]
    squares = [np.full_like(t, 1e-6) for t in theta]
    last = words.per_text() - 1
    rows = np.arange(len(table))
    follows = place[1:] > 0
    seen_move = np.zeros((n, n))
    np.add.at(seen_move, (gold[:-1][follows], gold[1:][follows]), 1)
    seen = [design.T @ np.eye(n)[gold], seen_move, np.bincount(gold[place == 0], minlength=n).astype(float)]
    peak = lambda x, axis: (m := x.max(axis=axis, keepdims=True)) + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))
    for _ in range(rounds):
        emit = np.zeros((len(table), most, n))
        emit[words.owner, place] = design @ theta[0]
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = theta[2] + emit[:, 0]
        for t in range(1, most):
            alpha[:, t] = peak(alpha[:, t - 1, :, None] + theta[1], 1)[:, 0] + emit[:, t]
        for t in range(most - 2, -1, -1):
            step = peak(theta[1] + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)[:, :, 0]
            beta[:, t] = np.where((t < last)[:, None], step, 0)
        total = peak(alpha[rows, last], 1)[:, 0]
        share = np.exp(alpha + beta - total[:, None, None]) * grid[:, :, None]
        move = np.zeros((n, n))
        for t in range(most - 1):
            on = grid[:, t + 1]
            move += np.exp(alpha[on, t, :, None] + theta[1] + (emit[on, t + 1] + beta[on, t + 1])[:, None, :] - total[on, None, None]).sum(axis=0)
        expected = [design.T @ share[words.owner, place], move, share[:, 0].sum(axis=0)]
        for k in range(3):
            gradient = (seen[k] - expected[k]) / len(table) - penalty[k] * theta[k]
            squares[k] += gradient**2
            theta[k] += rate / np.sqrt(squares[k]) * gradient
    return Field(*theta)


def decode(field: Field, words: wordbatch.Words) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, label numbers) of the words whose label in the best path of their text isn't "none"."""
    marked, emit = _emissions(field, words)
    if not len(marked) and (surely_free(field) or not len(words.start)):
        return marked, marked
    if not surely_free(field):
        every = np.tile(field.emit[0], (len(words.start), 1))
        every[marked] = emit
        marked, emit = np.arange(len(words.start)), every
    # Only marked words can have a label; each run of them in a text is a chain between sure words or text ends.
    joined = np.zeros(len(marked), bool)
    joined[1:] = (marked[1:] == marked[:-1] + 1) & (words.owner[marked[1:]] == words.owner[marked[:-1]])
    first = np.flatnonzero(~joined)
    length = np.diff(np.r_[first, len(marked)])
    at_start = (marked[first] == 0) | (words.owner[marked[first] - 1] != words.owner[marked[first]])
    final = marked[first + length - 1]
    at_end = (final == len(words.owner) - 1) | (words.owner[np.minimum(final + 1, len(words.owner) - 1)] != words.owner[final])
    order = np.argsort(-length, kind="stable")
    first, length, at_start, at_end = first[order], length[order], at_start[order], at_end[order]
    score = np.where(at_start[:, None], field.begin, field.move[0]) + emit[first]
    back = np.zeros(emit.shape, np.int8)
    for t in range(1, int(length[0])):
        live = int(np.searchsorted(-length, -t, side="left"))  # runs longer than t come first
        ways = score[:live, :, None] + field.move[None]
        back[first[:live] + t] = ways.argmax(axis=1)
        score[:live] = ways.max(axis=1) + emit[first[:live] + t]
    label = np.zeros(len(marked), np.int64)
    now = (score + np.where(at_end[:, None], 0, field.move[:, 0])).argmax(axis=1)
    for t in range(int(length[0]) - 1, -1, -1):
        live = int(np.searchsorted(-length, -t, side="left"))
        here = first[:live] + t
        label[here] = now[:live]
        now[:live] = back[here, now[:live]] if t else now[:live]
    found = label > 0
    return marked[found], label[found]


def surely_free(field: Field) -> bool:
    """Whether "none" is the best label of a word without marks, whatever the labels beside it."""
    before = np.maximum((field.move - field.move[:, :1]).max(axis=0), field.begin - field.begin[0])
    after = np.maximum((field.move - field.move[:1]).max(axis=1), 0)
    return bool((field.emit[0, 0] - field.emit[0, 1:] > (before + after)[1:]).all())


def _code_points(raw: bytes, at: list[int]) -> list[int]:
    """The number of code points before each of the byte offsets ``at``, in time in proportion to the text."""
    if not at or raw.isascii():
        return at
    places, back = np.unique(np.array(at, np.int64), return_inverse=True)
    begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    parts = np.add.reduceat(np.r_[begins, False], np.r_[0, places], dtype=np.int64)
    parts = np.where(np.r_[0, places] < np.r_[places, len(raw)], parts, 0)
    return np.cumsum(parts[:-1])[back].tolist()


def all_spans(field: Field, texts: list[bytes]) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, spans the field adds) of each text."""
    words = wordbatch.split(texts, lower=False)
    number, label = decode(field, words)
    out = [(base_spans(t.decode()), []) for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(lengths) - lengths
    runs: list[list[int]] = []
    for w, k in zip(number.tolist(), label.tolist(), strict=True):
        if runs and runs[-1][1] == w - 1 and runs[-1][2] == k and words.owner[w] == words.owner[w - 1]:
            runs[-1][1] = w
        else:
            runs.append([w, w, k])
    found: dict[int, list[tuple[int, int, int]]] = {}
    for low, high, k in runs:
        doc = int(words.owner[low])
        a, b = int(words.start[low] - begin[doc]), int(words.end[high] - begin[doc])
        raw = texts[doc]
        while b > a and raw[b - 1] in b".,;:!?\"')]":
            b -= 1
        while a < b and raw[a] in b"\"'([":
            a += 1
        if a < b:
            found.setdefault(doc, []).append((k, a, b))
    for doc, spans in found.items():
        points = _code_points(texts[doc], [x for _, a, b in spans for x in (a, b)])
        base = sorted((x, y) for _, x, y in out[doc][0])
        starts, furthest = [x for x, _ in base], list(accumulate((y for _, y in base), max))
        for (k, _, _), start, end in zip(spans, points[::2], points[1::2], strict=True):
            before = bisect_right(starts, start)
            if not before or furthest[before - 1] < end:
                out[doc][1].append((LABELS[k], start, end))
    return out


def _ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (ALL_KINDS.index(x[0]), x[1]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, base_spans and spans (strings kind:start:end, comma-joined) of each row's whole text."""
    field = field or train()
    common.prepare(docs.sparkSession)

    def make():
        def work(batch):
            both = all_spans(field, common.text_bytes(batch))
            return {"doc_id": batch.column(0), "base_spans": pa.array([_written(_ordered(x)) for x, _ in both], pa.string()), "spans": pa.array([_written(_ordered(x + y)) for x, y in both], pa.string())}

        return work

    return common.map_steps(common.doc_texts(docs), make, "doc_id long, base_spans string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first and longest stands for all."""
    out, at = [], 0
    merged: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if merged and a < merged[-1][2]:
            merged[-1] = (merged[-1][0], merged[-1][1], max(b, merged[-1][2]))
        else:
            merged.append((kind, a, b))
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.removeprefix('x_').upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data in ``text`` replaced; null text stays null."""
    field = field or train()
    common.prepare(docs.sparkSession)

    def make():
        def work(batch):
            raw = common.text_bytes(batch)
            null = batch.column(batch.schema.get_field_index("text")).is_null().to_pylist()
            texts = [None if gone else redact(t.decode(), x + y) if x or y else t.decode() for t, (x, y), gone in zip(raw, all_spans(field, raw), null, strict=True)]
            return common.put_column(batch, "text", pa.array(texts, pa.string()))

        return work

    return common.map_steps(docs, make, docs.schema)
