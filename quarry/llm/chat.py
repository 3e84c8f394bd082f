r"""Chat formatting by a black-box renderer, with the span of every turn.

A renderer maps a list of (role, text) to one string. Nothing is known of its template.
For each turn the prefix of turns that ends with it is rendered and compared with the output for the
prefix before. If the longer output starts with the shorter one, the rest is the turn's span; if not,
the template rewrites its history, and the turn is marked ``rewrites``. Where the text lies within the
span is found by rendering the last turn with two probe texts: what both outputs share at their start and end is
the template's.

Every prefix is rendered whole, from the first turn, and all turns of one conversation are held, as a template
that nothing is known of may look at all of them: time goes with the square of a conversation's turns. If no turn rewrites, a turn's
span stands when the next begins. If one does, spans are those of the last rendering: each text is found
in it by two probes, and a turn ends where its prefix's output and the last one part. So the rows of a conversation
joined are what the template gives for all turns; a turn that the template has left out has an empty span.

A template known to look back at most ``window - 1`` turns and never to rewrite can be declared so. Then prefixes start that many turns back,
conversations are read as a stream and time goes with their turns. The declaration is tested: whenever
the number of turns has doubled the whole conversation is rendered and compared (while its texts are under
CHECK_CHARS characters, so that memory is bounded), as is any rewriting inside the window; a mismatch raises ValueError.

Rows of a conversation are taken in the order of turn (null first), then role, then text, so that ties and
repeated rows have one order. Null roles and texts count as empty. Rows
whose conv_id is null are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: A window for templates that are declared to need no more turns; the query has none.
WINDOW = 8
#: Characters of texts up to which a declared window is tested against the whole conversation.
CHECK_CHARS = 16 << 20
Renderer = Callable[[list[tuple[str, str]]], str]
TURN_SCHEMA = "conv_id long, turn long, role string, start long, end long, text_start long, text_end long, loss boolean, rewrites boolean, formatted string"

#: Control strings of the template below; a backslash stands before each inside a text, and before each backslash.
OPEN, CLOSE = "### ", "</turn>"
_ESCAPED = re.compile(r"\\|### |</turn>")
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    if "\\" not in text and OPEN not in text and CLOSE not in text:  # as whole prefixes are rendered, each text is seen many times
        return text
    return _ESCAPED.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: list[tuple[str, str]]) -> str:
    """The template of the pipeline: ``### role: text</turn>`` and a line end for each turn."""
    return "".join(f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: {escape(text)}{CLOSE}\n" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of what ``render`` wrote."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _shared(a: str, b: str) -> int:
    """Length of the common start, by halves of the first part that differs."""
    low, high, step = 0, min(len(a), len(b)), 256
    while low < high and a[low : low + step] == b[low : low + step]:
        low, step = low + step, 2 * step
    if low >= high:
        return high
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _text_span(renderer: Renderer, before: list[tuple[str, str]], role: str, text: str, after: list[tuple[str, str]], whole: str) -> tuple[int, int] | None:
    """Where the text of the turn between ``before`` and ``after`` lies in ``whole``; None if the template leaves it out. Of several places of a text the last is its own."""
    one, two = renderer([*before, (role, "a"), *after]), renderer([*before, (role, "b"), *after])
    if one == two:
        return None
    head = _shared(one, two)
    tail = _shared(one[head:][::-1], two[head:][::-1])
    end = max(head, len(whole) - tail)
    if len(one) - tail - head > 1 and whole.endswith(text, head, end):
        head = end - len(text)
    return head, end


def locate(renderer: Renderer, before: list[tuple[str, str]], role: str, text: str, shorter: str | None = None) -> tuple[str, int, int, int, bool]:
    """(whole output, start of the turn, start and end of its text, whether history was rewritten); ``shorter``: the output for ``before``."""
    if shorter is None:
        shorter = renderer(before) if before else ""
    whole = renderer([*before, (role, text)])
    rewrites = not whole.startswith(shorter)
    start = _shared(shorter, whole) if rewrites else len(shorter)
    head, end = _text_span(renderer, before, role, text, [], whole) or (start, start)
    return whole, start, head, end, rewrites


def spans(renderer: Renderer, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """(output for all turns; start, end, text start, text end and whether history was rewritten of each turn), from whole prefixes."""
    whole, out = "", []
    for k, (role, text) in enumerate(turns):
        whole, start, head, end, rewrites = locate(renderer, turns[:k], role, text, whole)
        out.append((start, len(whole), head, end, rewrites))
    if not any(x[-1] for x in out):
        return whole, out
    again, begin = [], 0
    for k, (role, text) in enumerate(turns):
        last = k + 1 == len(turns)
        stop = len(whole) if last else _shared(renderer(turns[: k + 1]), whole)
        inside = _text_span(renderer, turns[:k], role, text, turns[k + 1 :], whole)
        if inside:
            head, end = max(begin, inside[0]), max(begin, inside[1])
            after = None if last else _text_span(renderer, turns[: k + 1], *turns[k + 1], turns[k + 2 :], whole)
            stop = max(end, min(stop, after[0])) if after else max(end, stop)
        else:
            head = end = begin
            stop = len(whole) if last else begin
        again.append((begin, stop, head, end, out[k][-1]))
        begin = stop
    return whole, again


def formatted(conversations: DataFrame, renderer: Renderer = render, window: int | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each turn in order: its formatted text, its span and its text's span in the whole formatted
    conversation (code points, end exclusive), whether its text is under the loss mask, and whether history was rewritten.

    Rows of a conversation stay in one partition, in order. ``window``: turns that the template is declared to need.
    """
    common.prepare(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    def whole_prefixes(batches):
        conv, held = None, []

        def close():
            whole, found = spans(renderer, [(role, text) for _, role, text in held])
            return [(conv, turn, role, a, b, c, d, role in learn, again, whole[a:b]) for (turn, role, _), (a, b, c, d, again) in zip(held, found, strict=True)]

        for batch in batches:
            out = []
            for c, turn, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if held and c != conv:
                    out += close()
                    held = []
                conv = c
                held.append((turn, role, text))
            if out:
                yield batch_of(out)
        if held:
            yield batch_of(close())

    def windowed(batches):
        conv, before, at, n, first = None, [], 0, 0, True
        all_turns: list[tuple[str, str]] | None = []
        output: list[str] = []
        chars = 0
        for batch in batches:
            for part in common.steps(batch):
                out = []
                for c, turn, role, text in zip(*(x.to_pylist() for x in part.columns), strict=True):
                    if first or c != conv:
                        conv, before, at, n, first = c, [], 0, 0, False
                        all_turns, output, chars = [], [], 0
                    whole, start, text_start, text_end, rewrites = locate(renderer, before, role, text)
                    if rewrites:
                        raise ValueError("the template rewrites history; it cannot have a window")
                    shift, segment, n = at - start, whole[start:], n + 1
                    out.append((conv, turn, role, at, at + len(segment), text_start + shift, text_end + shift, role in learn, False, segment))
                    at += len(segment)
                    before = [*before, (role, text)][-(window - 1) :] if window > 1 else []
                    chars += len(text)
                    if chars > CHECK_CHARS:
                        all_turns, output = None, []
                    if all_turns is not None:
                        all_turns.append((role, text))
                        output.append(segment)
                        if n > window and n & (n - 1) == 0 and renderer(all_turns) != "".join(output):
                            raise ValueError(f"the template looks back further than {window} turns")
                yield batch_of(out)

    return rows.mapInArrow(whole_prefixes if window is None else windowed, TURN_SCHEMA)


_NAMES = [x.split()[0] for x in TURN_SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[x.split()[1]] for x in TURN_SCHEMA.split(", ")]


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites, read back from the rows of ``formatted``.

    It reads the stream that ``formatted`` gives, in its order, without dealing it anew.
    """

    def task(batches):
        conv, n, chars, loss, rewritten = None, 0, 0, 0, False
        all_turns, learnt, begun = hashlib.sha256(), hashlib.sha256(), False
        rows: list[tuple] = []

        def close():
            rows.append((conv, n, all_turns.hexdigest(), loss, learnt.hexdigest(), chars, rewritten))

        def batch_of():
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "start", "text_start", "text_end", "loss", "rewrites", "formatted")]
            for c, start, a, b, masked, again, segment in zip(*columns, strict=True):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, n, chars, loss, rewritten, begun = c, 0, 0, 0, False, True
                    all_turns, learnt = hashlib.sha256(), hashlib.sha256()
                for role, text in parse(segment):
                    all_turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if masked:
                    text = unescape(segment[a - start : b - start])
                    learnt.update(text.encode())
                    loss += len(text)
                chars += len(segment)
                rewritten |= again
            if len(rows) >= common.BATCH_ROWS:
                yield batch_of()
                rows = []
        if begun:
            close()
        if rows:
            yield batch_of()

    return turns.mapInArrow(task, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
