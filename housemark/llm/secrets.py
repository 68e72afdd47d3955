"""Secret scans: fixed patterns, and formats inferred from what they find.

Credentials that the patterns find are the labelled examples: for each kind a probabilistic
automaton is inferred from them (``grammar``). Every run of credential characters, or what the
patterns' spans leave of it, is then scored: how much likelier its best automaton makes it than
ordinary runs of such characters do. Runs above ``LEAST_GAIN`` become spans of the kind
``learned``.

Examples are a bounded sample, the ``EXAMPLES`` distinct values of smallest hash for each
kind and for ordinary runs: every task keeps that many, and so does the driver, whatever the
size of the corpus. The scan covers every character of every text.
"""

import heapq
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from housemark.llm.grammar import Automaton, Pairs
from housemark.sources.scratch import stage

# The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"api")
LEAST_ASSIGNED = 12
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
LEAST_RUN = 12
RUN = re.compile(rb"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_RUN)
RUN_SYMBOLS = 69

EXAMPLES = 500
LEAST_GAIN = 20.0
MASK = "[SECRET]"

_CACHED = 200_000
_LONGEST_CACHED = 256
_SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.IntegerType())
    .add("end", T.IntegerType())
)

Found = tuple[str, int, int]
Gain = Callable[[str], float]


def base_spans(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[Found, tuple[int, int]]]:
    """Spans of the fixed patterns in bytes, each with the place of the credential in it.

    Keys and hexadecimal strings lie inside ``runs``, all matches of ``RUN``.
    """
    found = []
    lower = raw.lower()
    if any(k in lower for k in KEYWORDS):
        for m in ASSIGN.finditer(raw):
            if m.end(2) - m.start(2) >= LEAST_ASSIGNED:
                found.append((("assign", *m.span()), m.span(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for a, b in runs:
            found += [((kind, *m.span()), m.span()) for m in pattern.finditer(raw, a, b)]
    return found


def _outside(runs: list[tuple[int, int]], found: list[Found]) -> list[tuple[int, int]]:
    """What spans leave of the runs, as far as it is long enough: one sweep over both."""
    if not found:
        return runs
    spans = sorted((s, e) for _, s, e in found)
    left, at, covered = [], 0, 0
    for a, b in runs:
        while at < len(spans) and spans[at][0] < b:
            start, end = spans[at]
            left.append((max(a, covered), start))
            covered = max(covered, end)
            at += 1
        left.append((max(a, covered), b))
    return [(a, b) for a, b in left if b - a >= LEAST_RUN]


def _runs(raw: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(raw)]


def examples(docs: DataFrame, text: str = "text", most: int = EXAMPLES) -> dict[str, list[str]]:
    """Distinct values of smallest hash for each kind, and for ``""`` the ordinary runs."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {k: {} for k in (*KINDS, "")}
        limit = dict.fromkeys(held, 1 << 64)

        def offer(kind: str, value: bytes) -> None:
            order = xxhash.xxh64_intdigest(value)
            if order < limit[kind]:
                held[kind][value] = order
                if len(held[kind]) > 2 * most:
                    kept = heapq.nsmallest(most, held[kind].items(), key=lambda x: x[1])
                    held[kind] = dict(kept)
                    limit[kind] = kept[-1][1]

        for batch in batches:
            for raw in batch.column(0).cast(pa.binary()).to_pylist():
                raw = raw or b""
                runs = _runs(raw)
                found = base_spans(raw, runs)
                for (kind, _, _), (a, b) in found:
                    offer(kind, raw[a:b])
                for a, b in _outside(runs, [x for x, _ in found]):
                    offer("", raw[a:b])
        rows = [
            (kind, value.decode(), order.to_bytes(8))
            for kind, values in held.items()
            for value, order in heapq.nsmallest(most, values.items(), key=lambda x: x[1])
        ]
        yield pa.RecordBatch.from_pydict(
            {
                "kind": pa.array([r[0] for r in rows], pa.string()),
                "value": pa.array([r[1] for r in rows], pa.string()),
                "hash": pa.array([r[2] for r in rows], pa.binary()),
            }
        )

    kept = docs.select(text).mapInArrow(smallest, "kind string, value string, hash binary")
    kept = stage(kept.distinct(), "examples")
    order = kept.orderBy("hash", "value")
    return {
        kind: [r.value for r in order.where(F.col("kind") == kind).limit(most).collect()]
        for kind in (*KINDS, "")
    }


def learn(found: dict[str, list[str]]) -> Gain:
    """How many nats the best automaton of a kind gains on ordinary runs for a string."""
    automata = [Automaton(found[k]) for k in KINDS if found[k]]
    ordinary = Pairs(found[""], RUN_SYMBOLS)

    def gain(value: str) -> float:
        if not automata:
            return -float("inf")
        return max(a.log_likelihood(value) for a in automata) - ordinary.log_likelihood(value)

    return gain


def spans(raw: bytes, gain: Gain, known: dict[bytes, float], least_gain: float) -> list[Found]:
    """All spans of a text in code points, by start and then kind; ``known`` caches gains."""
    runs = _runs(raw)
    found = [x for x, _ in base_spans(raw, runs)]
    for a, b in _outside(runs, found):
        value = raw[a:b]
        own = known.get(value)
        if own is None:
            own = gain(value.decode())
            if len(known) >= _CACHED:
                known.clear()
            if len(value) <= _LONGEST_CACHED:
                known[value] = own
        if own >= least_gain:
            found.append(("learned", a, b))
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    if found and not raw.isascii():
        places, at, points = {}, 0, 0
        for place in sorted({p for _, a, b in found for p in (a, b)}):
            points += len(raw[at:place].decode(errors="replace"))
            places[place], at = points, place
        found = [(kind, places[a], places[b]) for kind, a, b in found]
    return found


def masked(text: str, found: list[Found]) -> str:
    """The text with each stretch of overlapping spans replaced by ``MASK``."""
    parts, at = [], 0
    for _, start, end in found:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join(parts) + text[at:]


def with_spans(
    docs: DataFrame,
    text: str = "text",
    least_gain: float = LEAST_GAIN,
    most_examples: int = EXAMPLES,
    mask: bool = False,
) -> DataFrame:
    """``docs`` plus ``secrets``, an array of (kind, start, end) in code points, end exclusive.

    Spans stand by start and then kind; a null text has none and stays null. With ``mask``
    they are replaced in the text, and ``secrets`` tells where they were. A corpus without
    credentials has no automata, so that nothing is added to the patterns' spans. An
    existing column ``secrets`` is replaced. Equal texts, such as repeated rows, have equal spans;
    examples with equal hashes stand by their value. An empty table gives an empty one. A text of
    any length is scanned whole, in time that grows with it. Reads ``docs`` twice.
    """
    docs = docs.drop("secrets")
    names = docs.columns
    gain = learn(examples(docs, text, most_examples))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float] = {}
        kind = pa.list_(
            pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        )
        for batch in batches:
            columns = list(batch.columns)
            at = names.index(text)
            texts = columns[at].cast(pa.binary()).to_pylist()
            found = [spans(raw or b"", gain, known, least_gain) for raw in texts]
            if mask:
                columns[at] = pa.array(
                    [
                        None if raw is None else masked(raw.decode(errors="replace"), own)
                        for raw, own in zip(texts, found)
                    ],
                    pa.string(),
                )
            rows = [[dict(zip(("kind", "start", "end"), x)) for x in own] for own in found]
            columns.append(pa.array(rows, kind))
            yield pa.RecordBatch.from_arrays(columns, [*names, "secrets"])

    added = T.StructField("secrets", _SPANS)
    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, added]))


def count(secrets: str, kind: str) -> Column:
    return F.size(F.filter(secrets, lambda x: x["kind"] == kind)).cast("long")


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    parts = F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"]))
    return F.array_join(parts, ",")
