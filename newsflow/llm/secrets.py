"""Secret scan: fixed patterns, and automata inferred from what they find.

Credentials that the patterns find are the labelled strings. Their character classes form one prefix tree per kind;
states of a tree whose outcomes differ by less than a Hoeffding bound are merged, which leaves a probabilistic
automaton of the kind's format. Every other candidate string is scored by its likelihood under each automaton.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from newsflow.llm.common import byte_rows, map_batches, once, texts_of

KINDS = ("assign", "access", "hex", "format")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
DOTTED = r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*"
#: What joins a credential to its neighbours, left over where a base span is cut off.
JOINERS = "-_=+/."
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_MAP = bytes(49 if c in b"0123456789abcdef" else 32 for c in range(256))


@dataclass(frozen=True)
class Grammar:
    #: At most so many distinct credentials per kind are learned from, those with the smallest hashes.
    examples: int = 400
    #: Longer credentials are not learned from.
    longest_example: int = 256
    #: Confidence of the Hoeffding bound.
    alpha: float = 0.05
    #: Probability of a step that an automaton lacks.
    unseen: float = 1e-4
    #: Mean log ratio per character, against plain strings, from which a candidate is a secret.
    floor: float = 0.5
    #: Log ratio over the whole candidate that it needs as well: how short it may be follows from the automata.
    evidence: float = 20.0
    #: Candidates whose score a worker keeps.
    cached: int = 300_000


#: Character classes and their numbers of characters; others stand for themselves.
_CLASSES = {**{c: "9" for c in "0123456789"}, **{c: "f" for c in "abcdef"}, **{c: "F" for c in "ABCDEF"}}
_CLASSES |= {c: "z" for c in "ghijklmnopqrstuvwxyz"} | {c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}
_SIZES = {"9": 10, "f": 6, "F": 6, "z": 20, "Z": 20}
_ALPHABET = 67


def classes(value: str) -> str:
    return "".join([_CLASSES.get(c, c) for c in value])


class _Node:
    """A state: strings that came by, that ended here, that went on with each class, and where to."""

    __slots__ = ("ends", "next", "seen", "went")

    def __init__(self) -> None:
        self.seen, self.ends, self.next, self.went = 0, 0, {}, {}


def infer(values: list[str], alpha: float) -> list[tuple[float, dict[str, tuple[float, int]]]]:
    """States as (probability to end, {class: (probability, next state)}), the first being the start.

    Red states are settled; each blue child of a red one is folded into the first red state it is compatible with,
    or becomes red itself.
    """
    root = _Node()
    for value in sorted(values):
        at = root
        at.seen += 1
        for c in classes(value):
            at.went[c] = at.went.get(c, 0) + 1
            at = at.next.setdefault(c, _Node())
            at.seen += 1
        at.ends += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: _Node, b: _Node) -> bool:
        todo, past = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if differ(a.ends, a.seen, b.ends, b.seen):
                return False
            for c in a.next.keys() | b.next.keys():
                if differ(a.went.get(c, 0), a.seen, b.went.get(c, 0), b.seen):
                    return False
                if c in a.next and c in b.next and a.next[c] is not b.next[c] and (a.next[c], b.next[c]) not in past:
                    past.add((a.next[c], b.next[c]))
                    todo.append((a.next[c], b.next[c]))
        return True

    def fold(into: _Node, tree: _Node) -> None:
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            a.seen, a.ends = a.seen + b.seen, a.ends + b.ends
            for c, child in sorted(b.next.items()):
                a.went[c] = a.went.get(c, 0) + b.went[c]
                if c in a.next:
                    todo.append((a.next[c], child))
                else:
                    a.next[c] = child

    red = [root]
    while True:
        settled = {id(r) for r in red}
        blue = [(r, c, child) for r in red for c, child in sorted(r.next.items()) if id(child) not in settled]
        if not blue:
            break
        parent, c, child = max(blue, key=lambda x: x[2].seen)
        for r in red:
            if compatible(r, child):
                parent.next[c] = r
                fold(r, child)
                break
        else:
            red.append(child)
    number = {id(r): i for i, r in enumerate(red)}
    return [(r.ends / max(1, r.seen), {c: (r.went[c] / max(1, r.seen), number[id(to)]) for c, to in sorted(r.next.items())}) for r in red]


_PLAIN = ((re.compile(r"[0-9]+"), math.log(10)), (re.compile(r"[a-z]+"), math.log(26)), (re.compile(r"[A-Z]+"), math.log(26)))


def likelihood(value: str, states: list, unseen: float) -> float:
    """Mean log ratio per character between an automaton and plain strings.

    A plain string is one of uniform random characters, or of digits, small or capital letters alone, whichever is the
    likeliest: numbers and words are no credentials for fitting the alphabet of one.
    """
    at, total = 0, 0.0
    for c in classes(value):
        p, to = states[at][1].get(c, (unseen, at))
        total += math.log(max(p, unseen)) - math.log(_SIZES.get(c, 1))
        at = to
    plain = min([size for kind, size in _PLAIN if kind.fullmatch(value)], default=math.log(_ALPHABET))
    return total / max(1, len(value)) + plain


def least_length(automata: dict[str, list], options: Grammar) -> int:
    """Characters that the likeliest string of any automaton needs for the evidence asked for; 0 if none ever has it."""
    best = {(kind, 0): 0.0 for kind in automata}
    for n in range(1, 257):
        after: dict[tuple[str, int], float] = {}
        for (kind, at), total in best.items():
            for c, (p, to) in automata[kind][at][1].items():
                gain = total + math.log(max(p, options.unseen)) - math.log(_SIZES.get(c, 1)) + math.log(_ALPHABET)
                after[kind, to] = max(gain, after.get((kind, to), -math.inf))
        if max(after.values(), default=-math.inf) >= options.evidence:
            return n
        best = after
    return 0


def base_spans(raw: bytes, decoded: str | None = None) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of each base match in code points, given the UTF-8 bytes."""
    low = raw.lower()
    keyed = any(k in low for k in KEYWORDS)
    access, hexed = b"AKIA" in raw, b"1" * 24 in raw.translate(_HEX_MAP)
    if not (keyed or access or hexed):
        return []
    text = raw.decode() if decoded is None else decoded
    out = []
    if keyed:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if access:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if hexed:
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


class Scorer:
    """Scores of candidates under all automata, kept by a worker up to a limit."""

    def __init__(self, automata: dict[str, list], options: Grammar) -> None:
        self.automata, self.options, self.kept = list(automata.values()), options, {}
        self.least = least_length(automata, options)
        self.runs = re.compile(CANDIDATE % max(1, self.least))
        self.dotted = re.compile(DOTTED)

    def score(self, value: str) -> float:
        if value not in self.kept:
            if len(self.kept) >= self.options.cached:
                self.kept = {}
            self.kept[value] = max(likelihood(value, states, self.options.unseen) for states in self.automata)
        return self.kept[value]

    def passes(self, value: str) -> bool:
        mean = self.score(value)
        return mean >= self.options.floor and mean * len(value) >= self.options.evidence

    def spans(self, text: str, base: list) -> tuple[list[tuple[int, int, int, float]], float]:
        """The candidates that an automaton takes for a credential, and the best score of any.

        Candidates are the runs of credential characters, less what base spans cover: what is left on either side of
        one is a candidate of its own, without the characters that joined it. Runs joined by dots are tried as one if
        they do not pass by themselves.
        """
        best, out = -math.inf, []
        if not self.least or self.runs.search(text) is None and "." not in text:
            return out, best
        for start, end in self.pieces(text, base):
            value = text[start:end]
            if len(value) >= self.least:
                best = max(best, self.score(value))
                if self.passes(value):
                    out.append((start, 3, end, self.score(value)))
        if "." in text and any("." in states[1] for a in self.automata for states in a):
            held = sorted([b[:3] for b in base] + [m[:3] for m in out])
            for m in self.dotted.finditer(text):
                if "." in m[0] and len(m[0]) >= self.least and not any(s[0] < m.end() and s[2] > m.start() for s in held) and self.passes(m[0]):
                    best = max(best, self.score(m[0]))
                    out.append((m.start(), 3, m.end(), self.score(m[0])))
        return sorted(out), best

    def pieces(self, text: str, base: list) -> Iterator[tuple[int, int]]:
        covers, at = [], 0
        for b in sorted(b[:3:2] for b in base):
            if covers and b[0] <= covers[-1][1]:
                covers[-1][1] = max(covers[-1][1], b[1])
            else:
                covers.append(list(b))
        for m in self.runs.finditer(text):
            while at < len(covers) and covers[at][1] <= m.start():
                at += 1
            start, k = m.start(), at
            while k < len(covers) and covers[k][0] < m.end():
                yield self._bare(text, start, covers[k][0], m.start(), m.end())
                start, k = max(start, covers[k][1]), k + 1
            yield self._bare(text, start, m.end(), m.start(), m.end())

    @staticmethod
    def _bare(text: str, start: int, end: int, first: int, last: int) -> tuple[int, int]:
        """The piece without joining characters at the ends that were cut."""
        while start > first and start < end and text[start] in JOINERS:
            start += 1
        while end < last and start < end and text[end - 1] in JOINERS:
            end -= 1
        return start, end


def examples(docs: DataFrame, options: Grammar) -> dict[str, list[str]]:
    """A bounded number of distinct credentials of each base kind."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = {(KINDS[k], v) for raw in byte_rows(batch.column(0)) for _, k, _, v in base_spans(raw.tobytes()) if len(v) <= options.longest_example}
            yield {"kind": [r[0] for r in rows], "value": [r[1] for r in rows]}

    found = map_batches(texts_of(docs).select("text"), "kind string, value string", body).distinct()
    # A kind's rows are cut in many tasks before they meet in one.
    first = lambda rows, *keys: rows.withColumn("n", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.xxhash64("value"), "value"))).filter(F.col("n") <= options.examples)
    dealt = first(found.withColumn("deal", F.pmod(F.hash("value"), F.lit(64))), "kind", "deal")
    rows = first(dealt, "kind").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["value"])):
        out.setdefault(r["kind"], []).append(r["value"])
    return out


def automata_of(docs: DataFrame, options: Grammar) -> dict[str, list]:
    return {kind: infer(values, options.alpha) for kind, values in examples(docs, options).items()}


RESULTS = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, format_score double"


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def secrets(docs: DataFrame, options: Grammar = Grammar(), redact: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of (doc_id, text) with its spans in code points, ends exclusive, by start and then kind.

    n_assign, n_access and n_hex count the base matches, base and spans write the base and all spans as
    kind:start:end joined by commas, format_score is the best score of a candidate outside the base matches (null
    without one). Every run of credential characters, or what base matches leave of it, is a candidate if it is long
    enough for the evidence that any automaton can give. With `redact` the text comes back with each run of overlapping spans replaced by that string.
    A null or empty text has no spans. Repeated rows and null ids are kept; a table without matches has no automata
    and so no spans of kind format. `carry` names further columns to hand on; others are not read.
    """
    automata = automata_of(docs, options)
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    # Carried columns travel under numbers, so that no name of theirs can clash with a result's.
    names = [f"carry_{i}" for i in range(len(carry))]
    rows = docs.select("doc_id", "text", *[_named(c).alias(n) for c, n in zip(carry, names, strict=True)])
    schema = StructType.fromDDL(RESULTS + (", text string" if redact is not None else ""))
    for n in names:
        schema = schema.add(n, rows.schema[n].dataType)

    name = f"secrets:{uuid.uuid4().hex}"

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = once(name, lambda: Scorer(shared.value, options))
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans", "format_score", "text")}
            column = batch.column(1)
            for i, view in enumerate(byte_rows(column)):
                raw = view.tobytes()
                text = raw.decode()
                base = base_spans(raw, text)
                more, best = scorer.spans(text, base)
                for k in range(3):
                    out[("n_assign", "n_access", "n_hex")[k]].append(sum(b[1] == k for b in base))
                out["base"].append(written(base))
                out["spans"].append(written(sorted([b[:3] for b in base] + [m[:3] for m in more])) if more else out["base"][-1])
                out["format_score"].append(best if best > -math.inf else None)
                if redact is not None:
                    out["text"].append(blanked(text, base + more, redact) if base or more else column[i].as_py())
            yield out | {"doc_id": batch.column(0)} | {n: batch.column(2 + k) for k, n in enumerate(names)}

    return map_batches(rows, schema, body).toDF(*schema.names[: len(schema) - len(carry)], *carry)


def written(spans: list) -> str:
    return ",".join([f"{KINDS[s[1]]}:{s[0]}:{s[2]}" for s in spans])


def blanked(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for start, _, end, _ in sorted(spans, key=lambda s: (s[0], -s[2])):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str, options: Grammar = Grammar()) -> DataFrame:
    """The rows of documents, all their columns in order, each secret in a text replaced by the mark."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets(docs, options, mark, others)
    # By place: a carried column may bear the name of a result.
    numbered = found.toDF(*[f"c{i}" for i in range(len(found.columns))])
    first = len(found.columns) - len(others)
    place = {"doc_id": 0, "text": first - 1} | {c: first + i for i, c in enumerate(others)}
    return numbered.select(*[F.col(f"c{place[c]}").alias(c) for c in docs.columns])


def digests(docs: DataFrame, options: Grammar = Grammar()) -> DataFrame:
    return secrets(docs, options).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "format_score"
    )
