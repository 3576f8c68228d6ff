"""Toxicity: a lexicon learned from labels, matched through Levenshtein automata, weighed by its surroundings.

Words and word stems that labelled documents show to be toxic form a trie. A text's word is matched exactly or by
intersecting its Levenshtein automaton with the trie, so misspelled terms count. A window around each match tells
a quotation or report from abuse. A logistic model over the matches gives the score.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsflow.llm.common import map_batches, once, texts_of
from newsflow.llm.language_id import held_out
from newsflow.session import cut


@dataclass(frozen=True)
class Lexicon:
    #: At most so many labelled documents of each class are learned from, those with the smallest hashes of their ids.
    toxic_documents: int = 4_000
    clean_documents: int = 16_000
    #: Distinct surroundings that a term needs, and the chance to see as many in toxic texts by accident.
    support: int = 6
    chance: float = 1e-7
    precision: float = 0.9
    stem_lengths: tuple[int, ...] = (4, 5, 6)
    stem_words: int = 3
    #: Length of a term from which one and two edits of it are let pass; two neighbours that change places are one edit.
    one_edit: int = 4
    two_edits: int = 9
    #: Shorter words are no terms.
    shortest_term: int = 3
    #: Characters looked at on either side of a match.
    window: int = 60
    threshold: float = 0.7
    cached_words: int = 600_000


WORD = re.compile(r"[^\W_]+")
State = tuple[tuple[int, ...], tuple[int, ...], str]
# Quotation marks, and words that introduce what somebody else said.
QUOTES = "\"“”„«»‹›"
REPORTS = frozenset("said says wrote writes quoted quote quotes called reported term word sagte schrieb zitat nannte wort dit écrit cité mot terme dijo escribió cita llamó palabra".split())


@dataclass
class Trie:
    """Terms by letters; `end` names the term that ends here."""

    next: dict[str, Trie] = field(default_factory=dict)
    end: str | None = None

    def add(self, term: str) -> None:
        at = self
        for c in term:
            at = at.next.setdefault(c, Trie())
        at.end = term


class LevenshteinAutomaton:
    """All strings within `edits` edits of a word, a swap of neighbours being one edit.

    A state is the row of edit counts, capped one above the limit, with the row before it and the letter between them,
    which a swap needs.
    """

    def __init__(self, word: str, edits: int) -> None:
        self.word, self.edits = word, edits

    def start(self) -> State:
        return tuple(min(i, self.edits + 1) for i in range(len(self.word) + 1)), (), ""

    def step(self, state: State, c: str) -> State:
        (now, before, last), cap, word = state, self.edits + 1, self.word
        row = [min(now[0] + 1, cap)]
        for i, own in enumerate(word):
            best = min(row[i] + 1, now[i] + (own != c), now[i + 1] + 1, cap)
            if i and before and own == last and word[i - 1] == c:
                best = min(best, before[i - 1] + 1)
            row.append(best)
        return tuple(row), now, c

    def intersect(self, trie: Trie) -> list[tuple[int, str]]:
        """(edits, term) of the trie's terms that the automaton accepts."""
        out, todo = [], [(trie, self.start())]
        while todo:
            node, state = todo.pop()
            if node.end is not None and state[0][-1] <= self.edits:
                out.append((state[0][-1], node.end))
            for c, child in node.next.items():
                following = self.step(state, c)
                # A swap may still come back to the row before.
                if min(following[0]) <= self.edits or min(state[0]) < self.edits:
                    todo.append((child, following))
        return sorted(out)


def _shorter(word: str) -> list[str]:
    """The word with one letter left out, for each of its letters."""
    return [word[:i] + word[i + 1 :] for i in range(len(word))]


class Matcher:
    """Edits between a word and the closest term, kept by word up to a limit; None without a match."""

    def __init__(self, words: list[str], stems: list[str], genuine: frozenset[str], options: Lexicon) -> None:
        self.words, self.stems, self.genuine, self.options = frozenset(words), frozenset(stems), genuine, options
        self.stem_lengths = sorted({len(s) for s in stems})
        self.trie = Trie()
        self.less: set[str] = set()
        self.parts: dict[int, dict[str, set[int]]] = {}
        self.longest = max(map(len, words), default=0)
        for term in words:
            # Also terms that a stem covers: the stem is compared exactly, so a misspelling inside it needs the term.
            if len(term) >= options.one_edit:
                self.trie.add(term)
                self.less.update([term], _shorter(term))
            if len(term) >= options.two_edits:
                self._split(term)
        self.kept: dict[str, int | None] = {}

    def edits(self, word: str) -> int | None:
        if word in self.kept:
            return self.kept[word]
        if len(self.kept) >= self.options.cached_words:
            self.kept = {}
        out = self.kept[word] = self.find(word)
        return out

    def _split(self, term: str) -> None:
        """Pieces of which a string within two edits of the term has one unchanged, two places off at most."""
        one, two = len(term) // 3, 2 * len(term) // 3
        swapped = lambda i: term[: i - 1] + term[i] + term[i - 1] + term[i + 1 :]
        pieces = [(0, term[:one]), (one, term[one:two]), (two, term[two:])]
        # A swap across a cut touches two thirds at once; with the other edit in the last one, these two are as swapped.
        pieces += [(0, swapped(one)[:two]), (one, swapped(two)[one:])]
        both = swapped(one)
        pieces.append((0, both[: two - 1] + both[two] + both[two - 1] + both[two + 1 :]))
        for first, piece in pieces:
            self.parts.setdefault(len(piece), {}).setdefault(piece, set()).update(range(first - 2, first + 3))

    def find(self, word: str) -> int | None:
        if word in self.words or any(word[:n] in self.stems for n in self.stem_lengths):
            return 0
        if not self.options.one_edit - 1 <= len(word) <= self.longest + 2 or word in self.genuine:
            return None
        allowed = self.maybe(word)
        if not allowed:
            return None
        for edits, term in LevenshteinAutomaton(word, allowed).intersect(self.trie):
            if edits < 2 or len(term) >= self.options.two_edits:
                return edits
        return None

    def maybe(self, word: str) -> int:
        """The most edits that a term may be away, 0 if certainly none is near: what spares most words the automaton."""
        if len(word) >= self.options.two_edits - 2 and any(
            i in held.get(word[i : i + n], ()) for n, held in self.parts.items() for i in range(len(word) - n + 1)
        ):
            return 2
        # Strings one edit apart agree once each has lost a letter at most.
        return int(word in self.less or not self.less.isdisjoint(_shorter(word)))

    def features(self, text: str) -> tuple[int, int, int]:
        """Plain exact matches, plain misspelled ones, and quoted or reported ones."""
        low = text.lower()
        kept, exact, near, told = self.kept, 0, 0, 0
        fresh = {w for w in WORD.findall(low) if kept.get(w, 0) is not None}
        hits = {w: e for w in fresh if (e := self.edits(w)) is not None}
        if not hits:
            return 0, 0, 0
        for m in WORD.finditer(low):
            edits = hits.get(m[0])
            if edits is None:
                continue
            left, right = low[max(0, m.start() - self.options.window) : m.start()], low[m.end() : m.end() + self.options.window]
            quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES)
            if quoted or REPORTS & set(WORD.findall(left)[-3:]):
                told += 1
            elif edits:
                near += 1
            else:
                exact += 1
        return exact, near, told


def _sample(rows: DataFrame, labels: DataFrame, options: Lexicon) -> DataFrame:
    """(text, toxic) of a bounded number of labelled rows that are not held out."""
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.filter(~held_out())
    first = lambda toxic, n: marks.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, options.toxic_documents).unionByName(first(0, options.clean_documents))
    return cut(rows.join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")))


def _chance(k: int, n: int, q: float) -> float:
    """Log of the largest term of the chance that k of n surroundings are toxic, each with chance q."""
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(q) + (n - k) * math.log(max(1 - q, 1e-9))


def learn(sample: DataFrame, options: Lexicon) -> tuple[list[str], list[str]]:
    """Toxic words and stems: those that many different surroundings in toxic texts have and clean texts lack.

    Surroundings are the words before and after, so that copies of a text count once.
    """
    lengths = options.stem_lengths

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows: set[tuple] = set()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                for before, w, after in zip(["", *words[:-1]], words, [*words[1:], ""], strict=True):
                    if len(w) >= options.shortest_term:
                        rows.add((w, w, before + " " + after, toxic))
            if len(rows) > options.cached_words:
                yield _columns(rows)
                rows.clear()
        yield _columns(rows)

    def _columns(rows: set[tuple]) -> dict:
        return {k: [r[i] for r in rows] for i, k in enumerate(("term", "word", "around", "toxic"))}

    seen = map_batches(sample, "term string, word string, around string, toxic int", body)
    counted = cut(seen.groupBy("word", F.xxhash64("around").alias("around")).agg(F.max("toxic").alias("toxic")))
    whole, bad = counted.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == whole:
        return [], []
    stems = F.array_compact(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in lengths]))
    terms = counted.select("word", "toxic", F.lit(False).alias("stem"), F.col("word").alias("term")).unionByName(
        counted.select("word", "toxic", F.lit(True).alias("stem"), F.explode(stems).alias("term"))
    )
    by_word = terms.groupBy("term", "stem", "word").agg(F.sum("toxic").alias("k"), F.count("*").alias("n"))
    sums = by_word.groupBy("term", "stem").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("words"))
    good = sums.filter((F.col("k") >= options.support) & (F.col("k") >= options.precision * F.col("n")) & (~F.col("stem") | (F.col("words") >= options.stem_words)))
    # The sample is bounded, and so is what enough of its surroundings show.
    rows = good.orderBy(F.desc("k"), "term", "stem").collect()
    sure = [r for r in rows if _chance(r["k"], r["n"], bad / whole) < math.log(options.chance)]
    stems_found: list[str] = []
    for s in sorted((r["term"] for r in sure if r["stem"]), key=lambda s: (len(s), s)):
        if not any(s.startswith(t) for t in stems_found):
            stems_found.append(s)
    return sorted(r["term"] for r in sure if not r["stem"]), stems_found


def _genuine(sample: DataFrame, matcher: Matcher, options: Lexicon) -> frozenset[str]:
    """Words of the sample's clean texts that are near a term without being a misspelling of it, however many."""

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words = {w for b in batches for t in b.column(0).to_pylist() for w in WORD.findall(t.lower())}
        yield {"word": [w for w in words if matcher.find(w)]}

    return frozenset(r["word"] for r in map_batches(sample.filter("toxic = 0").select("text"), "word string", body).distinct().collect())


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a weak prior: quoted matches speak against abuse until data says otherwise."""
    prior, weight = np.array([0.0, 4.0, 0.0, 0.0, -0.5]), np.array([1e-3, 0.1, 0.5, 0.5, 0.5])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - weight * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(weight)
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _design(found: np.ndarray) -> np.ndarray:
    """One, whether there is a plain match, plain matches, misspelled ones by themselves, quoted ones."""
    exact, near, told = found.T
    return np.column_stack([np.ones(len(found)), np.minimum(1, exact + 0.9 * near), np.log1p(exact + near), np.log1p(near), np.log1p(told)])


def toxicity(docs: DataFrame, labels: DataFrame, options: Lexicon = Lexicon()) -> DataFrame:
    """Score and prediction of each row of (doc_id, text), learned from labelled rows that are not held out.

    Empty and null texts have no matches and get the score of such texts. Without labels of both kinds the score is the
    share of toxic labels (0 without any). Repeated rows and null ids are kept. Labels of one document that differ
    count as toxic. Other columns are not read.
    """
    rows = texts_of(docs).withColumn("held_out", held_out())
    sample = _sample(rows, labels, options)
    words, stems = learn(sample, options)
    matcher = Matcher(words, stems, frozenset(), options)
    genuine = _genuine(sample, matcher, options) if words else frozenset()
    given = docs.sparkSession.sparkContext.broadcast((words, stems, genuine))
    name = f"toxicity:{uuid.uuid4().hex}"

    def found(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        own = once(name, lambda: Matcher(*given.value, options))
        for batch in batches:
            yield batch, np.array([own.features(t) for t in batch.column(at).to_pylist()], float).reshape(-1, 3)

    def of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, x in found(batches, 0):
            yield {"a": x[:, 0].astype(int), "b": x[:, 1].astype(int), "c": x[:, 2].astype(int), "toxic": batch.column(1)}

    counts = map_batches(sample, "a int, b int, c int, toxic int", of_sample).groupBy("a", "b", "c", "toxic").agg(F.count("*").alias("n")).collect()
    counts = sorted(counts, key=lambda r: (r["a"], r["b"], r["c"], r["toxic"]))
    x = np.repeat([[r["a"], r["b"], r["c"]] for r in counts], [r["n"] for r in counts], axis=0).reshape(-1, 3).astype(float)
    y = np.repeat([r["toxic"] for r in counts], [r["n"] for r in counts]).astype(float)
    share = float(y.mean()) if len(y) else 0.0
    weights = _fit(_design(x), y) if 0 < share < 1 else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch, x in found(batches, 1):
            p = np.full(len(x), share) if weights is None else 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))
            yield {"doc_id": batch.column(0), "held_out": batch.column(2), "score": p, "predicted": (p >= options.threshold).astype(int)}

    return map_batches(rows, "doc_id long, held_out boolean, score double, predicted int", score)
