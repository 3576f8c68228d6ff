"""Language by unigram pieces, summed over all segmentations.

The pieces are those of a public vocabulary. Each language has a probability per piece, learned by expectation and
maximisation over all segmentations of its training words. A text's likelihood is the product over its words of
the sum over all ways to cut the word into pieces; pieces do not cross blanks, so words are scored once and kept.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsflow.llm.common import map_batches, once, texts_of
from newsflow.session import cut


@dataclass(frozen=True)
class LanguageModel:
    #: Name of a vocabulary file that public_tokenizers.path resolves, or a path.
    vocabulary: str = "piece_bpe_32k.model"
    #: At most so many labelled documents per language are learned from, those with the smallest hashes of their ids.
    documents_per_language: int = 2_000
    rounds: int = 2
    #: Count added to each piece.
    smoothing: float = 0.01
    #: Probability of a character that is no piece, the same in every language.
    unknown: float = 1e-6
    cached_words: int = 1_500_000
    undetermined: str = "und"


#: Starts a word in the vocabulary.
START = "▁"
#: Characters of texts whose words are scored together.
AT_ONCE = 1 << 20
#: Left out on either side of a word.
MARKS = ".,;:!?\"'()[]{}<>|/\\*#%&$+=_~`-–—…“”„«»‘’¿¡"
_LETTER = re.compile(r"[^\W\d_]")
_vocabularies: dict[str, frozenset[str]] = {}


def vocabulary(name: str) -> frozenset[str]:
    if name not in _vocabularies:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))
        _vocabularies[name] = frozenset(
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        )
    return _vocabularies[name]


def expected_pieces(word: str, prob: dict[str, float], default: float, pieces: frozenset[str], longest: int, unknown: float) -> tuple[dict[str, float], float]:
    """Expected count of each piece over all segmentations of a word, and the log of their total probability."""
    n = len(word)
    into: list[list[tuple[int, str, float]]] = [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - longest), j):
            s = word[i:j]
            if s in pieces:
                into[j].append((i, s, prob.get(s, default)))
        if not into[j] or into[j][-1][0] != j - 1:
            into[j].append((j - 1, "", unknown))
    # Sums in logarithms, so that long words do not vanish.
    low = -math.inf
    ahead = [0.0] + [low] * n
    for j in range(1, n + 1):
        terms = [ahead[i] + math.log(p) for i, _, p in into[j]]
        top = max(terms)
        ahead[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    back = [low] * n + [0.0]
    out: dict[str, float] = {}
    for j in range(n, 0, -1):
        for i, s, p in into[j]:
            t = back[j] + math.log(p)
            back[i] = t if back[i] == low else max(back[i], t) + math.log1p(math.exp(-abs(back[i] - t)))
            if s:
                out[s] = out.get(s, 0.0) + math.exp(ahead[i] + t - ahead[n])
    return out, ahead[n]


def train(labelled: DataFrame, model: LanguageModel) -> tuple[list[str], dict[str, list[float]], list[float], list[float]]:
    """Languages, piece probabilities by language, the probability of an unseen piece and the prior, from (text, lang)."""
    pieces_name, unknown, longest_cap = model.vocabulary, model.unknown, model.cached_words

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held: dict[str, Counter] = {}

        def out() -> dict:
            rows = [(lang, s, n) for lang, c in held.items() for w, n in c.items() if (s := w.strip(MARKS))]
            return {"lang": [r[0] for r in rows], "word": [r[1] for r in rows], "n": [r[2] for r in rows]}

        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(text.lower().split())
            if sum(map(len, held.values())) > longest_cap:
                yield out()
                held.clear()
        yield out()

    words = map_batches(labelled.select("text", "lang"), "lang string, word string, n long", count_words)
    words = cut(words.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(totals)
    size = len(vocabulary(pieces_name))
    probs: dict[str, dict[str, float]] = {lang: {} for lang in langs}
    defaults = dict.fromkeys(langs, 1.0 / size)
    for _ in range(model.rounds):
        now, unseen = probs, defaults

        def expect(batches: Iterator[pa.RecordBatch], now: dict = now, unseen: dict = unseen) -> Iterator[dict]:
            known = vocabulary(pieces_name)
            longest = max(map(len, known))
            sums: dict[tuple[str, str], float] = {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    counts, _ = expected_pieces(START + word, now[lang], unseen[lang], known, longest, unknown)
                    for s, c in counts.items():
                        sums[lang, s] = sums.get((lang, s), 0.0) + c * n
            yield {"lang": [k[0] for k in sums], "piece": [k[1] for k in sums], "n": list(sums.values())}

        # As many rows as pieces and languages at most.
        rows = map_batches(words, "lang string, piece string, n double", expect).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
        probs = {lang: {} for lang in langs}
        seen = dict.fromkeys(langs, 0.0)
        for r in rows:
            seen[r["lang"]] += r["n"]
        whole = {lang: seen[lang] + model.smoothing * size for lang in langs}
        for r in sorted(rows, key=lambda r: (r["lang"], r["piece"])):
            probs[r["lang"]][r["piece"]] = (r["n"] + model.smoothing) / whole[r["lang"]]
        defaults = {lang: model.smoothing / whole[lang] for lang in langs}
    table = {s: [probs[lang].get(s, defaults[lang]) for lang in langs] for s in sorted({s for p in probs.values() for s in p})}
    everything = sum(totals.values())
    return langs, table, [defaults[lang] for lang in langs], [math.log(totals[lang] / everything) for lang in langs]


class Scorer:
    """Log likelihood of words by language; words are scored once and kept up to a limit."""

    def __init__(self, table: dict[str, list[float]], unseen: list[float], model: LanguageModel) -> None:
        known = vocabulary(model.vocabulary)
        self.table: dict[str, list[float] | None] = {s: table.get(s, unseen) for s in known}
        #: Endings that are no pieces themselves: where none goes on, no longer piece ends.
        for s in known:
            for i in range(1, len(s)):
                self.table.setdefault(s[i:], None)
        self.longest, self.unknown, self.width = max(map(len, known)), [model.unknown] * len(unseen), len(unseen)
        self.limit, self.places = model.cached_words, {}
        self.scores = np.empty((model.cached_words, len(unseen)))
        #: The word scored last and its sums, unless it was rescaled.
        self.last, self.sums = "", [[1.0] * self.width]

    def word(self, word: str) -> list[float]:
        """The forward sum over all segmentations, rescaled where it gets small.

        The sums up to a place hang on the characters before it alone, so a word takes over those of what it has in
        common with the beginning of the word before it.
        """
        word = START + word
        n, width, table, longest = len(word), self.width, self.table, self.longest
        same, most = 0, min(n, len(self.last))
        while same < most and word[same] == self.last[same]:
            same += 1
        ahead: list[list[float] | None] = self.sums[: same + 1] + [None] * (n - same)
        scale, scaled = [0.0] * width, False
        for j in range(same + 1, n + 1):
            total = [a * b for a, b in zip(ahead[j - 1], table.get(word[j - 1]) or self.unknown)]  # noqa: B905
            ending = []
            for i in range(j - 2, max(0, j - longest) - 1, -1):
                p = table.get(word[i:j], False)
                if p is False:
                    break
                if p is not None:
                    ending.append((ahead[i], p))
            for before, p in reversed(ending):
                total = [t + a * b for t, a, b in zip(total, before, p)]  # noqa: B905
            ahead[j] = total
            for k in range(width) if min(total) < 1e-120 else ():
                if total[k] < 1e-120:
                    if not scaled:
                        # Sums taken over belong to the word before as well.
                        ahead, scaled = [a and list(a) for a in ahead], True
                        total = ahead[j]
                    for i in range(max(0, j - longest), j + 1):
                        ahead[i][k] *= 1e100
                    scale[k] -= 100 * math.log(10)
        self.last, self.sums = ("", [[1.0] * width]) if scaled else (word, ahead)
        return [math.log(max(a, 1e-300)) + s for a, s in zip(ahead[n], scale, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Score the words that are not kept yet, in alphabetical order; more than fit are left for later."""
        fresh = {w for w in words if w not in self.places}
        if len(self.places) + len(fresh) > self.limit:
            if len(words) > self.limit:
                return
            self.places, fresh = {}, words
        for bare, w in sorted((w.strip(MARKS), w) for w in fresh):
            at_row = len(self.places)
            self.scores[at_row] = (self.scores[self.places[bare]] if bare in self.places else self.word(bare)) if bare else 0.0
            self.places[w] = at_row

    def total(self, words: list[str]) -> np.ndarray:
        total = np.zeros(self.width)
        for at in range(0, len(words), self.limit):
            part = words[at : at + self.limit]
            try:
                rows = [self.places[w] for w in part]
            except KeyError:
                self.learn(set(part))
                rows = [self.places[w] for w in part]
            total += self.scores[rows].sum(axis=0)
        return total

    def text(self, text: str) -> np.ndarray:
        return self.total(text.lower().split())

    def texts(self, texts: Iterator[str]) -> Iterator[np.ndarray]:
        """Log likelihoods text by text; the words of about a million characters are scored together."""
        split: list[list[str]] = []
        chars = 0
        for text in texts:
            split.append(text.lower().split())
            chars += len(text)
            if chars >= AT_ONCE:
                self.learn({w for words in split for w in words})
                yield from map(self.total, split)
                split, chars = [], 0
        self.learn({w for words in split for w in words})
        yield from map(self.total, split)


def held_out(doc_id: str = "doc_id") -> Column:
    """True if crc32 of the id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def languages(docs: DataFrame, model: LanguageModel = LanguageModel()) -> DataFrame:
    """Predicted language and its posterior probability for each row of (doc_id, text, lang).

    Learned from rows that are not held out and have a language. A null text or one without a letter is
    undetermined with score 0, as is every text if nothing can be learned. Ties go to the language first in the
    alphabet. Repeated rows and null ids are kept. Other columns are not read.
    """
    rows = texts_of(docs, "lang").withColumn("held_out", held_out())
    usable = rows.filter("NOT held_out AND lang IS NOT NULL")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = usable.select("lang", "doc_id").distinct().withColumn("n", F.row_number().over(order)).filter(F.col("n") <= model.documents_per_language)
    ids = cut(ids.select("lang", "doc_id"))
    chosen = F.expr("u.doc_id <=> i.doc_id AND u.lang = i.lang")
    sample = cut(usable.alias("u").join(ids.alias("i"), chosen, "left_semi"))
    langs, table, unseen, prior = train(sample, model)
    shared = docs.sparkSession.sparkContext.broadcast((table, unseen))
    name = f"languages:{uuid.uuid4().hex}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scorer = once(name, lambda: Scorer(*shared.value, model)) if langs else None
        for batch in batches:
            names, scores = [], []
            texts = batch.column(1).to_pylist()
            readable = [scorer is not None and bool(text) and _LETTER.search(text) is not None for text in texts]
            totals = scorer.texts(text for text, ok in zip(texts, readable, strict=True) if ok) if scorer else iter(())
            for ok in readable:
                if not ok:
                    names.append(model.undetermined)
                    scores.append(0.0)
                    continue
                total = next(totals) + prior
                best = int(total.argmax())
                names.append(langs[best])
                scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum()))
            yield {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names, "score": scores}

    return map_batches(rows.select("doc_id", "text", "held_out"), "doc_id long, held_out boolean, lang_pred string, score double", score)
