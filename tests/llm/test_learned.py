import itertools
import math
import random
import re
import zlib

import xxhash

from newsflow.llm import language_id as li
from newsflow.llm import quality as q
from newsflow.llm import toxicity as tox

SCHEMA = "doc_id long, text string, lang string"


def edit_distance(a, b):
    """Edits between two strings, a swap of neighbours being one."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, last = [i], rows[-1]
        for j, y in enumerate(b, 1):
            best = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def misspelled(r, term, edits, letters):
    word = list(term)
    for _ in range(edits):
        i = r.randrange(len(word)) if word else 0
        if len(word) > 1 and r.random() < 0.4:
            i = r.randrange(len(word) - 1)
            word[i], word[i + 1] = word[i + 1], word[i]
        elif word:
            word[i] = r.choice(["", *letters, "x" + word[i]])
            word = list("".join(word))
    return "".join(word)


def fitting(word, terms, options):
    """The fewest edits that a term of its length lets pass."""
    near = [(edit_distance(word, t), t) for t in terms]
    return min((n for n, t in near if n <= (len(t) >= options.one_edit) + (len(t) >= options.two_edits)), default=None)


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


# language


def all_segmentations(word, prob, unknown, known, longest):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(longest, len(word)) + 1):
        piece = word[:n]
        p = prob(piece) if piece in known else unknown if n == 1 else 0.0
        if p:
            total += p * all_segmentations(word[n:], prob, unknown, known, longest)
    return total


def test_forward_sums_every_segmentation():
    model = li.LanguageModel()
    known = li.vocabulary(model.vocabulary)
    table = {"▁th": [0.1, 0.01], "e": [0.2, 0.3], "▁the": [0.05, 0.001], "re": [0.1, 0.1], "▁": [0.01, 0.02]}
    unseen = [1e-4, 2e-4]
    scorer = li.Scorer(table, unseen, model)
    for word in ("there", "thee", "日x", "e"):
        for k in range(2):
            expected = all_segmentations("▁" + word, lambda s, k=k: table.get(s, unseen)[k], model.unknown, known, scorer.longest)
            assert abs(scorer.word(word)[k] - math.log(expected)) < 1e-9
    assert all(-1e6 < x < -1000 for x in scorer.word("q" * 4000))


def test_words_with_a_common_beginning_share_its_sums():
    class Counted(dict):
        asked = 0

        def get(self, *key):
            Counted.asked += 1
            return dict.get(self, *key)

    words = ["internationalisation" + end for end in ("", "s", "x", "xy")] + ["q" * 4000, "q" * 4001, "internal"]
    scorer = li.Scorer({"▁": [0.1, 0.2], "er": [0.2, 0.1]}, [1e-4, 2e-4], li.LanguageModel())
    alone = []
    for word in words:
        scorer.word("")
        alone.append(scorer.word(word))
    scorer.word("")
    scorer.table = Counted(scorer.table)
    scorer.word(words[0])
    first, Counted.asked = Counted.asked, 0
    together = [scorer.word(word) for word in words[1:4]]
    assert Counted.asked < first
    assert [alone[0], *together, *map(scorer.word, words[4:])] == alone
    text = " ".join(words[:4] * 3)
    assert [t.tolist() for t in scorer.texts(iter([text, "", text.upper()]))] == [scorer.text(t).tolist() for t in (text, "", text)]


def test_expected_pieces_agree_with_enumeration():
    known = frozenset(["a", "b", "ab", "ba"])
    prob = {"a": 0.3, "b": 0.2, "ab": 0.4, "ba": 0.1}
    counts, total = li.expected_pieces("abab", prob, 0.0, known, 2, 1e-6)
    ways = {}
    for cuts in itertools.product([0, 1], repeat=3):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append("abab"[last:i])
                last = i
        if all(p in known for p in parts):
            ways[tuple(parts)] = math.prod(prob[p] for p in parts)
    assert abs(math.exp(total) - sum(ways.values())) < 1e-12
    for piece in known:
        assert abs(counts.get(piece, 0) - sum(w * p.count(piece) for p, w in ways.items()) / sum(ways.values())) < 1e-9


def test_languages_held_out(spark):
    r = random.Random(1)
    words = {"en": "the and house water people going under".split(), "de": "der und haus wasser leute gehen unter".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(20)), lang) for i in range(80) for lang in [r.choice(["en", "de"])]]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !?", "en"), (None, "water and people", None), (203, "wasser " * 20_000, None), rows[0]]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], SCHEMA + ", score double")
    got = li.languages(docs).collect()
    assert len(got) == len(rows)
    true = {i: lang for i, _, lang in rows[:80]}
    for x in got:
        assert x["held_out"] == (held(x["doc_id"]) if x["doc_id"] is not None else False) and 0 <= x["score"] <= 1
        if x["doc_id"] in true:
            assert x["lang_pred"] == true[x["doc_id"]]
    named = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in got}
    assert named[200] == named[201] == named[202] == ("und", 0.0) and named[None][0] == "en" and named[203][0] == "de"


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some words", None)], SCHEMA)
    assert [(x["lang_pred"], x["score"]) for x in li.languages(docs).collect()] == [("und", 0.0)]
    assert li.languages(docs.limit(0)).count() == 0


# quality


def plain_quality(text, rules, weights):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, w = len(words), rules.window
    windows = [tuple(words[i : i + w]) for i in range(n - w + 1)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(w)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    single = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in words]
    pair = []
    for a, b in zip(single, single[1:]):
        h = xxhash.xxh64_intdigest(a.to_bytes(8, "little", signed=True), 42)
        pair.append(signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little", signed=True), h)))
    slots = [h % rules.slots for h in single + pair]
    score = sum(weights[s] for s in slots) / len(slots) if slots else None
    failed = n < rules.min_words or 100 * len(covered) > rules.max_repeat_percent * n
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    counts = (n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed, not failed and score >= rules.floor)
    return counts, score, slots


def test_quality_equals_plain_python(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choice("abcdeé#|") for _ in range(r.randint(1, 6))) for _ in range(60)]
    texts = []
    for _ in range(60):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 3, 19, 20, 60, 200]))]
        if r.random() < 0.4:
            words += words[: r.randint(0, 30)]
        texts.append("".join(w + r.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b", "\x0c"]) for w in words))
    texts += [None, "", " \n ", "a " * 5000, "line\nline\n\nline \nline"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*x, 1, True) for x in rows], SCHEMA + ", n_words int, kept boolean")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    rules = q.Rules(slots=256, floor=-0.02, min_share=0.1, min_count=0, prior=0.0)
    weights = [0.0] * rules.slots
    plain = [plain_quality(t, rules, weights)[2] for t in texts]
    raw, good = [0] * rules.slots, [0] * rules.slots
    for i, slots in enumerate(plain):
        for s in slots:
            raw[s] += 1
            good[s] += i < 40 and i % 2 == 1
    pull, least = rules.prior_share * sum(good), rules.min_share * sum(raw) / rules.slots
    weights = [math.log((g + pull * w / sum(raw)) / (sum(good) + pull) / (w / sum(raw))) if w and w >= least else 0.0 for g, w in zip(good, raw)]
    got = {x["doc_id"]: x for x in q.quality(docs, labels, rules).collect()}
    for i, t in enumerate(texts):
        counts, score, _ = plain_quality(t, rules, weights)
        x = got[i]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) == counts[:6], i
        assert (x["score"] is None) == (score is None) and (score is None or abs(x["score"] - score) < 1e-6)
        if score is None or abs(score - rules.floor) > 1e-6:
            assert x["kept"] == counts[6]


def test_quality_does_not_depend_on_the_size_of_the_table(spark):
    r = random.Random(8)
    texts = [" ".join(f"w{int(r.paretovariate(0.7)) % (40 if i % 3 else 400)}" for _ in range(50)) for i in range(60)]
    schema = "doc_id long, text string"
    judged = {}
    for times in (1, 12):
        docs = spark.createDataFrame([(i + 1000 * k, t) for k in range(times) for i, t in enumerate(texts)], schema)
        labels = spark.createDataFrame([(i + 1000 * k, i % 3 and 1, 0) for k in range(times) for i in range(40)], "doc_id long, quality int, toxic int")
        judged[times] = {x["doc_id"]: (round(x["score"], 6), x["kept"]) for x in q.quality(docs, labels, q.Rules(min_count=0, prior=0.0)).collect() if x["doc_id"] < 1000}
    assert judged[1] == judged[12] and {k for _, k in judged[1].values()} == {True, False}


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(None, "word " * 3 + " ".join(map(str, range(30))), "x")] * 2, SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(x["score"], x["kept"]) for x in q.quality(docs, labels).collect()] == [(0.0, True)] * 2
    assert q.quality(docs.limit(0), labels).count() == 0


# toxicity


def test_automaton_and_trie_equal_edit_distance():
    r = random.Random(4)
    terms = ["".join(r.choice("abcd") for _ in range(r.randint(4, 11))) for _ in range(40)]
    trie = tox.Trie()
    for t in terms:
        trie.add(t)
    options = tox.Lexicon()
    matcher = tox.Matcher(sorted(set(terms)), [], frozenset(), options)
    found = set()
    for _ in range(1500):
        word = misspelled(r, r.choice(terms), r.randint(0, 3), "abd")
        for edits in (1, 2):
            got = tox.LevenshteinAutomaton(word, edits).intersect(trie)
            assert got == sorted((n, t) for t in set(terms) if (n := edit_distance(word, t)) <= edits)
        assert matcher.find(word) == fitting(word, terms, options), word
        found.add(matcher.find(word))
    assert found == {0, 1, 2, None}


def test_term_length_decides_on_edits():
    options = tox.Lexicon()
    matcher = tox.Matcher(["idiot", "loser", "trash", "scum", "worthless"], [], frozenset(), options)
    assert [matcher.find(w) for w in ("idot", "losr", "trsh", "scm", "idoit", "diiot", "sucm")] == [1] * 7
    assert [matcher.find(w) for w in ("worthles", "wortless", "owrthelss", "wrthless", "worhtlses")] == [1, 1, 2, 1, 2]
    assert [matcher.find(w) for w in ("id", "itdio", "w" * 100, "words")] == [None] * 4


def test_edits_inside_a_stem_are_matched():
    options = tox.Lexicon()
    matcher = tox.Matcher(["loser"], ["lose"], frozenset(), options)
    assert [matcher.find(w) for w in ("loser", "losers", "looser", "1oser", "lozer", "loper", "lover")] == [0, 0, 1, 1, 1, 1, 1]
    assert tox.Matcher(["loser"], ["lose"], frozenset(["lover"]), options).find("lover") is None
    r = random.Random(5)
    terms = sorted({"".join(r.choice("abcd") for _ in range(r.randint(4, 12))) for _ in range(60)})
    stems = sorted({t[: r.choice([4, 5, 6])] for t in terms[::2]})
    matcher, found = tox.Matcher(terms, stems, frozenset(), options), 0
    for _ in range(800):
        word = misspelled(r, r.choice(terms), r.randint(0, 3), "ab")
        fits = fitting(word, terms, options)
        stemmed = word in terms or any(word.startswith(s) for s in stems)
        assert matcher.find(word) == (0 if stemmed else fits), word
        found += not stemmed and fits is not None
    assert found > 50


def test_toxicity_held_out_misspelled_and_quoted(spark):
    r = random.Random(9)
    plain = ["".join(r.choice("mnopqrst") for _ in range(r.randint(3, 7))) for _ in range(300)]
    bad = ["grimblefax", "wackdorf", "zuvvel"]
    rows, labels = [], []
    for i in range(500):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[r.randrange(40)] = r.choice(bad)
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, "mnop grimblefx stop", "x"), (1001, 'he wrote: "you wackdorf" mnop', "x"), (1002, None, "x"), (1003, "", "x"), (None, "zuvvel mnop wackdorf", "x"), rows[0]]
    docs = spark.createDataFrame([(*x, 3) for x in rows], SCHEMA + ", toxic int")
    got = tox.toxicity(docs, spark.createDataFrame([*labels, (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    by_id = {x["doc_id"]: x for x in got}
    assert len(got) == len(rows)
    for i in range(500):
        assert by_id[i]["held_out"] == held(i) and by_id[i]["predicted"] == (i % 4 == 0)
    assert by_id[1000]["predicted"] == 1 and by_id[None]["predicted"] == 1
    assert by_id[1001]["score"] < by_id[0]["score"]
    assert by_id[1002]["score"] == by_id[1003]["score"] < 0.3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(x["score"], x["predicted"]) for x in tox.toxicity(docs, labels).collect()] == [(0.0, 0)]
    assert tox.toxicity(docs.limit(0), labels).count() == 0
