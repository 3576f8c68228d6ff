"""Language profiles against a plain count, and TF-IDF vectors."""

import math
from collections import Counter

from newsflow.operators import language
from newsflow.operators.tfidf import tfidf_vectors

TEXTS = [
    (1, "en", "the cat and the dog are in the house"), (2, "fr", "le chat et le chien sont dans la maison"),
    (3, "en", "this is the other house, and that is it"), (4, "fr", "une autre maison est dans la rue"), (5, "fr", "!?"),
]


def grams(text):
    folded = " " + "".join(c if c.isalpha() else " " for c in text.lower())
    folded = " " + " ".join(folded.split()) + " "
    return [folded[i : i + 3] for i in range(len(folded) - 2)]


def test_language_profiles(spark):
    df = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    counts = {lang: Counter(g for _, code, t in TEXTS if code == lang for g in grams(t)) for lang in ("en", "fr")}
    size = len(set().union(*counts.values()))
    log_p = {lang: {g: math.log((c[g] + 1) / (sum(c.values()) + size)) for g in set().union(*counts.values())} for lang, c in counts.items()}
    profiles = language.train_profiles(df)
    got = {(r.lang, r.gram): round(r.log_p, 9) for r in profiles.collect()}
    assert got == {(lang, g): round(p, 9) for lang, ps in log_p.items() for g, p in ps.items()}
    fresh = [(7, None, "the house and the other dog"), (8, None, "la rue et une maison")]
    found = language.detect_language(spark.createDataFrame(fresh, df.schema), profiles, "id")
    assert {r.id: r.detected for r in found.collect()} == {7: "en", 8: "fr"}


def test_grams_are_counted_and_scored_without_a_row_for_each(spark, monkeypatch):
    df = spark.createDataFrame([*TEXTS, (6, "zh", "\U00020000ab"), (7, "en", None), (8, None, "x")], "id long, lang string, text string")
    assert {r.gram for r in language.profile_counts(df).filter("lang = 'zh'").collect()} == {" \U00020000a", "\U00020000ab", "ab "}
    profiles = language.train_profiles(df)
    fresh = [(7, None, "the house and the other dog"), (8, None, "la rue"), (8, None, "et une maison"), (9, None, "123"), (10, None, None),
             (None, None, "\U00020000ab")]
    texts = spark.createDataFrame(fresh, df.schema)
    found = language.detect_language(texts, profiles, "id")
    assert "Generate" not in found._jdf.queryExecution().toString()
    expected = {7: "en", 8: "fr", None: "zh"}
    assert sorted(found.collect(), key=str) == sorted([*expected.items()], key=str)
    # A profile larger than what a task holds gives the same through the join.
    monkeypatch.setattr(language, "HELD", 60)
    found = language.detect_language(texts, profiles, "id")
    assert "Generate" in found._jdf.queryExecution().toString() and {r.id: r.detected for r in found.collect()} == expected


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(language, "AT_ONCE", 5)
    texts = {"a": " the dog in the house ", "b": "  ", "c": " x ", "d": " abcde fghij klmno pqrst "}
    got = Counter()
    for tags, pieces in language._blocks(texts.items()):
        assert sum(map(len, pieces)) <= 5 + 2 + 4
        numbers, owner = language._numbers(pieces)
        got.update(zip((tags[i] for i in owner), language._letters(numbers), strict=True))
    assert got == Counter((tag, text[i : i + 3]) for tag, text in texts.items() for i in range(len(text) - 2))


def test_counts_of_cycles_add_up(spark):
    df = spark.createDataFrame(TEXTS, "id long, lang string, text string")
    parts = [language.profile_counts(df.filter(f"id % 2 = {n}")) for n in (0, 1)]
    key = lambda rows: sorted((r.lang, r.gram, r.n) for r in rows.collect())
    assert key(language.merged_counts(parts)) == key(language.profile_counts(df))


def test_held_out_texts_are_recognised(spark):
    """Profiles learn from two thirds of the documents; the others tell how good they are."""
    from newsflow.catalog.queries import QUERIES
    from newsflow.catalog.views import Views

    rows = QUERIES["language_profile"](Views(spark, "/root/testdata/sf0.001")).collect()
    assert len(rows) > 40
    assert sum(r.lang == r.detected for r in rows) >= 0.9 * sum(r.detected is not None for r in rows)


def test_tfidf_vectors(spark):
    df = spark.createDataFrame([(1, "red fox runs"), (2, "red fox runs"), (3, "blue whale swims"), (4, "")], "id long, text string")
    v = {r.id: r.embedding for r in tfidf_vectors(df, "id", 64).collect()}
    assert v[1] == v[2] != v[3]
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-5
    assert not any(v[4])


def test_document_frequencies_are_counted_in_tasks_of_bounded_size(spark):
    from newsflow.operators import evidence

    rows = [(n % 3 or None, [f"t{n % 7}", f"u{n}", "the"] if n % 5 else []) for n in range(60)]
    documents = spark.createDataFrame(rows, "batch_id long, tokens array<string>").coalesce(1)
    found = evidence.doc_freq(documents)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # The documents are dealt before their tokens become rows, which a large file's only task would otherwise hold.
    assert plan.index("Generate") < plan.index("RebalancePartitions")
    assert {(r.batch_id, r.token): r.df for r in found.collect()} == Counter((key, t) for key, tokens in rows for t in tokens)
