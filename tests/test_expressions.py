"""Documented edge cases of the scalar rules."""

import hashlib

from pyspark.sql import functions as F

from newsflow.functions import language, text, vectors
from newsflow.functions.urls import host, host_suffixes, normalized_url, url_hash
from newsflow.operators import entities, pages


def one(spark, column, **values):
    types = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], types).select(column.alias("x")).first().x


def test_url_key(spark):
    cases = {
        "https://a.com/p?q=1#f": "https://a.com/p",
        "https://a.com/p/;x=1": "https://a.com/p/",
        "https://a.com/a;b/c;d;e": "https://a.com/a;b/c",
        "HTTPS://A.com/P/": "https://A.com/P/",
        "https://a.com": "https://a.com",
        "https://a.com/p#x?y": "https://a.com/p",
        "/just/a/path": "/just/a/path",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", normalized_url(F.col("u")).alias("n"), url_hash(F.col("u")).alias("h"))
    for r in rows.collect():
        assert r.n == cases[r.u]
        assert r.h == hashlib.sha256(cases[r.u].encode()).hexdigest()


def test_host_matches_only_at_label_borders(spark):
    got = one(spark, host_suffixes(host(F.col("u"))), u="https://a.ft.com/x")
    assert got == ["a.ft.com", "ft.com", "com"]
    assert "ft.com" not in one(spark, host_suffixes(host(F.col("u"))), u="https://joehoft.com/")


def test_language_rule(spark):
    keep = lambda t, lang: one(spark, language.is_english(F.col("t"), F.lit(lang), 0.05, 20), t=t)
    assert keep("短新闻", None) is False
    assert keep("Short one", "pt") is True
    assert keep("习惯高油价吧 - Get Used to High Gas Prices in the Coming Months", "en") is False
    assert keep("O presidente falou sobre a economia do país ontem", "pt") is False
    assert keep("The president spoke about the economy yesterday", "en") is True
    assert keep("The president spoke about the economy yesterday", None) is True
    assert one(spark, language.cjk_ratio(F.col("t")), t="123 $%") == 0.0


def test_declined(spark):
    for raw in ("**No comment**.", "no comment", " `NO COMMENT`! ", "No comment.!", "no com*ment", "\u00a0no comment \u2003!!\n", "__No__ comment"):
        assert one(spark, text.is_declined(F.col("t")), t=raw) is True
    for raw in ("No comment from the White House", "", "no  comment", "no comment. .", "no comment\nno comment", "nocomment", "* x no comment"):
        assert one(spark, text.is_declined(F.col("t")), t=raw) is False


def test_post_suffix_is_stripped_exactly(spark):
    got = lambda post: one(spark, text.post_text_without_url(F.col("p"), F.col("u")), p=post, u="https://x.y/z")
    assert got("Hello\n\nhttps://x.y/z") == "Hello"
    assert got("Hello https://x.y/z") == "Hello https://x.y/z"


def test_scores(spark):
    got = lambda raw: one(spark, text.json_score(F.col("r")), r=raw)
    assert tuple(got('{"llm_score": "7", "llm_comment": "c"}')) == (7.0, "c")
    assert got('{"llm_score": 7}') is None
    assert got('{"llm_score": 7, "llm_comment": 3}') is None
    assert got("nothing") is None


def test_ranks(spark):
    got = lambda raw: one(spark, text.json_ranks(F.col("r")), r=raw)
    assert [tuple(x) for x in got('```json\n[{“id”: “a”, “priority_score”: “2.5”}]\n```')] == [("a", 2.5)]
    assert got('[{"id": 3, "priority_score": 1}]') is None
    assert got('[{"id": "a"}]') is None
    assert got('{"id": "a"}') is None


def test_verdict(spark):
    same = lambda raw: one(spark, text.says_same(F.col("r")), r=raw)
    assert same("REASON: x\nverdict: same_event") is True
    assert same("VERDICT: DIFFERENT_EVENT") is False
    assert same("the VERDICT: SAME") is False
    assert same(None) is False


def test_dates(spark):
    at = lambda raw, other="": one(
        spark, F.unix_seconds(text.published_utc(F.col("p"), F.col("u"), F.timestamp_seconds(F.lit(5)))), p=raw, u=other)
    assert at("Tue, 02 Jan 2024 03:04:05 +0100") == 1704161045
    assert at("2024-01-02T03:04:05Z") == 1704164645
    assert at("2024-01-02 03:04:05") == 1704164645
    assert at("Tue, 2 Jan 2024 03:04:05 EST") == 1704182645
    assert at("", "2024-01-02T03:04:05Z") == 1704164645
    assert at("soon") == 5


def test_usable_text(spark):
    got = lambda t: one(spark, text.usable_text(F.col("t"), F.lit("d"), 200, ("try unlimited access",)), t=t)
    assert got("x" * 199) == "d"
    assert got("x" * 200) == "x" * 200
    assert got("Try Unlimited Access " + "x" * 300) == "d"
    assert got(None) == "d"


def test_cosine_of_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_weekday_is_eastern(spark):
    # Saturday 03:00 UTC is still Friday in New York
    at = F.timestamp_seconds(F.lit(1704510000))
    assert spark.range(1).select(text.is_weekday(at, "America/New_York")).first()[0] is True


def page(spark, html):
    df = spark.createDataFrame([("https://a/b", html)], "url string, html string")
    return pages.page_image(pages.page_meta(df, 0.2)).first()


def test_page_meta(spark):
    r = page(spark, """<META content='Tom &amp; Jerry <x>' property='og:title'><meta property="og:description" content=" ">
      <meta content="Second &#39;desc&#39;" name="twitter:description"><meta property="og:url" content="https://c/d">""")
    assert r.preview_title is None  # the tag ends at the first '>'
    assert r.preview_description == "Second 'desc'"
    assert r.preview_url == "https://c/d"
    r = page(spark, '<meta property="og:title" content="习惯高油价吧"><meta property="og:description" content="In English">')
    assert (r.preview_title, r.preview_description, r.preview_url) == (None, "In English", "https://a/b")


def test_page_image(spark):
    script = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"image":"https://i/n.jpg"}}}</script>'
    img = '<img src="/rel.png"><img src="https://i/favicon.png"><img alt="" src="https://i/ok.png">'
    assert page(spark, script + img).preview_image == "https://i/n.jpg"
    assert page(spark, img).preview_image == "https://i/ok.png"
    assert page(spark, '<meta name="twitter:image:src" content="https://i/t.png">' + img).preview_image == "https://i/t.png"


def test_page_text(spark):
    html = ("<html><nav><p>menu</p></nav><!-- <p>no</p> --><article><h1>T</h1><p>One &amp; <b>two</b><p>three\n four</p>"
            "<script>var p='<p>x</p>'</script></article><footer><p>f</p></footer></html>")
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert pages.page_text(df).first().page_text == "One & two\nthree four"


PARAGRAPH = "This paragraph has a good number of words, so that it counts as running text."
GOLDEN_PAGES = {
    # Divisions, list items and table cells hold text as paragraphs do; unclosed ones end where the next begins.
    f"<article><div>{PARAGRAPH}<ul><li>one<li>two <b>and</b> a half</ul><table><tr><td>cell</table><blockquote>said</blockquote></div></article>":
        [PARAGRAPH, "one", "two and a half", "cell", "said"],
    # Menus go, inside an article as well; a link within running text stays.
    f"<article><ul><li><a href=/a>Home</a><li><a href=/b>News and more</a></ul><p>{PARAGRAPH} See <a href=x>here</a>.</article>":
        [f"{PARAGRAPH} See here."],
    # Without an article: text among text stays, words of the frame and lists of links do not.
    f"<body><div>Login</div><div><a href=1>One</a> | <a href=2>Two</a></div><div><a href=3>Three</a></div><div><a href=4>Four</a></div>"
    f"<div>{PARAGRAPH}<div>{PARAGRAPH}</div><ul><li>short item</ul></div></body>": [PARAGRAPH, PARAGRAPH, "short item"],
    "<body><div>Login</div><p>Share</p></body>": [],
    f"<main><section><h2>Head</h2>{PARAGRAPH}<br>1 &lt; 2 a < b</section></main><div>outside</div>": ["Head", f"{PARAGRAPH} 1 < 2 a < b"],
    "": [], "no tags at all, yet enough words to count as the running text of a page": ["no tags at all, yet enough words to count as the running text of a page"],
}


def test_page_text_of_golden_pages(spark):
    rows = spark.createDataFrame([(n, h, 1) for n, h in enumerate(GOLDEN_PAGES)] + [(99, None, 1)], "n int, html string, blocks int")
    got = {r.n: r.page_text for r in pages.page_text(rows).collect()}
    assert got == {n: "\n".join(t) for n, t in enumerate(GOLDEN_PAGES.values())} | {99: got[99]} and not got[99]


def test_names(spark):
    names = spark.createDataFrame(
        [("congress", "Ann Lee", "Lee", True), ("cabinet", "Bob Stone", "Stone", False), ("notable", "Cy Oz", None, False),
         ("alias", "AOC", None, False), ("notable", "Tyler Durden", None, False)],
        "kind string, full_name string, last_name string, ambiguous boolean")
    patterns = entities.gazetteer_patterns(names)
    assert {r.pattern for r in patterns.collect()} == {"Ann Lee", "Bob Stone", "Stone", "Cy Oz", "AOC", "Tyler Durden"}
    texts = spark.createDataFrame([
        (1, "By Tyler Durden. Stone's plan angers AOC, Lee says"), (2, "Oz. and stone"), (3, "“Ann Lee” arrested Bob Stone")],
        "id int, text string")
    got = {(r.id, r.token) for r in entities.entity_tokens(texts, patterns, "id").collect()}
    assert got == {(1, "stone"), (1, "aoc"), (3, "ann"), (3, "lee"), (3, "bob"), (3, "stone")}
    frame = entities.event_frame(texts, patterns, entities.lexicon(spark), "id").collect()
    assert [(r.id, r.action, r.event_type, r.actor, r.target) for r in frame] == [(3, "arrest", "arrest", "Ann Lee", "Bob Stone")]


def test_gazetteer_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"congress": [["A B", "B", false], ["C D", "D", true]], "cabinet": [["E F", "F"]], "notable": [["G H", null]], "aliases": ["I"]}')
    got = entities.gazetteer_patterns(entities.read_gazetteer(spark, str(tmp_path / "g.json")))
    assert {r.pattern for r in got.collect()} == {"A B", "B", "C D", "E F", "F", "G H", "I"}


def test_names_of_any_length(spark):
    from newsflow.operators import entities

    long_name = "World Health Organization Regional Office For Europe"
    patterns = spark.createDataFrame([(long_name, "ORG"), ("Ann Lee", "PERSON")], "pattern string, label string")
    texts = spark.createDataFrame([(1, f"Today {long_name} met."), (2, "Ann Lee spoke"), (3, "World Health")], "id long, text string")
    hits = {(r["id"], r["pattern"]) for r in entities.name_hits(texts, patterns, "id").collect()}
    assert hits == {(1, long_name), (2, "Ann Lee")}


def test_verdict_after_a_tab(spark):
    from newsflow.functions.text import says_same

    rows = spark.createDataFrame([("VERDICT:\tSAME_EVENT",), ("VERDICT: DIFFERENT",)], "raw string")
    assert [r[0] for r in rows.select(says_same(F.col("raw"))).collect()] == [True, False]
