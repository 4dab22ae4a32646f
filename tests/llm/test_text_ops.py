"""Toxicity, HTML, BPE, quality grades and chat formatting against plain versions."""
import hashlib
import os
import random

import duckdb
import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapcube.llm import bpe, chat, html, ordinal, rules, toxicity

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables absent")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_agrees_with_the_library(spark):
    rng = random.Random(5)
    pool = "aAb 's1\n\té漢ß<|endoftext|>_-" + "".join(chr(rng.randrange(32, 0x2000)) for _ in range(300))
    texts = [None, "", " " * 50, "a" * 999, "x<|endoftext|> y"] + ["".join(rng.choices(pool, k=rng.randrange(120))) for _ in range(400)]
    want = Tokenizer.from_file(path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode(df, section_bytes=2000).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        e = want.encode(t or "", add_special_tokens=False)
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == e.ids
        assert got[i].decoded == want.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode(df.limit(0)).count() == 0


PAGE = """<html><head><title>T</title><script>var a = "</p><p>no";</script></head><body><header>Site</header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, really, many of them, and so on and on.</p></div>
<article><h1>Head &amp; more</h1><p>First  paragraph,<br>with <b>words, and commas, enough to count.<p>Second &lt;one&gt;,
longer than the others, with commas, and text.</p><div class=ad><p>Buy, buy, buy, now and here and everywhere!</p></div></article>
<div id="comments"><p>A reader, who has much to say, says it, at length, and with commas.</p></div><footer><p>&copy; foot</p></footer>"""


def test_html_keeps_the_article_only(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "y"), (3, "v", "", "z"), (3, "v", "plain, no tags &am", "z"), (4, "w", "<p>" * 3000 + "deep", "z")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect())
    text = "Head & more\nFirst paragraph, with words, and commas, enough to count.\nSecond <one>, longer than the others, with commas, and text."
    assert got == [(1, text, len(text)), (2, "", 0), (3, "", 0), (3, "plain, no tags &am", 18), (4, "deep", 4)]


def plain_chats(rows):
    out = {}
    for c in {r[0] for r in rows}:
        t = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        learned = "".join(x for _, _, r, x in t if r == "assistant")
        out[c] = (len(t), sha("".join(f"{r}\n{x}\n" for _, _, r, x in t)), len(learned), sha(learned))
    return out


@pytest.mark.parametrize("budget", [(2048, 256, 256), (120, 30, 20)])
def test_chats_are_read_back(spark, tmp_path, monkeypatch, budget):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(60)]), rng.choice(["user", "assistant", "system", None, "a\nb%0A<|"]),
             rng.choice([None, "", "<|im_end|>", "<\\|x<", "|>\n<|im_start|>user\nhi", " ".join(["w"] * rng.randrange(200))])) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(chat.windows, "__defaults__", budget)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.op3_chat_formatting(spark, str(tmp_path)).collect()}
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert got == plain_chats(rows + [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])


def test_windows_fit_the_budget_and_repeat_the_system_turn(spark):
    rows = [(7, 0, "system", "be kind")] + [(7, i, "assistant" if i % 2 == 0 else "user", f"turn {i} " + "w " * 20) for i in range(1, 60)]
    w = sorted(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 160, 40, 20).collect(), key=lambda r: r.first)
    assert len(w) > 5 and all(r.text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") for r in w)
    assert all(r.text.count("w") + 4 * r.text.count("<|im_start|>") <= 160 for r in w)
    assert any(r.repeated > 1 for r in w)


@needs_data
def test_toxicity_on_held_out_rows(spark):
    got = {r.doc_id: r for r in toxicity.op4_toxicity(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall()
    test = [(got[i].score, y) for i, y in rows if got[i].held_out]
    pos, neg = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert len(got) == 1000 and auc > 0.85 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())


def test_toxicity_of_odd_texts(spark):
    model = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    df = spark.createDataFrame([(None, None), (1, ""), (2, "ab"), (2, "ab")], "doc_id long, text string")
    got = [r[0] for r in df.select(toxicity.score(model)).collect()]
    assert len(got) == 4 and all(0 <= s <= 1 for s in got)


@needs_data
def test_grades_on_held_out_rows(spark):
    got = {r.doc_id: r for r in ordinal.op10_quality_classifier(spark, DATA).collect()}
    rows = duckdb.sql(f"SELECT doc_id, quality FROM '{DATA}/labels.parquet'").fetchall()
    kept = {y: np.mean([got[i].kept for i, q in rows if q == y and got[i].held_out]) for y in (0, 1)}
    assert len(got) == 1000 and kept[1] > 0.95 and kept[0] < 0.5


def test_thresholds_are_ordered_and_recover_grades():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(600, ordinal.DIMENSIONS))).astype(np.float32) * 0.02
    z = x[:, :3].sum(1) * 50 + rng.logistic(size=600) * 0.2
    grade = np.digitize(z, np.quantile(z, [0.3, 0.7]))
    w, theta = ordinal.fit(x, grade, 3)
    assert theta[0] < theta[1] and np.corrcoef(x @ w, grade)[0, 1] > 0.8
    assert len(ordinal.fit(x[:0], grade[:0], 3)[1]) == 2


@needs_data
def test_quality_rules_agree_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    got = rules.op8_quality_rules(spark, DATA).toPandas()
    want = con.execute(rules.ORACLE).fetchdf()[got.columns]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_quality_counts_of_odd_texts(spark):
    rows = [(1, None, 5), (2, "", 5), (3, "a b c a b c", 5), (3, "a b c a b c", 5), (4, " x\n x\n\n y ###", 5), (5, "a a a a", 5)]
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
                 for r in rules.counted(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect())
    six = (3, 6, 6, 0, 1, 0, 6)
    assert got == [(1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), six, six, (4, 4, 6, 3, 3, 1, 0), (5, 4, 4, 0, 1, 0, 4)]


def test_order_of_rules_never_changes_the_verdict(spark):
    rows = [(i, t) for i, t in enumerate(["", "one two " * 40, "#$ " * 80, "LOUD WORDS " * 60 + "\n", " ".join(f"w{k}" for k in range(90))])]
    docs = rules.counted(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = [{r.doc_id for r in docs.withColumn("by", rules.cascade(list(order))).filter("by IS NULL").collect()} for order in (rules.RULES, rules.RULES[::-1])]
    assert kept[0] == kept[1] == {4}


def test_rules_ask_only_what_they_need(spark, monkeypatch):
    """Counts that are no result are evaluated in the branch of their rule, for the rows that reach it."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(10 if i else 60)), "kept", 7) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _t string, n_words int").withColumn("row", F.lit(1))
    monkeypatch.setattr(rules, "ordered", lambda *a: list(rules.RULES))  # short texts are rejected first
    made = rules.count_columns()
    failing = {**made, "n_shouted": F.raise_error(F.lit("evaluated")).cast("bigint")}
    monkeypatch.setattr(rules, "count_columns", lambda: failing)
    out = rules.judged(docs.filter("doc_id > 0"), returned=("n_words",))
    assert out.columns == ["doc_id", "text", "_t", "row", "n_words", "rejected_by"]
    assert {tuple(r)[2:] for r in out.collect()} == {("kept", 1, 10, "few_words")}  # nothing reached the last rule
    with pytest.raises(Exception, match="evaluated"):
        rules.judged(docs.filter("doc_id = 0")).collect()
    monkeypatch.setattr(rules, "count_columns", lambda: made)
    plan = rules.judged(docs, returned=("n_words",))._jdf.queryExecution().optimizedPlan().toString()
    assert all("CASE" in line for line in plan.splitlines() if "regexp_count" in line.lower() or "RegExpExtractAll" in line or "\\p{Lu}" in line) and "Lu}" in plan
    assert rules.judged(docs.limit(0)).count() == 0


LONG = ["Paragraph %d, " % k + "with words, and commas, " * 80 + "end." for k in range(10)]
BODY = "".join(f"<p>{p}</p>" for p in LONG)


@pytest.mark.parametrize("page, rest", [
    (f"<article><section>{BODY}</section><section><h2>Short</h2><p>A last remark of about sixty characters, for the reader here.</p></section></article>", (["Short", "A last remark of about sixty characters, for the reader here."],)),
    (f"<article><h1>Top</h1><div class=content>{BODY}</div></article>", (["Top"], [])),
    (f"<main><article><header class='entry-header'><h1>Top</h1></header><div><section><h2>One</h2><div>{BODY}</div></section></div></article></main>", (["Top", "One"], [])),
    (f"<div class='wrap has-sidebar'><div class='with-menu'><h1>Top</h1><div class=content>{BODY}</div></div></div>", (["Top"], [])),
    (f"<div><div>{BODY}</div><div><h2>Short</h2><p>Only this.</p></div></div>", (["Short", "Only this."],)),
    (f"<article><h1><a href=/x>Top</a></h1><div>{BODY}</div><p>Fin.</p></article>", (["Top"], ["Fin."])),
])
def test_html_loses_nothing_of_the_article(page, rest):
    before, after = rest if len(rest) == 2 else ([], rest[0])
    junk = "<div class='site-nav'><p>Go, here, and there, and everywhere else.</p></div>"
    end = "<div class='main-sidebar'><p>More, of the same, and on, and on, for ever.</p></div><div><ul><li><a href=/1>Some other page</a></li></ul></div>"
    assert html.extract(f"<html><body>{junk}{page}{end}</body></html>") == "\n".join([*before, *LONG, *after])


def test_html_links_beside_the_body_are_left_out():
    page = f"<article><h1>Top</h1><ul><li><a href=/1>One link</a></li><li><a href=/2>Another link</a></li></ul><div>{BODY}</div></article>"
    assert html.extract(page) == "\n".join(["Top", *LONG])


JUNK = ["reader-comments", "user-comments", "comment-body", "comment-thread", "ad-slot", "advert-unit", "newsletter-signup", "share-buttons", "related-posts", "related-articles",
        "social-media", "subscribe-form", "sponsored-content", "ads", "post-footer", "comments comments--nested"]


@pytest.mark.parametrize("tag", ["div", "section"])
@pytest.mark.parametrize("name", JUNK)
def test_html_drops_what_its_name_gives_away(tag, name):
    junk = f"<{tag} class='{name}'><p>Words, of no use, to the text, and many, of them, here.</p><{tag}><p>And, nested, more, of the same, again.</p></{tag}></{tag}>"
    half = len(LONG) // 2
    inner = "".join(f"<p>{p}</p>" for p in LONG[:half]) + junk + "".join(f"<p>{p}</p>" for p in LONG[half:]) + junk
    for page in (f"<article>{inner}</article>{junk}", f"<main><div>{inner}</div></main>", f"<article id='post'><h1>Top</h1>{inner}</article>"):
        assert html.extract(f"<html><body>{page}</body></html>").removeprefix("Top\n") == "\n".join(LONG)


@pytest.mark.parametrize("name", ["has-sidebar", "with-menu", "no-comments", "sidebar-layout", "page-with-nav", "banner-page", "widget-content", "site-header-fixed"])
def test_html_keeps_wrappers(name):
    inner = f"<div class='sidebar'><p>Beside it, some words, of no use.</p></div><h1>Top</h1><div class=content>{BODY}</div>"
    assert html.extract(f"<html><body><div class='{name}'>{inner}</div></body></html>") == "\n".join(["Top", *LONG])


def test_html_drops_a_thread_longer_than_the_text():
    thread = "".join(f"<div class='comment'><p>{p}</p></div>" for p in LONG * 2)
    assert html.extract(f"<body><article>{BODY}<div class='comments-area'>{thread}</div></article></body>") == "\n".join(LONG)


def test_html_of_odd_pages(spark):
    long_ = "<article>" + "".join(f"<p>Sentence {k}, with words, and more.</p>" for k in range(60_000)) + "</article>"
    rows = [(1, "u", long_), (2, "u", None), (3, None, ""), (None, "u", "<p>Same, text, here, and there.</p><div><p>Same, text, here, and there.</p></div>"), (4, "u", "<" * 2000), (4, "u", "<" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = {r.page_id: r for r in html.extract_pages(df).collect()}
    assert got[1].text.count("\n") == 59_999 and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[None].text.startswith("Same")
    assert html.extract_pages(df).count() == 6 and html.extract_pages(df.limit(0)).count() == 0
