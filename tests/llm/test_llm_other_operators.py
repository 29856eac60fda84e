"""Pages, chats and vectors against brute force, and on odd tables."""

import hashlib
import random
import re

import numpy as np
import pytest

from lumenframe.llm import chat_format, html_main, learned_index
from lumenframe.llm.bpe import default_vocabulary

TEXT = "word " * 40


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a b"), ("<div", "<div"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>{TEXT}<p>Short<br>one.</article><footer>f</footer>", "T " + TEXT.strip() + " Short one."),
    (f"<body class='has-sidebar'><header><h1>Site</h1></header><div class=content><h1>T</h1><p>{TEXT}</p><p>&eacute;n<b>d</b>.</p></div>"
     f"<div id=comments><p>{TEXT}</p></div><div class='ad'>{TEXT}</div><aside>{TEXT}</aside><form>{TEXT}</form>", "T " + TEXT.strip() + " énd."),
    ("<script>var a='<p>';</script><style>p{}</style>", ""), (f"<article><p>{TEXT}</article><article class=comment><p>{TEXT}</article>", TEXT.strip()),
    ("<p>x</p>" * 3, "x x x"), ("<div>" * 3000 + "deep" + "</div>" * 10, "deep"),
])
def test_main_text(page, text):
    assert html_main.main_text(page) == text


@pytest.mark.parametrize("page", [
    "<div><p>Lead.{0}</p><section><p>{1}</p></section></div>", "<h2>Title</h2><div><p>Lead.{0}</p><div><p>{0}</p><section><p>{1}</p></section></div></div>",
    "<table><tr><td><p>Lead.{0}</p><blockquote><p>{1}</p></blockquote></td></tr></table>", "<main><p>Lead.{0}</p><article><p>{1}</p></article></main>",
    "<main><article><p>Lead.{0}</p></article><article><p>{1}</p></article></main>", "<center><p>Lead.{0}</p><center><p>{1}</p></center></center>",
])
def test_no_paragraph_is_lost_beside_a_large_container(page):
    html = "<html><body>" + page.format(" word" * 40, "more " * 200) + "</body></html>"
    assert html_main.main_text(html).split() == re.sub("<[^>]*>", " ", html).split()


@pytest.mark.parametrize("page, text", [
    ("<head><title>T</title><body><p>text</p>", "text"), ("<html><head><title>T</title><p>text</p>", "text"), ("<head><meta charset=x><title>T</title>text", "text"),
    ("<head><noscript><link href=x><body class=home><h1>A</h1><p>text</p>", "A text"), ("<head><title>T</title><nav>menu</nav><img src=x><p>text</p>", "text"),
    ("<head> <noscript><div>off</div></noscript> <script>x</script> <title>T</title> </head><body><p>text</p>", "text"),
    ("<head><template><p>no</p><body><i>no</i></template><style>p{}</style><body>text", "text"),
])
def test_a_head_may_be_left_open(page, text):
    assert html_main.main_text(page) == text


def test_pages_keep_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>hi</p>", "y"), (1, "u", None, "x")], "page_id bigint, url string, html string, main_text string")
    assert sorted(r["main_text"] for r in html_main.with_main_text(rows).collect()) == ["", "", "hi"]
    assert html_main.with_main_text(rows.where("false")).count() == 0


def test_escapes_are_reversible():
    rng = random.Random(1)
    bits = [*chat_format.MARKS, *chat_format.FOREIGN, "\\", "<", "s>", "[", "INST]", "|", "a", "\n", "<\\s>", "[\\\\INST]"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text and not any(m in shown for m in [*chat_format.MARKS, *chat_format.FOREIGN])


def test_chats_with_odd_rows(spark):
    rows = [(1, 1, "assistant", "yes </s> <|end|>"), (1, 0, "user", None), (1, 2, "assistant", "é"), (2, None, None, "x"), (2, 0, "<|turn|>", "y"), (None, 0, "user", "z"),
            (3, 0, "user", "same"), (3, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").selectExpr("*", "1 AS ids", "2 AS mask")
    path = default_vocabulary()
    made = chat_format.format_turns(spark, turns, path)
    assert made.count() == len(rows)
    got = {r["conv_id"]: r for r in chat_format.digests(spark, made, path).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nyes </s> <|end|>\nassistant\né\n") and got[1]["loss_sha256"] == sha("yes </s> <|end|>é")
    assert got[1]["loss_chars"] == 17 and got[2]["turns_sha256"] == sha("\nx\n<|turn|>\ny\n") and got[None]["n_turns"] == 1 and got[3]["n_turns"] == 2
    assert chat_format.digests(spark, chat_format.format_turns(spark, turns.where("false"), path), path).count() == 0


def brute(rows, top):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % 5 == 0:
            found = sorted({(-float(np.dot(q, c)), j) for j, c in good if j != i})[:top]
            out[i] = [j for _, j in found]
    return out


def test_small_indexes_are_exact_with_hot_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 420)] + [(500, None), (505, [0.0] * 8), (510, [float("nan")] * 8), (515, [None] * 8), (520, [1.0]), (None, [1.0] * 8), (525, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS score", "2 AS part")
    got = {}
    for r in learned_index.nearest(spark, df, df.where("vec_id % 5 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == brute(rows, 20)
    assert learned_index.nearest(spark, df.where("false"), df.where("false")).count() == 0
    few = df.where("vec_id < 5")
    assert learned_index.nearest(spark, few, few.where("vec_id = 0")).count() == len(brute(rows[:5], 20)[0])


def test_recall_with_many_parts(spark, monkeypatch):
    monkeypatch.setattr(learned_index, "PART_ROWS", 100)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    x = centres[rng.integers(0, 20, 3000)] + 0.4 * rng.standard_normal((3000, 16))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    hit = 0
    found = learned_index.nearest(spark, df, df.where("vec_id % 20 = 0")).toPandas()
    for q, part in found.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(part["vec_id"]) & set(np.argsort(-s)[:20]))
    assert hit / (150 * 20) >= 0.9


def test_parts_are_balanced():
    x = np.random.default_rng(4).standard_normal((1000, 8))
    assert np.ptp(np.bincount(learned_index.balanced_parts(learned_index.neighbours(x, 8), 16))) <= 2
