import collections
import random

from rubrica.llm import decontaminate as D
from rubrica.llm import html_text as H

RNG = random.Random(9)
VOCAB = [f"v{i}" for i in range(800)] + ["the", "of", "and"] * 60


def words(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


def test_leaks_are_found_and_clean_documents_left(spark, docs):
    items = [(i, f"{words(20)}. {words(6)}.") for i in range(60)] + [(60, f"What is {words(9)}? {words(2)}."), (61, words(150)), (62, None), (63, ""), (None, words(30)), (1, words(25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, words(RNG.randint(1, 400))) for i in range(150)]
    planted = []
    for n, (i, t) in enumerate(items):
        if t:
            rows.append((1000 + n, f"{words(RNG.randint(0, 200))} {t.upper() if n % 2 else t} {words(RNG.randint(0, 200))}"))
            planted.append((1000 + n, i))
    half = items[0][1].split()
    rows += [(3000, " ".join(half[: len(half) // 2])), (3001, None), (3002, ""), (1000, rows[0][1]), (None, items[5][1]), (3003, words(20_000) + " " + items[7][1])]
    out = D.contaminated(docs(rows, extra=["item_id", "score"]), bench).collect()
    assert collections.Counter((r.doc_id, r.item_id) for r in out) == collections.Counter([*planted, (None, 5), (3003, 7)])
    assert all(r.score >= 0.6 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in out)
    assert D.contaminated(docs([]), bench).count() == 0 and D.contaminated(docs(rows), bench.where("item_id > 1000")).count() == 0


def test_several_blocks_find_what_one_finds(spark, docs, monkeypatch):
    items = [(i, f"{words(20)}. {words(6)}.") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs([(i, words(50) + " " + items[i][1]) for i in range(30)])
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench).collect()} == {(i, i) for i in range(30)}


def test_block_max_wand_is_exact():
    texts = [(i, words(RNG.randint(5, 60))) for i in range(120)]
    units = [w[s : s + 64] for _, t in texts for w in [D.words_of(t)] for s in D.starts(len(w), 64)]
    df = collections.Counter(t for u in units for t in set(u))
    x = D.Index(texts, df, len(units), sum(map(len, units)) / len(units), 64)
    for _ in range(150):
        q = sorted({x.terms[t] for u in RNG.sample(units, 3) for t in u[: RNG.randint(1, 60)]})
        score = collections.Counter()
        for t in q:
            for u, s in zip(x.units[t], x.impacts[t], strict=True):
                score[u] += s
        for least in (0.05, 0.3, 0.6):
            assert {u for u, _ in x.retrieve(q, least)} == {u for u, s in score.items() if s >= least - 1e-9}


def test_questions_and_answers():
    assert D.question_and_answer("Who? Me.") == ("Who?", " Me.")
    assert D.question_and_answer("One two. Three four.") == ("One two.", " Three four.")
    assert D.question_and_answer("one two three") == ("one two ", "three")


MODEL = H.train()


def test_main_text_of_pages(spark):
    cases = {
        '<html><body><div class="cookie-notice">We use cookies. Accept all of them please.</div><div class="content"><h1>T</h1><p>Hello world, this is good text.</p><div class="ad">Buy now.</div><p>More &amp; more.</p></div><div id="comments"><h3>Comments</h3><p>Nice post, I liked it a lot.</p></div><aside><p>Related story text here.</p></aside></body></html>': "T Hello world, this is good text. More & more.",
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A  title</h1><p><b>bold.<br><p>Unclosed\n text a<i>b</i>c.</article><footer>&copy; x</footer><script>var t="</p>";</script>': "A title bold. Unclosed text abc.",
        "": "",
        "<p": "<p",
    }
    rows = [(i, f"u{i}", h) for i, h in enumerate(cases)] + [(90, None, None), (None, "u", list(cases)[0]), (91, "u", "<div>" * 3000 + "x"), (92, "u", "</p></div>&amp")]
    out = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), MODEL).collect()}
    for i, want in enumerate(cases.values()):
        assert out[i].text == want and out[i].n_chars == len(want)
    assert out[91].text == "x" and out[92].text == "&"
    assert out[90].text == "" and out[None].text == list(cases.values())[0] and len(out) == len(rows)


def test_marginals_match_enumeration():
    import itertools
    import math

    import numpy as np

    page = H.parse("<article><h1>a</h1><div class=ad><p>b</p></div></article><footer>c</footer>")
    f = H.Forest([page])
    rng = np.random.default_rng(0)
    m = H.Model(rng.normal(size=len(H.FEATURES)), rng.normal(size=(H.KINDS, 2, 2)))
    total, z = np.zeros((f.n, 2)), 0.0
    score = np.bincount(f.owner, m.weights[f.flat], f.n)
    for x in itertools.product((0, 1), repeat=f.n):
        w = math.exp(sum(score[i] * x[i] for i in range(f.n)) + sum(m.edges[f.kind[i], x[f.parent[i]], x[i]] for i in range(f.n) if not f.root[i]))
        z += w
        for i in range(f.n):
            total[i, x[i]] += w
    assert np.allclose(m.messages(f)[0], total / z)


def test_held_out_layouts():
    import numpy as np

    pages, labels = H.labelled_pages(120, 77)
    p = MODEL.messages(H.Forest(pages))[0][:, 1]
    y = np.asarray([v for own in labels for v in own])
    text = np.asarray([c > 0 for g in pages for c in g.chars])
    assert ((p > 0.5) == y)[text].mean() > 0.97


def test_short_and_bare_pages_keep_their_text_and_comments_go():
    from rubrica.llm import html_text as H

    cases = {
        "<html><body><article><p>Short one.</p></article></body></html>": "Short one.",
        "<body><article><h1>T</h1><p>Body text goes here and is long enough.</p><section class='comments'><article><p>Nice, thanks!</p></article><article><p>I agree.</p></article></section></article></body>": "T Body text goes here and is long enough.",
        "<body><article><h1>T</h1><p>Body text goes here and is long enough.</p></article><ol id=comment-list><li><p>Nice, thanks!</p></li></ol></body>": "T Body text goes here and is long enough.",
        "<body><article><p>one</p><svg class='i'/><p>two</p></article></body>": "one two",
        "<body><article><p>one</p><svg><text>no</text></svg><p>two <math><mi>x</mi></math></p></article></body>": "one two x",
        "<body class='has-sidebar'><nav><a href=x>Home</a></nav><div><p>Plain page text.</p></div><footer>(c) x</footer></body>": "Plain page text.",
        "<body><div class='zork'><h1>Plain title</h1><p>Text without names. And more of it.</p></div></body>": "Plain title Text without names. And more of it.",
        "<p>Only a paragraph</p>": "Only a paragraph",
        "<body>just text</body>": "just text",
        "<body><main><p>A</p></main></body>": "A",
        "<body><nav><ul><li><a href=x>Home</a></li></ul></nav><footer>(c) x</footer></body>": "",
        "<body><article><p><b><i><em><span><u>deep</u></span></em></i></b><div>next</div></article></body>": "deep next",
    }
    assert dict(zip(cases, H.main_texts(H.train(), list(cases)), strict=True)) == cases


def test_a_page_of_nothing_weighs_one_state_only():
    import itertools

    import numpy as np

    from rubrica.llm import html_text as H

    rng = np.random.default_rng(1)
    model = H.Model(rng.normal(size=len(H.FEATURES)), rng.normal(size=(H.KINDS, 2, 2)), -1.3)
    page = H.parse("<body><div><p>a b.</p><p>c</p></div></body>")
    f = H.Forest([page])
    unary = np.bincount(f.owner, model.weights[f.flat], f.n)
    total, content = 0.0, np.zeros(f.n)
    for y in itertools.product((0, 1), repeat=f.n):
        w = np.exp(sum(unary[i] * y[i] for i in range(f.n)) + sum(model.edges[f.kind[i], y[f.parent[i]], y[i]] for i in range(1, f.n)) + (model.nothing if not any(y) else 0))
        total += w
        content += w * np.asarray(y)
    assert np.allclose(model.contents(f), content / total)


#: Layouts that training pages don't have as such, or whose names tell nothing.
LAYOUTS = {
    "<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav><p>One paragraph of the article.</p><p>Another one follows it here.</p><footer>(c) x</footer></body>": "One paragraph of the article. Another one follows it here.",
    '<body><article class="post tags-news toast"><h1>Title</h1><p>Some text of the article is here.</p><p>More.</p></article></body>': "Title Some text of the article is here. More.",
    '<nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>A  title</h1><p>Text.</article><footer>&copy; x</footer>': "A title Text.",
    '<body><div class="zq1"><ul><li><a href=/a>Start</a></li><li><a href=/b>News</a></li><li><a href=/c>Shop</a></li></ul></div><div class="lorp-9"><h1>Rivers rise</h1><p>The river rose by two metres on Monday.</p><p>Nobody was hurt, said the mayor.</p></div><footer class="qq"><p>&copy; 2024 Paper.</p></footer></body>': "Rivers rise The river rose by two metres on Monday. Nobody was hurt, said the mayor.",
    "<html><body><header><h1>Site</h1></header><h2>A heading</h2><p>First the cat sat down.</p><ul><li>one thing</li><li>another thing</li></ul><aside><p>Read also this story.</p></aside><p>Then it left.</p><footer>&copy; x</footer></body></html>": "A heading First the cat sat down. one thing another thing Then it left.",
    '<body><main class="kolp vand"><h1>Bread</h1><p>Mix flour and water.</p><blockquote>Bread is life.</blockquote></main><aside class="ulk"><ul><li><a href=1>x y</a></li><li><a href=2>z</a></li></ul></aside></body>': "Bread Mix flour and water. Bread is life.",
    '<body><table class="ux"><tr><td><p>An old page with a table layout has its text in a cell.</p><p>It goes on here, for a while.</p></td></tr></table></body>': "An old page with a table layout has its text in a cell. It goes on here, for a while.",
    '<body><section class="brim"><section><h2>Part one</h2><p>It began in May.</p></section><section><h2>Part two</h2><p>It ended in June.</p></section></section><form><label>Name</label><input><button>Go</button></form></body>': "Part one It began in May. Part two It ended in June.",
}


def test_layouts_whichever_pages_are_drawn():
    for model in (MODEL, H.train(seed=12), H.train(seed=13)):
        assert dict(zip(LAYOUTS, H.main_texts(model, list(LAYOUTS)), strict=True)) == LAYOUTS


def test_pages_of_any_kind(spark):
    from pyspark.sql import functions as F

    page = list(LAYOUTS)[0]
    long = "<article>" + "<p>A sentence of the article, which goes on.</p>" * 20_000 + "</article>"
    rows = [(1, "u", page)] * 3 + [(None, None, page), (2, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(1), "h": F.lit("x"), "k": F.lit(0)})
    out = H.extract(df, MODEL).collect()
    assert [r.text for r in out if r.page_id != 2] == [LAYOUTS[page]] * 4
    assert next(r.text for r in out if r.page_id == 2) == " ".join(["A sentence of the article, which goes on."] * 20_000)
    assert H.extract(df.where("false"), MODEL).collect() == []
