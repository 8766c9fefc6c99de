import random

import numpy as np
import pytest

from gapfold.llm import spam, spam_pages

HEAD = "commit 0123456789abcdef0123456789abcdef01234567\nAuthor: A B <a@b.test>\nDate:   2025-01-01 00:00:00 +0000\n\n"


def commit(message, added=(), path="docs/a.md"):
    diff = f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,1 +1,9 @@\n old line here\n" + "".join(f"+{x}\n" for x in added) if added else ""
    return HEAD + "".join(f"    {x}\n" for x in message.split("\n")) + "\n" + diff


def spam_texts(rng):
    thing = rng.choice(["running shoes", "cheap watches", "sofas de jardín", "кожаные сумки", "Gartenstühle"])
    word = lambda: rng.choice(["buy", "best", "kaufen", "comprar", "купить", "price", "promo", "oferta"])
    tag = lambda: rng.choice(["#", "@", "#"]) + rng.choice(["Best", "Buy", "Cheap", ""]) + "".join(w.title() for w in thing.split()) + rng.choice(["Shop", "Sale", "7"])
    url = lambda: f"https://{word() if word().isascii() else 'best'}-{rng.choice(['shoes', 'lamps'])}{rng.randrange(99)}.example/p/{rng.randrange(999)}"
    return [
        commit("first page", [" ".join(f"{word()} {thing}" for _ in range(4)) for _ in range(8)]),
        commit("first page", [url() for _ in range(9)], "links.txt"),
        commit("first page", [f'<a href="{url()}">{word()} {thing}</a><br>' for _ in range(9)], "index.html"),
        commit("first page", [f"| {thing} | {word()} | 9,99 | {url()} |" for _ in range(9)]),
        commit("first page\n" + "\n".join(" ".join(tag() for _ in range(4)) for _ in range(7))),
        commit("first page", [tag() for _ in range(20)], "tags.md"),
        commit(f"If you want {thing}, our {thing} are the best {thing} for every {thing} lover. " * 8),
        commit("first page", ["/* " + " ".join(f"{word()} {thing};" for _ in range(3)) + " */" for _ in range(9)], "a.css"),
    ]


def honest_texts(rng):
    w = lambda: rng.choice(["buffer", "parser", "socket", "window", "ledger", "voxel"])
    prose = lambda: f"This keeps the {w()} order stable and drops the {w()} that the {w()} returned."
    return [
        commit(f"fix: {w()}\n\n{prose()}", [f"    {w()} = {w()}({rng.randrange(9)}, {w()})" for _ in range(9)], "a.py"),
        commit("test repeated input", [f'    text = "{" ".join([w()] * 60)}"', "    assert count(text) == 60"], "t.py"),
        commit("build: refresh lock file", [f'      "resolved": "https://registry.{w()}.example/{w()}.tgz",' for _ in range(12)], "package-lock.json"),
        commit("docs: changelog", [f"* {prose()} ([#{i}](https://forge.example/{w()}/pull/{i}))" for i in range(9)]),
        commit("Add reading list", [f"- [{w()}](https://{w()}.example/{w()}): {prose()}" for _ in range(9)]),
        commit(f"docs: explain {w()}\n\n{prose()}", [prose() for _ in range(4)] + [f"[{w()}{i}]: https://docs.{w()}.example/{w()}" for i in range(5)]),
        commit("Add names", [f"{w()}_{w()}" for _ in range(50)], "wordlist.txt"),
        commit("Seed rows", [f"INSERT INTO product VALUES ({i}, 'garden lamps', 9.9, 'tag1,tag2');" for i in range(12)], "seed.sql"),
        commit("Merge branch 'x'\n\n# Conflicts:\n" + "\n".join(f"#\tsrc/{w()}/{w()}_{i}.py" for i in range(9))),
        commit("style", [f".{w()}-{w()} {{ color: #aabbcc; margin: 1px 2px; }}" for _ in range(12)], "site.css"),
    ]


def test_held_out_texts(spark):
    rng = random.Random(7)
    rows = [(i, t, True) for i, t in enumerate(x for _ in range(5) for x in spam_texts(rng))]
    rows += [(1000 + i, t, False) for i, t in enumerate(x for _ in range(5) for x in honest_texts(rng))]
    df = spark.createDataFrame(rows, "doc_id long, text string, want boolean").selectExpr("doc_id", "text", "want", "1 as symbols", "2 as words", "3 as labels")
    got = {r.doc_id for r in spam.spam_documents(df).collect()}
    assert got == {i for i, _, want in rows if want}


def test_edges(spark):
    junk = spam_texts(random.Random(1))[0]
    rows = [(1, None), (2, ""), (3, " \n\r\n\t"), (4, "+++---@@"), (5, junk), (5, junk), (None, junk), (6, junk.replace("\n", "\r\n")), (7, junk.replace("\n", "\r")), (8, "word " * 300_000), (9, "buy shoes " * 100_000), (10, "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id) for r in spam.spam_documents(df).collect())
    assert [g for g in got if g not in (8,)] == [-1, 5, 5, 6, 7, 9]
    assert spam.spam_documents(df.limit(0)).count() == 0


def best(seq, m):
    """Best path by listing every path."""
    import itertools

    x, top = [spam.SYMBOLS.index(c) for c in seq], (-1.0, None)
    for p in itertools.product(range(4), repeat=len(x)):
        like = m.first[p[0]] * m.emit[p[0], x[0]]
        for a, b, s in zip(p, p[1:], x[1:]):
            like *= m.move[a, b] * m.emit[b, s]
        top = max(top, (like, p))
    return top[1]


def test_labels_match_enumeration():
    m = spam.Model.stored()
    seqs = ["SPKKP", "", "NNN", "C", "MKTTS"]
    paths = [tuple(int(v) for v in p) for p in spam.labels(seqs, m)]
    assert [p for p in paths if p] == [best(s, m) for s in seqs if s] and paths[1] == ()


def test_stored_model_is_the_learnt_one():
    a, b = spam.Model.stored(), spam_pages.learn()
    assert all(np.allclose(x, y, atol=1e-5) for x, y in ((a.first, b.first), (a.move, b.move), (a.emit, b.emit)))


def test_held_out_scripts(spark):
    """Pages in scripts the model was not counted on, and of another seed."""
    rng = random.Random(99)
    want, rows = set(), []
    for i in range(2000):
        want |= {i} if i % 4 == 0 else set()
        rows.append((i, HEAD + "".join(f"    {x}\n" for x, _ in spam_pages.page(rng, spam_pages.HELD_OUT, i % 4 == 0))))
    got = {r.doc_id for r in spam.spam_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & want) / len(want) >= 0.9 and len(got & want) / len(got) >= 0.9


def test_a_page_does_not_depend_on_others(spark):
    rng = random.Random(5)
    pages = [(i, t) for i, t in enumerate(spam_texts(rng))]
    alone = {i for i, t in pages if spam.spam_documents(spark.createDataFrame([(i, t)], "doc_id long, text string")).count()}
    assert alone == {i for i, _ in pages}


@pytest.mark.parametrize("lines", [
    ["viagra pills pharmacy casino poker loans mortgage replica handbags"] * 8,
    ["激安時計", "激安時計 通販", "時計激安", "通販 激安時計 送料無料", "激安時計 送料無料", "激安時計", "時計通販 激安"] * 3,
    ["सस्ते जूते खरीदें", "जूते सस्ते ऑनलाइन", "सस्ते जूते ऑनलाइन खरीदें", "खरीदें जूते सस्ते"] * 4,
    ["дешёвые сумки купить", "сумки дешёвые онлайн купить", "купить сумки онлайн"] * 5])
@pytest.mark.parametrize("first", ["", "Index: page", "diff - all our offers", "To: everyone", "From: our shop"])
def test_repetition_in_any_script_behind_any_first_line(lines, first):
    text = "\n".join([first, *lines])
    s, w = spam.describe(text)
    n, lab = np.array(w), spam.labels([s], spam.Model.stored())[0]
    assert n[lab > 0].sum() / n.sum() >= 0.5


def test_long_anchor_texts_that_repeat():
    rng = random.Random(4)
    things, lures = ["sofa covers", "garden lamps", "leather boots"], ["cheap", "best", "online", "today", "grey", "large"]
    text = "\n".join(f'<a href="https://a{i}.example/p">{" ".join(f"{rng.choice(lures)} {rng.choice(things)} {rng.choice(lures)}" for _ in range(3))}</a><br>' for i in range(12))
    assert set(spam.describe(text)[0]) == {"K"}


def test_only_a_commit_has_a_header():
    assert spam.changed_lines("Date: today\nhello") == ["Date: today", "hello"]
    assert spam.changed_lines("commit 0123456789\nAuthor: a\nDate: b\n\nTo: you\n") == ["", "To: you", ""]
    assert spam.changed_lines("fix\nIndex: a.c\n====================\n--- a.c\n+++ a.c\n@@ -1,2 +1,2 @@\n same\n-old\n+new\nafter the patch") == ["fix", "old", "new", "after the patch"]
    assert spam.changed_lines("Index: a page\nof links") == ["Index: a page", "of links"]


@pytest.mark.parametrize(("line", "want"), [
    ("", ""), ("----", ""), ("fix", "S"), ("This keeps the order of all rows stable.", "P"), ("x = call(y)", "C"), ("https://best-shoes.example/p/1", "N"), ("https://docs.example/guide", "N"),
    ("[a1]: https://docs.example/x", "R"), ("#BestShoesSale #CheapShoes", "T"), ("buy shoes buy shoes buy shoes", "K"), ("src/a/b_c.py", "C"), ("alignBeam", "C"), ('"a": "buy cheap deals",', "C")])
def test_symbols(line, want):
    assert spam.symbol(line)[0] == want


def test_short_lines_that_repeat(spark):
    pages = [["sofa covers", "garden lamps cheap"] * 12, ["sofa covers", "sofa covers grey", "large sofa covers", "corner sofa"] * 4]
    honest = [["Red panel", "Oak floor", "Two large rooms", "Open kitchen", "Quiet street", "North window", "New roof", "Small yard", "Old barn", "Stone path", "Low fence"], ["fix typo", "fix typo", "fix typo"], [f"- name: {w}" for w in ("packWindow", "sort_probe", "map_cell", "trim_meter") * 4]]
    rows = [(i, commit("first page", p)) for i, p in enumerate(pages)] + [(10 + i, commit("first page", p)) for i, p in enumerate(honest)]
    assert sorted(r.doc_id for r in spam.spam_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [0, 1]


@pytest.mark.parametrize(("line", "want"), [
    ('<a href="https://a.example/p/1">buy cheap sofa covers and the best garden lamps online today</a><br>', "P"),
    ("https://a.example/p/1 sofa covers grey sofa covers large sofa covers corner sofa covers", "K"),
    ("https://a.example/p/1 #BestSofa #SofaShop #CheapSofa #SofaSale #SofaNow #SofaDeal #BuySofa #TopSofa #NewSofa", "T"),
    ("Merge branch 'main' of ssh://git.branch.example/branch/branch-a/branch-b/c/d into branch", "P"),
    ("See https://docs.example/guide for how this keeps the order of all rows stable when tasks fail.", "P")])
def test_words_beside_links(line, want):
    assert spam.symbol(line)[0] == want
