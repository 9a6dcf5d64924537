import numpy as np
from pyspark.sql import functions as F

from strataleaf.llm import markup as M


def kinds(text):
    return sorted({m for _, _, _, m in M.read_signs([text])[0]})


def test_kinds_of_markup():
    assert kinds("<p>x</p>") == ["html"] and kinds("during the<br> season") == ["html"] and kinds("a &nbsp;b") == ["html"] and kinds("&lt;i&gt;x") == ["html"]
    assert kinds("## Head\n\ntext") == ["markdown"] and kinds("a **b** c") == ["markdown"] and kinds("Head\n====\n\n- a\n- b") == ["markdown"] and kinds("see [x](https://a.example/1)") == ["markdown"]
    assert kinds("== Head ==\nx") == ["wiki"] and kinds("the '''x''' y") == ["wiki"] and kinds("[[a|b]] {{cn}}") == ["wiki"]
    assert kinds("\\section{A}\nx") == ["latex"] and kinds("is $L = \\frac{a_{2}}{b}$.") == ["latex"] and kinds("a \\emph{b}.~\\ref{c}") == ["latex"]
    assert kinds("<b>x</b>\n\n\\section{Part two}\ny") == ["html", "latex"]


def test_plain_signs_are_no_markup():
    for text in [
        "The rate applies where 7 < n < 563 units flow.", "from $82 to $251 each", "The area is 75*811 feet, see note [75]. alike*, as", "is 28 == 887 in", "F:\\t10\\old on",
        "Item 73_882 is {reserved}.", "Signed ________________ (holder).", "A|B and C|D", "Form #58 or\n#559", "a & b; it's 'final' in 71.", "~46 and 5^2", "x\n(Source: 'P.A. 9-1', 'note ''a'' of 1-2-30'.)", "", None,
        "words\nin a hard\nbreak  \nhere",
    ]:
        assert kinds(text) == [], text


def test_parts_keep_structure():
    page = "<html><head><title>t</title><style>p{}</style></head><body><h2>Head</h2><p>A <strike>old</strike> <u>new</u>&nbsp;rule</p><ul><li>one<li>two</ul><code>x = 1</code><table><tr><td>a</td><td>b</td></tr></table></body></html>"
    assert M.parts_of(page, M.read_signs([page])[0]) == [("heading", "Head"), ("text", "A new rule"), ("item", "one"), ("item", "two"), ("code", "x = 1"), ("row", "a | b")]
    md = "# Head\n\ntext **bold** and `code`\n\n- one\n- two\n\n```\nraw *x*\n```\n\n| a | b |\n|---|--:|\n| 1 | 2 |\n\nHead two\n====\n\nend"
    assert M.parts_of(md, M.read_signs([md])[0]) == [("heading", "Head"), ("text", "text bold and code"), ("item", "one"), ("item", "two"), ("code", "raw *x*"), ("row", "a | b"), ("row", "1 | 2"), ("heading", "Head two"), ("text", "end")]
    tex = "\\section{Head}\nA \\textbf{b}.~\\ref{x}\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}\n\\[ F = \\sum_i r_i \\]\nend $x_{1}$"
    assert M.parts_of(tex, M.read_signs([tex])[0]) == [("heading", "Head"), ("text", "A b."), ("item", "one"), ("item", "two"), ("formula", "F = \\sum_i r_i"), ("text", "end"), ("formula", "x_{1}")]
    wiki = "== Head ==\nthe '''b''' [[A rules|a]] [https://a.example text] {{cn}}\n[[Category:X]]\n{| class=\"g\"\n! a !! b\n|-\n| 1 || 2\n|}"
    assert M.parts_of(wiki, M.read_signs([wiki])[0]) == [("heading", "Head"), ("text", "the b a text"), ("row", "a | b"), ("row", "1 | 2")]


def test_escaped_leftovers_go_too():
    for odd, plain in [("Step &lt;strike&gt;follows&lt;/strike&gt; it", "Step follows it"), ("a &amp;nbsp;b", "a b"), ("x &sect;&#160;4", "x § 4"), ("if a &lt; b &amp; c", "if a < b & c")]:
        assert M.parts_of(odd, M.read_signs([odd])[0]) == [("text", plain)]


def test_held_out_accuracy_of_labelled_pages():
    pages = list(M.labelled_pages(300, seed=99))
    found = M.read_signs([t for t, _, _ in pages])
    right = wrong = 0
    for (text, _, spans), signs in zip(pages, found):
        want = {label for a, b, label in spans if label != "plain" and text[a:b].strip()}
        got = {m for _, _, _, m in signs}
        right += got == want
        wrong += got != want
    assert right >= 0.98 * (right + wrong)


def test_marginals_against_brute_force():
    tree = M.Tree("<b>a **b** c</b> $1")
    kinds_of = M._parent_kind(np.asarray(tree.look))
    unary, pair = M.potentials()
    rng = np.random.default_rng(0)
    unary, pair = unary + rng.normal(size=unary.shape), pair + rng.normal(size=pair.shape)
    n, k = len(tree.look), len(M.STATES)
    weights = np.zeros((n, k))
    for state in np.ndindex(*[k] * n):
        score = sum(unary[tree.look[i], s] for i, s in enumerate(state)) + sum(pair[kinds_of[p], state[p], state[i]] for i, p in enumerate(tree.parent) if p >= 0)
        for i, s in enumerate(state):
            weights[i, s] += np.exp(score)
    weights /= weights.sum(1, keepdims=True)
    two = np.exp(M.marginals([tree, M.Tree("== x ==\n"), tree], unary, pair))
    assert np.allclose(two[:n], weights) and np.allclose(two[-n:], weights)


def test_over_a_table(spark):
    long = "**b** plain words " * 20_000
    rows = [(1, "<p>x", "m"), (1, "<p>x", "m"), (2, None, "m"), (3, "", "m"), (4, "plain", "m"), (5, long, "m"), (6, "<" * 5000 + "\\" * 5000 + "[[" * 2000, "m")]
    df = spark.createDataFrame(rows, "id int, text string, markup string")  # a clashing name
    got = sorted((r.id, r.markup) for r in M.kinds_found(df, ["id"], F.col("text")).collect())
    assert [g for g in got if g[0] < 6] == [(1, "html"), (1, "html"), (5, "markdown")]
    parts = {r.id: r.p for r in df.select("id", M.clean_parts(F.col("text")).alias("p")).collect()}
    assert parts[2] == [] and parts[3] == [] and [tuple(p) for p in parts[4]] == [("text", "plain")]
    assert M.kinds_found(df.limit(0), ["id"], F.col("text")).count() == 0


def test_seeking_starts_first_misses_no_sign():
    for text, _, _ in M.labelled_pages(200, seed=5):
        page, direct, at = "\n" + text, [], 0
        templates = M.template_ends(page)
        while m := M._SIGN.search(page, at):
            kind, at = "wikihead" if m.lastgroup == "eq" else m.lastgroup, max(m.end(), m.start() + 1)
            if kind != "template":
                direct.append((kind, m.start(), m.end()))
            elif templates.get(m.start(), 0) > m.start() + 4:
                at = templates[m.start()]
                direct.append((kind, m.start(), at))
            else:
                at = m.start() + 1
        assert list(M.signs_in(page)) == direct


def kinds(text):
    return sorted({m for _, _, _, m in M.read_signs([text])[0]})


def test_a_second_section_after_a_trailer_is_read():
    second = "\n(5 ILCS 2/4)\nThe **holder** keeps *one* copy.\n- a list\n- of two\n"
    assert kinds("(5 ILCS 2/3)\nThe holder files.\n(Source: P.A. 90-1 | 91-2, 'note ''a'' of 1-2-30'.)" + second) == ["markdown"]
    assert kinds("(5 ILCS 2/3)\nThe holder files.\n(Source: P.A. 90-1 | 91-2, 'note ''a'' of 1-2-30'.)\n") == []
    assert M.trailers("a (Source: b (c) d.) e\n(Source: open\n\nnext (Source: x") == ([2, 23, 43], [20, 38, 53])


def test_no_length_hides_a_sign():
    words = "holder " * 100
    assert kinds(f"It is **{words}kept**.") == ["markdown"]
    assert kinds("{{Infobox act|" + "|".join(f"field {i}=value" for i in range(40)) + "}} The holder files.") == ["wiki"]
    assert kinds(f"See [[{words}|the Act]].") == ["wiki"] and kinds(f"$x_{{1}} = {words}$") == ["latex"]
    nested = "{{a|{{b|c}}|d}} stays {{open"
    assert [p for _, p in M.parts_of(nested, M.read_signs([nested])[0])] == ["stays {{open"]


def test_deep_and_unclosed_elements():
    deep = "<div>" * 3000 + "words" + "</div>" * 3000
    assert kinds(deep) == ["html"] and M.parts_of(deep, M.read_signs([deep])[0]) == [("text", "words")]
    tree = M.Tree("<b>a <i>b</i></b> <u>c")
    assert [tree.parent[n] for n, _, _, _ in tree.signs] == [1, 2, 3, 2, 1]


def test_messages_decide(monkeypatch):
    """Quotes are plain in a trailer and markup in a line; without what the tree says of parents they are alike."""
    text = "The holder files.\n(Source: P.A. 90-1, ''noted'' 1-2-30.)\n"
    assert kinds(text) == [] and kinds("The ''holder'' files.\n") == ["wiki"]
    unary, pair = M.potentials()
    monkeypatch.setattr(M, "potentials", lambda: (unary, pair * 0))
    assert (kinds(text), kinds("The ''holder'' files.\n")) != ([], ["wiki"])
