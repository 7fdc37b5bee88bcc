import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest

from tidemark.llm import markup, residue

RESIDUE = ["Hi {{first_name}}, thanks for posting!", "Regards, [COMPANY]", "Posted by %(title)s on <<author>>.", "Hello undefined,\n\nyour submission was received.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Body copy goes here.",
           "404 Not Found\n\nThe page you requested does not exist.", '{"error": 403, "message": "Too Many Requests"}', "Please enable JavaScript to view this discussion.", "Checking your browser before you continue.", "Seite nicht gefunden.", "Reminder for XX_TITLE_XX: all fine"]
FINE = ["[deleted]", "[removed]", "", None, "The letter literally started with 'Dear {first_name}', what a mess.", "Half the brochure was lorem ipsum, the printer hadn't noticed.", "I keep getting a 404 when I open the map page.", "The site kept asking me to turn on JavaScript, so I gave up.",
        '```\nprint(f"hello {name}")\n```\nfine', "{{Infobox place\n|name=Key\n|count=5\n}}\nok", "n_{i}^{4} \\cdot c and \\textbf{court}", "We got a 502 for an hour and the status page said all green."]


PHRASES = ["The page you are looking for could not be found.", "The thread could not be loaded.", "Double-click to edit this text.", "To be filled in by the editor.", "La page que vous cherchez n'existe plus.", "Dear <FIRST_NAME>, welcome.", "Hi {{" + "a" * 90 + "}}, hello", "Cette page n'existe pas sur le serveur",
           "Ray ID 77", "Contact the administrator.", "Insert your text here", "Acceso denegado", "Bitte versuchen Sie es später", "Editor to supply", "Page cannot be displayed.", "Your session has expired. Log in again to continue.", "Something went wrong on our end. Go back to the home page.", "Lorem ipsum",
           '{"error": 429, "message": "Too Many Requests", "id": "7ab"}']


@pytest.mark.parametrize("text", RESIDUE + PHRASES)
def test_residue(text):
    kinds, said, share = residue.evidence(text)
    assert max(kinds.values()) + (share >= 1) >= 2
    assert pa.compute.match_substring_regex(pa.array([text]), residue.PREFILTER).to_pylist() == [True]


@pytest.mark.parametrize("text", FINE)
def test_no_residue(text):
    assert residue.evidence(text)[0] == {}


def test_duplication_and_hosts_decide(spark):
    own = "We tried the oven twice this week, and it is fine. The soup was good as well. {}. Your session has expired."
    rows = [(f"i{k}", f"s{k}", None, own.format(w)) for k, w in enumerate(["Bread", "Cake", "Stew"])] + [("j", "s", None, own.format("Pie").replace("session", "link")), ("k", "s", "https://f.example/c/x/how_to_repair_a_tap/y/", "Repairing taps\nSomething went wrong. We like soup."), ("l", "s", "https://f.example/c/x/_/y/", "Soup\nSomething went wrong. We like soup.")]
    df = spark.createDataFrame(rows, "item_id string, subreddit string, permalink string, body string")
    assert {r.item_id for r in residue.found(df).collect()} == {"i0", "i1", "i2", "k"}
    assert {r.item_id for r in residue.totals(df, copies=99).filter("total >= 2").collect()} == {"k"}
    assert {r.item_id for r in residue.totals(df, mismatch=9.0).filter("total >= 2").collect()} == {"i0", "i1", "i2"}


def test_residue_tables(spark):
    rows = [("a", "s", None, "p", RESIDUE[0]), ("a", "s", None, "q", "fine"), ("b", None, None, None, None), ("c", "s", None, "/comments/x/some_other_words/y/", "Unrelated title here\nTry again later."), ("d", "s", None, None, "all good"), (None, "s", None, None, "fine")]
    df = spark.createDataFrame(rows, "item_id string, subreddit string, score int, permalink string, body string")
    assert {r.item_id for r in residue.found(df).collect()} == {"a", "c"}
    assert residue.clean(df).count() == 3
    assert residue.found(df.limit(0)).count() == 0


MARKUP = [("It was **so** good", {"markdown"}), ("a <b>bold</b> word", {"html"}), ("see [[Key|lock]] there", {"wiki"}), ("\\textbf{court} won", {"latex"}), ("5 &lt; 6", {"html"}), ("\n# Title\n\ntext", {"markdown"}), ("{{cite web|title=X|year=2019}}", {"wiki"}), ("$n^2 + b_3$ holds", {"latex"}), ("```\nx = 1\n```", {"markdown"}), ("<p>a</p> and ''b c''", {"html", "wiki"}),
          ("| a | b |\n|---|---|\n| c | 4 |", {"markdown"}), ("== Key ==\ntext", {"wiki"}), ("\\(\\sqrt{n} \\leq a\\)", {"latex"}), ("~~no~~ yes", {"markdown"})]
NO_MARKUP = ["I got 8 * 5 * 4 wrong, <3 to whoever caught it", "between $11 and $58", "if a < b and c > d then", "called max_retry_count with 2_000_000 rows", "¯\\(ツ)/¯", "see https://wiki.example/page/749 now", "Hi {{first_name}} and <<author>> and *|FNAME|*", "#6 reason I like it", "plain words", "", "a - b = c"]


@pytest.fixture(scope="module")
def trees():
    return markup.model()


@pytest.mark.parametrize("text,kinds", MARKUP)
def test_markup(trees, text, kinds):
    assert markup.kinds(text, trees) == kinds
    assert markup.candidates(pa.array([text])).to_pylist() == [True]


@pytest.mark.parametrize("text", NO_MARKUP)
def test_no_markup(trees, text):
    assert markup.kinds(text, trees) == set() and markup.plain(text, trees) == text


NESTED = [("- a <b>bold</b> word", {"markdown", "html"}, "- a bold word"), ("# The **Title** and [x](http://a.example/b)", {"markdown"}, "# The Title and x"), ("1. see \\textbf{x}", {"markdown", "latex"}, "1. see x"), ("> a &amp; *b*", {"markdown", "html"}, "> a & b"),
          ("| a **b** | `c|d` |\n|---|---|\n| c | 4 |", {"markdown"}, "a b\t`c|d`\nc\t4"), ("a <ref name=x>Smith</ref> b", {"wiki"}, "a (Smith) b"), ("a <nowiki>x</nowiki>", {"wiki"}, "a x"), ("&lt;i&gt;x&lt;/i&gt;", {"html"}, "&lt;i&gt;x&lt;/i&gt;"), ("5 &lt; 6 &amp; 7", {"html"}, "5 < 6 & 7"),
          ("{| class=\"w\"\n! a !! b\n|-\n| c || ''d''\n|}", {"wiki"}, "a\tb\nc\td"), ("\\begin{itemize}\\item a \\item \\textbf{b}\\end{itemize}", {"latex"}, "- a \n- b"), ("```py\nx = 1\n```", {"markdown"}, "```py\nx = 1\n```"), ("<pre><code>f(1 &lt; 2);</code></pre>", {"html"}, "```\nf(1 < 2);\n```"),
          ("holds for $" + "x_1 + " * 30 + "y$ only", {"latex"}, "holds for $" + "x_1 + " * 30 + "y$ only"), ("Title\n=====\ntext", {"markdown"}, "# Title\ntext"), ("<script>var a = 1;</script>done", {"html"}, "done")]


@pytest.mark.parametrize("text,kinds,out", NESTED)
def test_nested_markup(trees, text, kinds, out):
    assert markup.kinds(text, trees) == kinds
    assert markup.plain(text, trees) == out
    assert markup.plain(out, trees) == out


#: Written by hand in the manner of public manuals and forum posts, not by the module's grammar.
ELSEWHERE = [
    ("Use *args* and **kwargs** in the signature.", 1), ("Press <kbd>Ctrl</kbd>+<kbd>C</kbd> to stop it.", 1), ("The [[Battle of Hastings|battle]] took place in 1066.", 1), ("By definition $e^{i\\pi} + 1 = 0$, which is neat.", 1), ("Water is H_{2}O in this notation.", 1), ("### Installing\n\nRun the script.", 1),
    ("He was born in [[Lyon]] &mdash; the second city of France.", 1), ("> quoted from the manual\n\nI disagree.", 1), ("1. Preheat the oven\n2. Mix the flour", 1), ("![diagram](docs/diagram.png)", 1), ("See [the docs](https://docs.example/start) first.", 1), ("<!-- TODO: rewrite -->\nHello", 1), ("It is ~~wrong~~ right.", 1),
    ("{{Citation needed}} for that claim.", 1), ("''Romeo and Juliet'' is a play.", 1), ("Let $x$ be a real number.", 1), ("\\section{Introduction} We begin here.", 1), ("Copyright &copy; 2019", 1), ("<p>First</p><p>Second</p>", 1), ("| a | b |\n| --- | --- |\n| 1 | 2 |", 1), ("- milk\n- eggs\n- bread", 1), ("Run `git status` now.", 1),
    ("2 * 3 * 4 = 24", 0), ("The price went from $5 to $7 over the year.", 0), ("I paid 20$ and got 5$ back", 0), ("my_file_name.txt is missing", 0), ("We're #1 again!", 0), ("I <3 this place", 0), ("if x < 3 and y > 4 then stop", 0), ("AT&T and R&D are names", 0), ("rated 4.5* or 5* hotels", 0), ("he said \"no\" - and left", 0),
    ("e-mail me at <kim@mail.example>", 0), ("C:\\Users\\kim\\notes", 0), ("Dear {{first_name}}, welcome", 0), ("see https://a.example/x_y_z for it", 0), ("a^2 is not b", 0), ("10 - 5 = 5", 0), ("it costs $10*3 for all", 0), ("the 3*4 grid and the 5*6 grid", 0), ("<username> is a placeholder", 0), ("temperatures of -5 to -10", 0), ("#throwback to last year", 0), ("~20 people and ~30 dogs", 0),
]


def test_trees_decide_on_texts_of_another_origin(trees):
    right = sum(bool(markup.kinds(text, trees)) == bool(label) for text, label in ELSEWHERE)
    proposed = sum(bool(markup.parse(text)) == bool(label) for text, label in ELSEWHERE)
    assert right / len(ELSEWHERE) >= 0.9 and proposed / len(ELSEWHERE) < 0.85


def test_deep_nesting_is_no_recursion(trees):
    assert markup.plain("> " * 3000 + "**x**", trees).endswith("x")
    deep = "".join(f"<div>" for _ in range(3000)) + "x" + "</div>" * 3000
    assert markup.plain(deep, trees).strip() == "x"


def test_held_out_accuracy(trees):
    import random

    held = markup._grammar(random.Random(991), 1500)
    right = sum(bool(markup.kinds(text, trees)) == bool(label) for text, label in held)
    assert right / len(held) > 0.97


def test_structure_survives(trees):
    html = "<h2>Title</h2><ul><li>one</li><li>two</li></ul><pre><code>f(1 &lt; 2);</code></pre><table><tr><td>a</td><td>1</td></tr></table>"
    out = markup.plain(html, trees)
    assert "## Title" in out and "- one" in out and "f(1 < 2);" in out and "a\t1" in out and "<" not in out.replace("1 < 2", "")
    assert markup.plain("# H\n\n**b** and `c` $n^2 + b_3$", trees) == "# H\n\nb and `c` $n^2 + b_3$"
    assert markup.plain(None, trees) is None


def test_no_child_without_its_parent(trees):
    text = "<div><p>one <b>two</b></p></div>"
    kept = markup.decode(text, trees)
    starts = {id(n) for n in kept}
    assert all(n.parent is None or id(n.parent) in starts for n in kept if not (n.partner and n.partner.start < n.start))


def test_markup_tables(spark):
    df = spark.createDataFrame([("a", "**x** <b>y</b>"), ("a", "**x**"), ("b", None), ("c", "")], "item_id string, body string").selectExpr("*", "1 as markup_kind")
    assert {tuple(r) for r in markup.found(df).collect()} == {("a", "markdown"), ("a", "html")}
    assert markup.found(df.limit(0)).count() == 0
    assert markup.converted(df, "body").count() == 4
