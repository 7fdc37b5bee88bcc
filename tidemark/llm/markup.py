"""Problem 6: markup residue in text, and its conversion to plain text that keeps structure.

A text is parsed into a forest of nodes (HTML elements, comments and entities; Markdown, wiki and LaTeX
constructs); what stands inside a heading, list item, quotation, table, emphasis, link label, command or
environment is parsed as its children, code and formulas are not. The patterns that propose nodes are
loose: products, prices, hashtags, snake_case and template slots are proposed too. Boosted trees score
each node from its density, attribute tokens, depth, siblings and shape, and a bottom-up decoding picks
the set of nodes of highest joint score in which nothing is kept below a rejected element. The trees
are trained on the driver from a seeded grammar of constructs and lookalikes; no table is read for it.

Conversion edits the accepted nodes in place: headings become ``#`` lines, list items ``-`` or their
number, quotations ``>``, table cells are parted by tabs, code stands in ticks or fences and formulas as
they were; emphasis, links, tags and comments leave their text. Converting twice changes nothing more:
entities that would turn into markup stay as they are.

Null and blank bodies have no markup and come back as they are; texts are read whole.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.functions.arrow import map_batches, spread
from tidemark.llm.boost import Boosted, fit

#: HTML element names.
TAGS = set(
    "a abbr address article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figure "
    "font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript "
    "ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th "
    "thead time title tr tt u ul var video wbr".split()
)
VOID = set("br hr img input meta link col wbr".split())
#: LaTeX commands often met in prose.
COMMANDS = set(
    "alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi chi psi omega Delta Sigma Omega approx leq geq neq le ge cdot times div pm "
    "frac sqrt sum prod int lim infty partial nabla textbf textit emph underline texttt section subsection subsubsection paragraph begin end item "
    "cite ref label footnote left right mathbf mathrm mathbb mathcal text bf it em rm sin cos log ln exp to rightarrow quad ldots dots hat bar vec "
    "caption includegraphics usepackage documentclass title author maketitle href url subset in forall exists".split()
)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")

#: construct, syntax, pattern; earlier ones win where two begin at one place.
CONSTRUCTS = [
    ("fence", "markdown", r"^(?P<f>```+|~~~+)[^\n]*\n(?:.*?\n)??(?P=f)[ \t]*$|^(?:```+|~~~+)[a-z]*\n(?:[^\n]*\n?)+\Z"),
    ("wikiref", "wiki", r"<ref\b[^>/]*/>|<ref\b[^>]*>.*?</ref>|<nowiki>.*?</nowiki>"),
    ("comment", "html", r"<!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>"),
    ("preblock", "html", r"<pre\b[^>]*>.*?</pre>"),
    ("tag", "html", r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s+[a-zA-Z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?)*\s*/?>"),
    ("entity", "html", ENTITY.pattern),
    ("wikitable", "wiki", r"^\{\|.*?^\|\}|^\{\|[^\n]*$"),
    ("wikilink", "wiki", r"\[\[[^\[\]\n]+\]\]"),
    ("template", "wiki", r"(?<!\{)\{\{[^{}]*\}\}(?!\})"),
    ("extlink", "wiki", r"\[https?://[^\s\]]+ [^\]\n]+\]"),
    ("wikibold", "wiki", r"(?<!')'''''?(?!['\s])[^'\n]+?'''''?(?!')|(?<!')'''(?!['\s])[^\n]+?'''(?!')"),
    ("wikiital", "wiki", r"(?<!')''(?!['\s])[^'\n]+(?:'[^'\n]+)*''(?!')"),
    ("wikihead", "wiki", r"^(={2,6})[ \t]*[^=\n]+?[ \t]*={2,6}[ \t]*$"),
    ("environment", "latex", r"\\begin\{(?P<e>[a-zA-Z]+\*?)\}.*?\\end\{(?P=e)\}"),
    ("display", "latex", r"\$\$[^$]+\$\$|\\\[[^\]]*?\\\]|\\\((?!ツ)[^)\n]*?\\\)"),
    ("inline", "latex", r"(?<![\w$\\])\$(?![\s$])[^$\n]+(?<!\s)\$(?![\w$])"),
    ("group", "latex", r"\{\\[a-zA-Z]+\s[^{}\n]*\}"),
    ("command", "latex", r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("script", "latex", r"(?<=\w)[_^]\{[^{}\n]+\}(?:[_^]\{[^{}\n]+\})?"),
    ("setext", "markdown", r"^[^\n=#>|\-*+][^\n]*\n(?:={3,}|-{3,})[ \t]*$"),
    ("heading", "markdown", r"^[ ]{0,3}#{1,6}(?![{#])[ \t]*[^\s#][^\n]*$"),
    ("mdtable", "markdown", r"^\|?[^|\n]+\|[^\n]*\n[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*(?:\n[^\n]*\|[^\n]*)*"),
    ("rule", "markdown", r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,}|(?:- ){2,}-)[ \t]*$"),
    ("spoiler", "markdown", r">!.+?!<"),
    ("quote", "markdown", r"^[ ]{0,3}>(?!!)[ \t]?\S[^\n]*$"),
    ("bullet", "markdown", r"^[ \t]*[*+-][ \t]+\S[^\n]*$"),
    ("ordered", "markdown", r"^[ \t]*\d{1,3}[.)][ \t]+\S[^\n]*$"),
    ("indented", "markdown", r"(?:(?<=\n\n)|\A)(?:(?: {4}|\t)\S[^\n]*(?:\n(?: {4}|\t)[^\n]*)*)"),
    ("image", "markdown", r"!\[[^\]\n]*\]\([^)\s]+(?:\s+\"[^\"]*\")?\)"),
    ("link", "markdown", r"(?<!\!)\[[^\[\]\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)"),
    ("reflink", "markdown", r"\[[^\[\]\n]+\]\[[^\[\]\n]*\]|^\[[^\]\n]+\]:[ \t]*\S+[^\n]*$"),
    ("code", "markdown", r"(?<!`)`[^`\n]+`(?!`)"),
    ("strong", "markdown", r"(?<![*\w\\])\*{2,3}(?![\s*])[^*\n]+?(?<![\s*])\*{2,3}(?![*\w])|(?<![_\w\\])__(?![\s_])[^_\n]+(?<![\s_])__(?![_\w])"),
    ("emphasis", "markdown", r"(?<![*\\])\*(?!\*)[^*\n]+\*(?!\*)|(?<![_\\])_(?![\s_])[^_\n]+(?<!\s)_(?!_)"),
    ("strike", "markdown", r"(?<!~)~~(?![\s~])[^~\n]+(?<![\s~])~~(?!~)"),
    ("superscript", "markdown", r"\^\([^()\n]+\)|(?<=[a-zA-Z])\^[a-zA-Z]+\b"),
]
_NAMES = [c for c, _, _ in CONSTRUCTS]
_SYNTAX = dict((c, s) for c, s, _ in CONSTRUCTS)
SYNTAXES = ("markdown", "html", "wiki", "latex")
#: A construct can only occur in a text that holds one of its triggers.
TRIGGERS = {
    "fence": ("```", "~~~"), "comment": ("<!",), "preblock": ("<pre",), "tag": ("<",), "entity": ("&",), "wikitable": ("{|",), "wikilink": ("[[",), "template": ("{{",),
    "wikiref": ("<ref", "<nowiki"), "extlink": ("[http",), "wikibold": ("'''",), "wikiital": ("''",), "wikihead": ("==",), "environment": ("\\begin",), "display": ("$$", "\\[", "\\("),
    "inline": ("$",), "group": ("{\\",), "command": ("\\",), "script": ("_{", "^{"), "setext": ("\n---", "\n==="), "heading": ("#",), "mdtable": ("-|", "|-", "- |", "| -"),
    "rule": ("---", "***", "___", "- - -"), "spoiler": (">!",), "quote": (">",), "bullet": ("* ", "- ", "+ "), "ordered": (". ", ") "), "indented": ("    ", "\t"), "image": ("![",),
    "link": ("](",), "reflink": ("][", "]:"), "code": ("`",), "strong": ("**", "__"), "emphasis": ("*", "_"), "strike": ("~~",), "superscript": ("^",),
}
#: Triggers too common to help: such a construct is looked for only where a line begins with it.
LINE_START = {"ordered": re.compile(r"^[ \t]*\d{1,3}[.)][ \t]", re.M), "bullet": re.compile(r"^[ \t]*[*+-][ \t]", re.M), "quote": re.compile(r"^ {0,3}>", re.M), "heading": re.compile(r"^ {0,3}#", re.M)}


@lru_cache(maxsize=4096)
def _scanner(wanted: tuple[int, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?P<{CONSTRUCTS[i][0]}>{CONSTRUCTS[i][2]})" for i in wanted), re.M | re.S)


def _possible(text: str) -> tuple[int, ...]:
    return tuple(
        i for i, c in enumerate(_NAMES) if any(t in text for t in TRIGGERS[c]) and (c not in LINE_START or LINE_START[c].search(text))
    )


CODE = {"fence", "preblock", "indented", "code"}
LINE = {"heading", "quote", "bullet", "ordered", "rule", "setext", "mdtable", "indented", "fence", "wikihead", "wikitable"}
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_ATTR = re.compile(r"\s[a-zA-Z_:][\w:.-]*\s*=")
_SLOT = re.compile(r"<<|<%|\{\{\{|\*\||\|\*|\$\{|%\(|@@|XX_|%[A-Z]+%|\$[A-Z][A-Z_]+\$|\{\{ ?[a-z_.]+ ?\}\}")
#: Templates that stand without parameters.
_WIKI_NAMES = re.compile(r"\{\{ ?(?:Reflist|Citation needed|Main|See also|Stub|Cn|Clear|Notelist|Cite|cite|Infobox|TOC)\b")

PREFILTER = (
    r"(?m)<[a-zA-Z/!]|&[#a-zA-Z]\w*;|\[\[|\{\{|\{\||''|^==|\\[a-zA-Z(\[]|\$|[_^]\{|\{\\|`|~~|\*\S|__|_[^_\n]+_(?:\W|$)|\]\(|\]\[|^\[[^\]]+\]:|"
    r"^\s{0,3}#|^\s{0,3}>|>!|^\s*[*+-]\s|^\s*\d{1,3}[.)]\s|^(?: {4}|\t)|\^|^\s*(?:---|===|\*\*\*|___)|\|[^\n]*\||\[https?://|!\["
)


#: What opens a quotation or list item, all levels of it at once.
LEAD = re.compile(r"(?:[ \t]*(?:>(?!!)|[*+-](?=[ \t])|\d{1,3}[.)](?=[ \t]))[ \t]*)+")
FREE = {"quote", "bullet", "ordered"}
LISTS = {"itemize", "enumerate", "description"}
STYLED = set("textbf textit emph underline text title caption textsc textrm footnote section subsection subsubsection paragraph href".split())


class Node:
    __slots__ = ("construct", "start", "end", "name", "depth", "parent", "children", "partner", "inner", "score")

    def __init__(self, construct, start, end, name=""):
        self.construct, self.start, self.end, self.name = construct, start, end, name
        self.depth, self.parent, self.children, self.partner, self.inner, self.score = 0, None, [], None, None, 0.0


def _inner(construct: str, raw: str, name: str) -> tuple[int, int] | None:
    """The part of a construct that holds more text, or None."""
    n = len(raw)
    if construct in FREE:
        return LEAD.match(raw).end(), n
    if construct == "heading":
        return re.match(r" {0,3}#+[ \t]*", raw).end(), n
    if construct == "setext":
        return 0, raw.index("\n")
    if construct in ("strong", "emphasis"):
        k = 3 if raw[:3] in ("***", "___") else 2 if construct == "strong" else 1
        return k, n - k
    if construct in ("strike", "spoiler"):
        return 2, n - 2
    if construct in ("wikibold", "wikiital"):
        k = n - len(raw.lstrip("'"))
        return k, n - k
    if construct == "wikihead":
        k = n - len(raw.lstrip("="))
        return k, len(raw.rstrip("= \t"))
    if construct in ("link", "reflink"):
        return (1, raw.index("]")) if not re.match(r"\[[^\]]*\]:", raw) else None
    if construct == "mdtable":
        return 0, n
    if construct == "wikitable" and "\n" in raw:
        return raw.index("\n"), n
    if construct == "wikiref" and raw.startswith("<ref") and not raw.endswith("/>"):
        return raw.index(">") + 1, n - len("</ref>")
    if construct == "environment" and name in LISTS | {"quote", "center", "document", "abstract", "quotation"}:
        return raw.index("}") + 1, raw.rindex("\\end")
    if construct == "group":
        return re.match(r"\{\\[a-zA-Z]+\s", raw).end(), n - 1
    if construct == "command" and name in STYLED and "{" in raw:
        return raw.index("{") + 1, n - 1
    return None


def parse(text: str) -> list[Node]:
    """The nodes, parents before their children; HTML end tags share the node of their start tag as ``partner``."""
    nodes: list[Node] = []
    wanted = _possible(text)
    if not wanted:
        return nodes
    within = tuple(i for i in wanted if _NAMES[i] not in LINE)
    holding: list[Node] = []  # open elements and the constructs being looked into, innermost last
    work = [(_scanner(wanted).finditer(text), 0, 0)]
    while work:
        found, base, level = work[-1]
        m = next(found, None)
        if m is None:
            work.pop()
            del holding[level:]
            continue
        construct = m.lastgroup if m.lastgroup in _SYNTAX else next(c for c, v in m.groupdict().items() if v is not None and c in _SYNTAX)
        raw = m[0]
        node = Node(construct, base + m.start(), base + m.end())
        if construct == "tag":
            node.name = _TAG.match(raw)[1].lower()
            if raw[1] == "/":
                for i in range(len(holding) - 1, -1, -1):
                    if holding[i].construct != "tag":
                        break
                    if holding[i].name == node.name:
                        node.partner, holding[i].partner = holding[i], node
                        del holding[i:]
                        break
        elif construct == "command":
            node.name = re.match(r"\\([a-zA-Z]+)", raw)[1]
        elif construct == "environment":
            node.name = m["e"].rstrip("*")
        node.depth = len(holding)
        if holding:
            node.parent = holding[-1]
            holding[-1].children.append(node)
        nodes.append(node)
        if construct == "tag":
            if raw[1] != "/" and not raw.endswith("/>") and node.name not in VOID:
                holding.append(node)
            continue
        inside = _inner(construct, raw, node.name)
        if inside and inside[0] < inside[1]:
            node.inner = (node.start + inside[0], node.start + inside[1])
            here = wanted if construct in FREE else within
            if here:
                work.append((_scanner(here).finditer(text[node.inner[0] : node.inner[1]]), node.inner[0], len(holding)))
                holding.append(node)
    return nodes


def features(text: str, nodes: list[Node]) -> list[tuple]:
    """One tuple per node; see ``FEATURES``."""
    same: dict[str, int] = {}
    for n in nodes:
        same[n.construct] = same.get(n.construct, 0) + 1
    covered = sum(n.end - n.start for n in nodes if n.parent is None)
    out = []
    for n in nodes:
        raw = text[n.start : n.end]
        inner = re.sub(r"^[\W_]+|[\W_]+$", "", raw)
        letters = sum(c.isalpha() for c in raw)
        digits = sum(c.isdigit() for c in raw)
        before = text[n.start - 1] if n.start else "\n"
        after = text[n.end] if n.end < len(text) else "\n"
        span = (n.partner.end - n.start) if n.partner and n.partner.start > n.start else n.end - n.start
        known = n.name in TAGS if n.construct == "tag" else n.name in COMMANDS if n.construct == "command" else html.unescape(raw) != raw if n.construct == "entity" else True
        syntax = _SYNTAX[n.construct]
        out.append(
            (
                _NAMES.index(n.construct),
                SYNTAXES.index(syntax),
                float(n.construct in LINE),
                float(known),
                float(len(_ATTR.findall(raw))),
                float(n.depth),
                float(len(n.children)),
                float(same[n.construct]),
                float(n.partner is not None or n.name in VOID),
                math.log1p(len(raw)),
                (n.end - n.start) / max(1, span),
                letters / max(1, len(raw)),
                digits / max(1, len(raw)),
                float(before.isalnum()),
                float(after.isalnum()),
                float(inner == ""),
                float(bool(_SLOT.search(text[max(0, n.start - 2) : n.end + 2]))),
                covered / max(1, len(text)),
                float(raw[:1] == "\\" and ("{" in raw)),
                float(any(ord(c) > 0x2FFF for c in text[n.start : n.end + 3])),
                float(raw[1:2].isspace() or raw[-2:-1].isspace()),
                float(sum(c in "\\^_={}+" for c in raw)),
                float(raw.strip("{}[]$#* \t")[:1].isupper()),
                float("|" in raw),
                float(n.construct == "heading" and raw.lstrip()[:1] == "#" and raw.lstrip().lstrip("#")[:1].isspace()),
                float(inner[:1].isdigit()),
                float(len(raw.lstrip()) - len(raw.lstrip().lstrip("#"))),
                float(bool(_WIKI_NAMES.match(raw))),
            )
        )
    return out


FEATURES = (
    "construct syntax line known attributes depth children same_construct closed log_length own_density letters digits "
    "word_before word_after empty slot_near text_density braces wide_letter spaced math upper pipe gap digit_first level wiki_name"
).split()


def _grammar(rng: random.Random, n: int) -> list[tuple[str, int]]:
    """Seeded snippets: constructs (1) and their lookalikes (0) in invented words."""
    syl = "ba ke li mo nu ra se ti vo za dre plo gri sta".split()
    w = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
    ws = lambda k=0: " ".join(w() for _ in range(k or rng.randint(1, 6)))
    d = lambda: str(rng.randint(1, 99))
    tag = lambda: rng.choice("b i em strong p div span li td h1 h3 ul code u".split())
    cmd = lambda: rng.choice(sorted(COMMANDS))

    def element(level=0):
        t = tag()
        attr = f' {rng.choice(["class", "id", "style", "href"])}="{w()}"' if rng.random() < 0.4 else ""
        inner = element(level + 1) if level < 3 and rng.random() < 0.4 else ws()
        return f"<{t}{attr}>{inner}</{t}>"

    yes = [
        lambda: f"**{ws(2)}**", lambda: f"*{ws(1)}*", lambda: f"_{ws(2)}_", lambda: f"__{w()}__", lambda: f"***{w()}***", lambda: f"~~{w()}~~",
        lambda: f"`{w()} --{w()}={d()}`", lambda: f"[{ws(3)}](https://{w()}.example/t/{d()})", lambda: f"![{w()}](/{w()}.png)", lambda: f"^({ws(2)})",
        lambda: f">!{ws()}!<", lambda: f"\n> {ws()}\n", lambda: f"\n- {ws(2)}\n- {ws(2)}\n", lambda: f"\n* {ws(2)}\n* {w()}\n", lambda: f"\n+ {w()}, {w()}\n+ {w()}\n",
        lambda: f"\n1. {ws(2)}\n2. {ws(2)}\n", lambda: f"\n{'#' * rng.randint(1, 4)}{rng.choice(['', ' '])}{ws(2)}\n", lambda: f"\n{ws(2)}\n=====\n", lambda: "\n---\n",
        lambda: f"\n```\n{w()} = {w()}({d()})\n```\n", lambda: f"\n~~~\n{w()}: \"{{{{ {w()}.{w()} }}}}\"\n~~~\n", lambda: f"\n\n    {w()} = {w()}({d()})\n    {w()}()\n\n",
        lambda: f"\n| {w()} | {w()} |\n|---|---|\n| {w()} | {d()} |\n", element, element, lambda: f"<br>{ws()}", lambda: f"<br/>{ws()}", lambda: f'<img src="/{w()}.png" alt="{w()}">',
        lambda: f"<!-- {ws(2)} -->", lambda: f"<pre><code>{w()}({d()});</code></pre>", lambda: rng.choice("&amp; &lt; &gt; &nbsp; &quot; &#39; &#x2019; &hellip;".split()),
        lambda: f"<table><tr><td>{w()}</td><td>{d()}</td></tr></table>", lambda: f"<ul><li>{w()}</li><li>{w()}</li></ul>", lambda: f"<!DOCTYPE html><title>{d()} {w()}</title>",
        lambda: f"'''{ws(2)}'''", lambda: f"''{ws(3)}''", lambda: f"[[{ws(2)}]]", lambda: f"[[{w()}|{w()}]]", lambda: f"[[Category:{w()}]]", lambda: f"{{{{Infobox {w()}\n|name={w()}\n|count={d()}\n}}}}",
        lambda: f"{{{{cite web|title={w()}|year=20{d()}}}}}", lambda: f"\n== {ws(2)} ==\n", lambda: f"\n{{| class=\"wikitable\"\n! {w()}\n|-\n| {w()}\n|}}\n", lambda: f"[https://{w()}.example/{d()} {ws(2)}]",
        lambda: f"\\{rng.choice(['textbf', 'emph', 'section', 'cite', 'textit'])}{{{ws(2)}}}", lambda: f"\\{cmd()} \\approx {d()}.{d()}", lambda: f"$$\\frac{{{w()[0]}}}{{{d()}}}$$", lambda: f"${w()[0]}^{d()[0]} + {w()[0]}_{d()[0]}$",
        lambda: f"\\(\\sqrt{{{w()[0]}}} \\leq {w()[0]}\\)", lambda: f"\\begin{{itemize}} \\item {w()} \\item {w()} \\end{{itemize}}", lambda: f"\\begin{{equation}} x = {d()}r \\end{{equation}}",
        lambda: f"\n- {w()} **{w()}** {w()}\n- <b>{w()}</b>\n", lambda: f"\n> {ws(2)} *{w()}* and <i>{w()}</i>\n", lambda: f"\n## The **{w()}** and [{w()}](https://{w()}.example/{d()})\n", lambda: f"\n1. see \\textbf{{{w()}}}\n2. {w()} `{w()}`\n",
        lambda: f"{{{{{rng.choice(['Reflist', 'Citation needed', 'Stub', 'See also', 'Main'])}}}}}", lambda: f"<ref name={w()}>{ws(2)}</ref>", lambda: f"\n##{w()}\n{ws()}.\n", lambda: f"\n###{w()}\n{ws()}.\n", lambda: f"<nowiki>{w()}</nowiki>", lambda: f"${w()[0]}$ and ${w()[0]}$", lambda: f"$\\{rng.choice(['alpha', 'pi', 'sigma', 'mu'])}$", lambda: f"${w()[0]} = {d()}$",
        lambda: f"*{ws(2)}, {ws(2)}*", lambda: f"({w()} *{w()}*)", lambda: f"_{w()}_, {w()}", lambda: f"*{d()} {w()}*", lambda: f"${w()[0]}_{{{d()[0]}}} < {d()}$",
        lambda: f"{{\\it {ws(2)}}}", lambda: f"{w()[0]}_{{i}}^{{{d()[0]}}} \\cdot {w()[0]}",
    ]
    no = [
        lambda: f"{d()} * {d()} * {d()}", lambda: f"{d()}*{d()}*{d()}", lambda: f"{w()[0]} < {w()[0]} and {w()[0]} > {w()[0]}", lambda: f"<{d()} to {w()}", lambda: f"${d()} and ${d()} {ws(2)}",
        lambda: f"{w()}_{w()}_{w()}", lambda: f"{d()}_000_000", lambda: "¯\\(ツ)/¯", lambda: f"<<{w()}>>", lambda: f"<% {w()} %>", lambda: f"*|{w().upper()}|*", lambda: f"{{{{{w()}}}}}", lambda: f"${{{w()}}}",
        lambda: f"#{d()} {w()}", lambda: f"{w()} & {w()}; {w()}", lambda: f"https://{w()}.example/{w()}_{w()}", lambda: f"<{w()}@{w()}.example>", lambda: f"C:\\{w()}qx\\{w()}qx", lambda: f"{w()} ^^ {w()}", lambda: "o_O -_-",
        lambda: f"&{w()}q;", lambda: f"<{w()}q>", lambda: f"<{w()}_{w()}>", lambda: f"{{{{{{{w()}}}}}}}", lambda: f"%({w()})s", lambda: f"{d()} - {d()} = {d()}", lambda: f"${w().upper()}$", lambda: f"XX_{w().upper()}_XX",
        lambda: f"{w()} * {w()} * {w()}", lambda: f"{w()}*{w()}*{w()}", lambda: f"{d()} *{d()} * {d()}", lambda: f"{w()}_{w()}_{w()} and {w()}_{w()}", lambda: f"__{w()}_{w()}" , lambda: f"${d()} or {d()}$", lambda: f"${d()} {w()} for {d()}$ {w()}", lambda: f"${w().upper()}_{w().upper()}$",
        lambda: f"\n#{w()}\n", lambda: f"\n#{d()} {ws(3)}\n", lambda: f"{{{{ {w()}.{w()} }}}}", lambda: f"{{{{{w()}_{w()}}}}}", lambda: f"{d()}*{w()} + {d()}*{w()}", lambda: f"{w()[0]} * ({w()[0]} + {d()}) * {d()}", lambda: f"{w()}* {w()} *{w()}",
        lambda: f"<{w()}q {w()}> and <{w()}q>", lambda: f"({w()}) [{w()}] {{{w()}}}", lambda: f"don''t {w()}", lambda: f"{d()}% of ${d()}.{d()}",
    ]
    out = []
    for _ in range(n):
        label = int(rng.random() < 0.6)
        snippet = rng.choice(yes if label else no)()
        if snippet.startswith("\n"):
            text = f"{ws()}.\n{snippet}\n{ws()}."
        else:
            text = rng.choice([f"{snippet} {ws()}.", f"{ws()} {snippet} {ws()}", f"{ws()} {snippet}"])
        out.append((text, label))
    return out


@lru_cache(maxsize=1)
def model(samples: int = 9000, seed: int = 7) -> Boosted:
    """Trees fitted to ``samples`` seeded snippets, the documented bound of the training set."""
    x, y = [], []
    for text, label in _grammar(random.Random(seed), samples):
        nodes = parse(text)
        x += features(text, nodes)
        y += [label] * len(nodes)
    return fit(np.array(x, float), np.array(y, float), rounds=32)


def decode(text: str, trees: Boosted) -> list[Node]:
    """The accepted nodes: best joint score without a child kept below a rejected element."""
    nodes = parse(text)
    if not nodes:
        return []
    for n, x in zip(nodes, features(text, nodes)):
        n.score = trees.predict(x)
    for n in nodes:  # start and end tag are one choice
        if n.partner is not None and n.partner.start > n.start:
            n.score += n.partner.score
            n.partner.score = 0.0
    owner = {}
    for n in nodes:  # only an element rules over what is in it
        p = n.parent
        while p is not None and p.construct != "tag":
            p = p.parent
        owner[id(n)] = p
    gain = {id(n): n.score for n in nodes}
    for n in reversed(nodes):  # children come after their parent
        p = owner[id(n)]
        if p is not None and not (n.partner and n.partner.start < n.start):
            gain[id(p)] += max(0.0, gain[id(n)])
    kept, taken = [], set()
    for n in nodes:
        if n.partner is not None and n.partner.start < n.start:
            ok = id(n.partner) in taken
        else:
            p = owner[id(n)]
            ok = gain[id(n)] > 0 and (p is None or id(p) in taken)
        if ok:
            kept.append(n)
            taken.add(id(n))
    return kept


def kinds(text: str, trees: Boosted) -> set[str]:
    return {_SYNTAX[n.construct] for n in decode(text, trees)}


BREAKS = set("br p div tr table ul ol title body html head center section article header footer dl dd dt".split())


def _fence(code: str) -> str:
    marks = "```"
    while marks in code:
        marks += "`"
    return f"\n{marks}\n{code.strip(chr(10))}\n{marks}\n"


def _cells(text: str, n: Node, marks: str) -> list[tuple[int, int, str]]:
    """Edits of the bars of a table outside its children: cells parted by tabs."""
    taken = [(c.start, c.end) for c in n.children]
    free = lambda i: all(i < a or i >= b for a, b in taken)
    out, at = [], n.start
    for line in text[n.start : n.end].split("\n"):
        end = at + len(line)
        if marks == "|" and re.fullmatch(r"[\s|:\-]+", line):
            out.append((at, min(n.end, end + 1), ""))
        else:
            bars = [m.span() for m in re.finditer(r"[ \t]*\|[ \t]*", line) if free(at + m.start() + m[0].index("|"))]
            for a, b in bars:
                edge = not line[:a].strip() or not line[b:].strip()
                out.append((at + a, at + b, "" if edge else "\t"))
        at = end + 1
    return out


def _wiki_cells(text: str, n: Node) -> list[tuple[int, int, str]]:
    """Edits of a wiki table: a line per row, cells parted by tabs."""
    out, at, fresh = [], n.start, True
    for line in text[n.start : n.end].split("\n"):
        end = at + len(line)
        if line.startswith(("{|", "|-", "|}", "|+")):
            out.append((at, min(n.end, end + 1), ""))
            fresh = True
        elif line.startswith(("|", "!")):
            out.append((at if fresh else at - 1, at + 1 + len(line[1:]) - len(line[1:].lstrip()), "" if fresh else "\t"))
            out += [(at + m.start(), at + m.end(), "\t") for m in re.finditer(r"[ \t]*(?:\|\||!!)[ \t]*", line)]
            fresh = False
        at = end + 1
    return out


def _edits(text: str, n: Node, decoded: bool) -> list[tuple[int, int, str]]:
    """What becomes of an accepted node: replacements of spans of the text, its children left alone."""
    c, raw, a, b = n.construct, text[n.start : n.end], n.start, n.end
    whole = lambda new: [(a, b, new)]
    around = lambda before, after: [(a, n.inner[0], before), (n.inner[1], b, after)] if n.inner else []
    if c == "tag":
        ending = raw[1] == "/"
        if n.name in ("script", "style"):
            return [(a, n.partner.end, "")] if not ending and n.partner else whole("")
        if n.name == "blockquote":
            return whole("\n" if ending else "\n> ")
        if n.name in BREAKS:
            return whole("\n")
        if n.name == "li":
            return whole("" if ending else "\n- ")
        if re.fullmatch(r"h[1-6]", n.name):
            return whole("\n" if ending else "\n" + "#" * int(n.name[1]) + " ")
        if n.name in ("td", "th"):
            return whole("\t" if ending else "")
        if n.name in ("code", "kbd", "samp", "tt"):
            return whole("`" if n.partner else "")
        if n.name == "hr":
            return whole("\n---\n")
        if n.name == "img":
            alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", raw)
            return whole(alt[1] if alt else "")
        return whole("")
    if c == "entity":
        new = html.unescape(raw).replace("\u00a0", " ")
        return whole(new if decoded or not re.search(r"[<>&*_`$#~^|\\\[\]{}'=]", new) else raw)
    if c == "comment":
        return whole("")
    if c == "preblock":
        return whole(_fence(html.unescape(re.sub(r"<[^>]+>", "", raw))))
    if c == "wikilink":
        body = raw[2:-2]
        return whole("" if body.startswith(("Category:", "File:", "Image:")) else body.rpartition("|")[2])
    if c == "template":
        fields = re.findall(r"\|\s*([\w ]+?)\s*=\s*([^|{}\n]*)", raw)
        return whole("; ".join(f"{k}: {v.strip()}" for k, v in fields))
    if c == "wikiref":
        return around("(" if text[max(0, a - 1)] == " " else " (", ")") if n.inner else whole(re.sub(r"</?nowiki>|<ref[^>]*/?>|</ref>", "", raw))
    if c == "extlink":
        return whole(raw[1:-1].partition(" ")[2])
    if c in ("wikibold", "wikiital", "strong", "emphasis", "strike", "spoiler", "group", "link", "reflink"):
        return around("", "") or whole("")
    if c == "wikihead":
        return around("#" * (n.inner[0] - a) + (" " if text[n.inner[0]] not in " \t" else ""), "")
    if c == "heading":
        return [(a, n.inner[0], raw[: n.inner[0] - a].strip() + " ")]
    if c == "setext":
        return [(a, a, "# " if raw.rstrip()[-1] == "=" else "## "), (n.inner[1], b, "")]
    if c in ("bullet", "quote", "ordered"):
        return [(a, n.inner[0], re.sub(r"[*+-](?=[ \t])", "-", raw[: n.inner[0] - a]))] if n.inner else []
    if c == "mdtable":
        return _cells(text, n, "|")
    if c == "wikitable":
        return _wiki_cells(text, n)
    if c == "environment":
        if n.inner:
            return around("\n", "\n")
        body = re.sub(r"^\\begin\{[^}]*\}(?:\[[^\]]*\])?|\\end\{[^}]*\}$", "", raw)
        return whole(_fence(body)) if n.name in ("verbatim", "lstlisting", "minted") else whole("$$" + " ".join(body.split()) + "$$") if "$" not in body and body.strip() else []
    if c == "command":
        if n.name == "item":
            label = re.search(r"\[([^\]]*)\]", raw)
            return whole("\n-" + (f" {label[1]}" if label else "") + ("" if text[b : b + 1] == " " else " "))
        if n.name in ("section", "subsection", "subsubsection"):
            return around("\n" + "#" * (1 + n.name.count("sub")) + " ", "\n")
        if n.name == "texttt":
            return whole("`" + "".join(re.findall(r"\{([^{}]*)\}", raw)) + "`")
        if n.name == "href":
            return whole((re.findall(r"\{([^{}]*)\}", raw) or [""])[-1])
        if n.name in STYLED:
            return around("", "")
        if n.name in ("cite", "ref", "label"):
            return whole("[" + ", ".join(re.findall(r"\{([^{}]*)\}", raw)) + "]")
        return []
    if c == "image":
        return whole(re.match(r"!\[([^\]]*)", raw)[1])
    if c == "superscript" and raw[1] == "(":
        return whole(raw[1:])
    return []


def _converted(text: str, trees: Boosted, decoded: bool) -> str:
    out, last = [], 0
    for a, b, new in sorted((e for n in decode(text, trees) for e in _edits(text, n, decoded)), key=lambda e: (e[0], -e[1])):
        if a >= last:
            out += [text[last:a], new]
            last = b
    clean = "".join(out) + text[last:]
    return re.sub(r"\n{3,}", "\n\n", clean).strip("\n") if clean != text else text


def plain(text: str | None, trees: Boosted) -> str | None:
    """Clean text; see the module. A text that would still hold convertible markup is converted on,
    with those entities left alone that stand for characters of markup."""
    if not text or not text.strip():
        return text
    once = _converted(text, trees, True)
    if once == text or _converted(once, trees, True) == once:
        return once
    now, then = text, _converted(text, trees, False)
    while then != now:
        shorter = len(then) < len(now)
        now = then
        then = _converted(now, trees, False) if shorter else now
    return now


def candidates(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.match_substring_regex(texts, PREFILTER), False)


def found(items: DataFrame) -> DataFrame:
    """One row per item and kind of markup in any of its bodies: ``item_id``, ``markup_kind``."""
    trees = model()

    def run(batch: pa.RecordBatch):
        hits = batch.filter(candidates(batch.column(1)))
        for item, body in zip(hits.column(0).to_pylist(), hits.column(1).to_pylist()):
            for kind in sorted(kinds(body, trees)):
                yield item, kind

    rows = map_batches(spread(items.select("item_id", "body")), run, "item_id string, markup_kind string", ["item_id", "markup_kind"])
    return rows.distinct()


def converted(df: DataFrame, text: str) -> DataFrame:
    """``df`` with column ``text`` converted to plain text; all rows and columns stay."""
    trees, names = model(), df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = names.index(text)

    def run(batch: pa.RecordBatch):
        column = batch.column(at)
        mask = candidates(column).to_pylist()
        new = [plain(v.as_py(), trees) if m else v.as_py() for v, m in zip(column, mask)]
        return pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return map_batches(spread(df), run, schema, names)
