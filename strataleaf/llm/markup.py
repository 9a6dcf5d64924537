"""Markup residue in text: which kinds a text holds, and the text without it but with its structure.

A text becomes a tree: the page, its lines and source trailers, and in them the signs that may be markup; what stands
inside an HTML element hangs below the element, as in a DOM. Each node is in one of ``STATES``: the kind of markup that it
is, plain, or part of a citation. Potentials tie a node's state to its look, and to its parent's state by what the parent is (page, line or
sign). Messages are passed up and down the tree (sum-product) and give each sign's marginal: whether a quote, dash or bar
is markup is said by the line or trailer around it, and which kind a star is by the page; a sign is markup of the kind whose marginal is greatest. The potentials are counted on labelled
pages, which :func:`labelled_pages` writes, their number a parameter.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds of markup, plain text, and citations: what stands in a source trailer, where the same signs are plain.
STATES = ("plain", "html", "markdown", "wiki", "latex", "cited")
MARKUP = range(1, 5)
#: Labelled pages that the potentials are counted on; what is added to each count of parent and child, and of looks:
#: a sign that no labelled page has in a state is hardly ever in it, whatever stands around.
PAGES, SMOOTHING, UNSEEN = 1500, 0.05, 1e-7

# The names of HTML elements.
ELEMENTS = frozenset(
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col"
    " colgroup dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2"
    " h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu meta nav nobr noscript"
    " object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section select small source span"
    " strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr p li td tr th".split())
HIDDEN = frozenset("head style script title strike s del".split())
# LaTeX commands that stand without an argument.
BARE = frozenset(
    "item frac sum times cdot alpha beta gamma delta lambda mu pi sigma theta le ge leq geq neq ldots dots quad qquad par noindent"
    " newline linebreak hline centering maketitle tableofcontents bf it em tt rm int prod sqrt left right infty partial to in".split()
)

# Every alternative begins with a character of _START, which is sought first: it is rare, and much cheaper to look for.
_START = re.compile(r"[<&\\$~*_`\[{]|'(?=')|!(?=\[)|\n(?=[ \t#=*|{!>+\-])")
_SIGN = re.compile(
    r"""(?P<comment><!--.*?(?:-->|\Z)|<![Dd][Oo][Cc][Tt][Yy][Pp][Ee][^>]*>)"""
    r"""|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?=[\s/>])(?:\s[^<>]*)?/?>)"""
    r"""|(?P<opentag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?\Z)"""
    r"""|(?P<entity>&(?:[A-Za-z][A-Za-z0-9]{1,31}|\#[0-9]{1,7}|\#[xX][0-9a-fA-F]{1,6});)"""
    r"""|(?P<begin>\\(?:begin|end)\s?\{[A-Za-z*]+\})"""
    r"""|(?P<math>\\\[(?:[^\\]|\\(?![\[\]]))*+\\\]|\\\((?:[^\\]|\\(?![()]))*+\\\)|\$\$[^$]+\$\$)"""
    r"""|(?P<command>\\[A-Za-z]+\*?(?=\s?[\[{]))"""
    r"""|(?P<bare>\\[A-Za-z]+)"""
    r"""|(?P<dollars>\$(?=[^\s$])[^$\n]*+(?:\n(?!\s*\n)[^$\n]*+)?\$)"""
    r"""|(?P<tie>~(?=\\[A-Za-z]))"""
    r"""|(?P<bold>\*\*(?=[^\s*])[^*]++\*\*|__(?=[^\s_])[^_\n]+(?<!\s)__(?![\w_]))"""
    r"""|(?P<emphasis>\*(?<![\w*]\*)(?=[^\s*])[^*\n]++(?<!\s)\*(?![\w*])|_(?<![\w_]_)(?=[^\s_])[^_\n]++(?<!\s)_(?![\w_]))"""
    r"""|(?P<struck>~~(?=\S)[^~\n]++~~)"""
    r"""|(?P<fence>```[A-Za-z]*)"""
    r"""|(?P<code>`(?=[^`\s])[^`\n]*+(?:\n(?!\s*\n)[^`\n]*+)?`)"""
    r"""|(?P<quotes>'''(?=[^\s'])[^']++'''|''(?=[^\s'])[^']++''(?!'))"""
    r"""|(?P<wikilink>\[\[[^\[\]]++\]\])"""
    r"""|(?P<mdlink>\[[^\[\]]++\]\((?:[^()\s]|\s(?=["']))[^()]*+\)|!\[[^\[\]]*+\]\([^()]++\))"""
    r"""|(?P<extlink>\[(?:https?|ftp)://[^\[\]]++\])"""
    r"""|(?P<template>\{\{(?=[^{}]))"""
    r"""|(?P<magic>__(?:NO)?TOC__)"""
    r"""|(?P<wikitable>\n[ \t]*(?:\{\|[^\n]*|\|\}|\|-+[^\n|]*(?=\n|\Z)|![^\n!]+!![^\n]*|\|[^\n|]*\|\|[^\n]*))"""
    r"""|(?P<wikihead>\n(?P<eq>={2,6})[ \t]*(?=[^\s=])[^\n]*?[^\s=][ \t]*(?P=eq)[ \t]*(?=\n|\Z))"""
    r"""|(?P<hash>\n\#{1,6}[ \t]+(?=\S)[^\n]*)"""
    r"""|(?P<rule>\n[ \t]*(?:={3,}|-{3,}|\*{3,})[ \t]*(?=\n|\Z))"""
    r"""|(?P<mdtable>\n[ \t]*\|[^\n]*\|[ \t]*(?=\n|\Z))"""
    r"""|(?P<dash>\n[ \t]*[-+][ \t]+(?=\S))"""
    r"""|(?P<star>\n\*{1,3}[ \t]+(?=[^\s*]))"""
    r"""|(?P<quote>\n[ \t]*>[ \t]?(?=\S))""",
    re.S | re.X,
)


_BRACES = re.compile(r"\{\{|\}\}")


def template_ends(text: str) -> dict[int, int]:
    """Where each template that is closed ends, by where it begins, whatever stands in it."""
    ends, opened = {}, []
    for m in _BRACES.finditer(text):
        if m.group() == "{{":
            opened.append(m.start())
        elif opened:
            ends[opened.pop()] = m.end()
    return ends


def signs_in(text: str) -> Iterator[tuple[str, int, int]]:
    """``(kind, start, end)`` of all signs in ``text``, the first alternative at each place, without overlap."""
    at, templates = 0, None
    for found in _START.finditer(text):
        start = found.start()
        if start >= at and (m := _SIGN.match(text, start)):
            kind, end = m.lastgroup if m.lastgroup != "eq" else "wikihead", m.end()
            if kind == "template":
                templates = template_ends(text) if templates is None else templates
                if (end := templates.get(start, 0)) <= start + 4:
                    continue
            at = end
            yield kind, start, end


_TRAILER = re.compile(r"\(Source:")
_BRACKET = re.compile(r"[()]|\n[ \t]*\n")


def trailers(text: str) -> tuple[list[int], list[int]]:
    """Where source trailers begin and end: with their bracket, or, left open, with their paragraph or where the next begins."""
    begins, ends = [m.start() for m in _TRAILER.finditer(text)], []
    for start, following in zip(begins, [*begins[1:], len(text)]):
        depth, end = 0, following
        for m in _BRACKET.finditer(text, start, following):
            depth += {"(": 1, ")": -1}.get(m.group(), 0)
            if depth <= 0 or m.group()[0] == "\n":
                end = m.end()
                break
        ends.append(end)
    return begins, ends


_TEX = re.compile(r"\\[A-Za-z]|[_^]\{|[_^=]")


def _look(kind: str, text: str) -> str:
    if kind in ("tag", "opentag"):
        name = re.match(r"</?([A-Za-z0-9]+)", text).group(1).lower()
        return kind if name in ELEMENTS else kind + "?"
    if kind == "entity":
        return kind if html.unescape(text) != text else kind + "?"
    if kind == "bare":
        return kind if text[1:] in BARE else kind + "?"
    if kind == "dollars":
        return kind if _TEX.search(text) and not re.match(r"\$[0-9][0-9.,]*\s", text) else kind + "?"
    return kind


@lru_cache(1)
def looks() -> dict[str, int]:
    """The looks of nodes, numbered."""
    names = [g for g in _SIGN.groupindex if g != "eq"]
    names += [n + "?" for n in ("tag", "opentag", "entity", "bare", "dollars")]
    names = ["page", "line", "trailer", *names]
    return {n: i for i, n in enumerate(names)}


class Tree:
    """The nodes of one text, parents first; ``signs`` holds (node, start, end, kind of sign) of each sign."""

    __slots__ = ("parent", "look", "signs")

    def __init__(self, text: str) -> None:
        known = looks()
        self.parent, self.look, self.signs = [-1], [known["page"]], []
        page = "\n" + text
        begins, ends = trailers(page)
        line, line_end, in_trailer, lower, closed = 0, -1, -1, "", {}
        open_elements: list[tuple[str, int]] = []
        how_many: dict[str, int] = {}
        for kind, start, end in signs_in(page):
            content = page[start:end]
            near = bisect_right(begins, start) - 1
            inside = near if near >= 0 and start < ends[near] else -1
            if start >= line_end or inside != in_trailer or not self.signs:
                self.parent.append(0)
                self.look.append(known["trailer" if inside >= 0 else "line"])
                line, in_trailer = len(self.look) - 1, inside
                # a trailer is one node, however many lines it has
                line_end = ends[inside] if inside >= 0 else page.find("\n", start + 1) + 1 or len(page) + 1
            look = _look(kind, content)
            self.parent.append(open_elements[-1][1] if open_elements and inside < 0 else line)
            self.look.append(known[look])
            node = len(self.look) - 1
            self.signs.append((node, start - 1, end - 1, kind))
            if look == "tag" and content[-2] != "/":
                name = re.match(r"</?([A-Za-z0-9]+)", content).group(1).lower()
                if content[1] != "/":
                    if name not in VOID:
                        if name not in closed:
                            lower = lower or page.lower()
                            closed[name] = lower.rfind("</" + name)
                        if closed[name] >= end:  # an element that is never closed holds nothing
                            open_elements.append((name, node))
                            how_many[name] = how_many.get(name, 0) + 1
                elif how_many.get(name):
                    while True:
                        popped = open_elements.pop()[0]
                        how_many[popped] -= 1
                        if popped == name:
                            break


#: What a parent is, for the potentials of its children: the page, a line or trailer, a sign.
PARENTS = 3


def _parent_kind(look: np.ndarray) -> np.ndarray:
    known = looks()
    return np.where(look == known["page"], 0, np.where((look == known["line"]) | (look == known["trailer"]), 1, 2))


def marginals(trees: list[Tree], unary: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Sum-product over all trees at once, level by level: the log marginals of all nodes, one tree after the other."""
    sizes = [len(t.look) for t in trees]
    offsets = np.cumsum([0, *sizes])
    look = np.concatenate([np.asarray(t.look) for t in trees])
    parent = np.concatenate([np.asarray(t.parent) + (o if len(t.parent) else 0) for t, o in zip(trees, offsets)])
    roots = offsets[:-1]
    parent[roots] = -1
    depth = np.zeros(len(look), "int64")
    for t, o in zip(trees, offsets):
        own = depth[o : o + len(t.look)]
        for i, p in enumerate(t.parent):
            if p >= 0:
                own[i] = own[p] + 1
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]

    above_kind = _parent_kind(look[np.maximum(parent, 0)])  # which potentials tie a node to its parent

    def summed(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    up = unary[look].copy()  # own look and what the children say
    message = np.zeros_like(up)  # from a node to its parent
    for nodes in reversed(levels[1:]):
        message[nodes] = summed(pair[above_kind[nodes]] + up[nodes][:, None, :], 2)
        np.add.at(up, parent[nodes], message[nodes])
    belief = up.copy()
    for nodes in levels[1:]:
        above = belief[parent[nodes]] - message[nodes]
        belief[nodes] += summed(pair[above_kind[nodes]] + above[:, :, None], 1)
    belief -= summed(belief, 1)[:, None]
    return belief


_WORDS = "rule notice holder fee county record keeper must file copy annual before after where each the a of and under review bridge".split()


def labelled_pages(pages: int = PAGES, seed: int = 11) -> Iterator[tuple[str, str, list[tuple[int, int, str]]]]:
    """Pages with their kind and the spans of each piece with its label; signs in plain pieces are plain signs."""
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(_WORDS) for _ in range(n))
    n = lambda: rng.randint(1, 999)

    def plain() -> str:
        return rng.choice(
            [
                lambda: f"The rate applies where {n()} < n < {n()} units flow.",
                lambda: f"The charge runs from ${n()} to ${n()} for each {words(1)}.",
                lambda: f"The area is {n()}*{n()} feet, see note [{n()}]. Classes A|B are treated alike*, as noted.",
                lambda: f"The balance is {n()} == {n()} in the old {words(1)}. Item {n()}_{n()} is {{reserved}}.",
                lambda: f"Old copies lie under F:\\t{n()}\\old on the machine. It costs ~{n()} and 5^2 parts.",
                lambda: f"Signed ________________ (holder). Form #{n()} or #{n()}. Write to a@b.example & keep it; it's 'final' in {n()}.",
                lambda: f"{words(8)}\n{words(6)}.",
                lambda: f"{words(12)}.",
                lambda: f"(a) {words(4)}; (b) {words(4)}.\n\n{words(3)} -- {words(3)}; R&D and Q&A; AT&T; {n()}<{n()}.",
            ]
        )()

    makers = {
        "html": [
            lambda: f"<p>{words(5)}</p>", lambda: f"<b>{words(1)}</b>", lambda: f"{words(2)}&nbsp;{words(2)}", lambda: f"<br/>{words(3)}",
            lambda: f"<ul><li>{words(4)}<li>{words(4)}</ul>", lambda: f"<table><tr><td>{words(2)}</td><td>{n()}</td></tr></table>",
            lambda: f"<!-- row {n()} --><code>{words(4)}</code>", lambda: f"<strike>{words(1)}</strike> <u>{words(1)}</u>", lambda: f"&lt;i&gt;{words(1)}",
            lambda: f"<html><head><title>{words(3)}</title></head><body><H3 class=hd>{words(3)}</H3>", lambda: f"<FONT size=2>{words(2)}", lambda: "&#167; &mdash; &amp;nbsp;",
        ],
        "markdown": [
            lambda: f"\n## {words(3)}\n", lambda: f"\n{words(3)}\n=======\n", lambda: f"**{words(2)}**", lambda: f"*{words(2)}*", lambda: f"`{words(1)}`",
            lambda: f"\n```\n{words(8)}\n```\n", lambda: f"\n- {words(4)}\n- {words(4)}\n", lambda: f"\n* {words(4)}\n* {words(4)}\n", lambda: f"\n> {words(6)}\n",
            lambda: f"\n| item | fee |\n|---|---|\n| {words(1)} | {n()} |\n", lambda: f"[{words(2)}](https://a.example/{n()})", lambda: f"\n### {words(2)} ###\n",
        ],
        "wiki": [
            lambda: f"\n== {words(3)} ==\n", lambda: f"'''{words(2)}'''", lambda: f"''{words(1)}''", lambda: f"[[{words(2)}|{words(1)}]]", lambda: f"\n[[Category:{words(1)}]]\n",
            lambda: f"{{{{Infobox act|chapter={n()}}}}}", lambda: "{{cn}}", lambda: f"[https://a.example/{n()} {words(2)}]",
            lambda: f'\n{{| class="grid"\n! {words(1)} !! {words(1)}\n|-\n| {words(1)} || {n()}\n|}}\n', lambda: f"\n* {words(4)}\n* {words(4)}\n",
        ],
        "latex": [
            lambda: f"\n\\section{{{words(3)}}}\n", lambda: f"\\textbf{{{words(1)}}}", lambda: f"\\emph{{{words(1)}}}", lambda: f"{words(2)}.~\\ref{{sec:{n()}}}",
            lambda: f"\n\\begin{{itemize}}\n\\item {words(4)}\n\\item {words(3)}\n\\end{{itemize}}\n", lambda: f"\n\\begin{{verbatim}}\n{words(8)}\n\\end{{verbatim}}\n",
            lambda: f"$L = \\frac{{a_{{{n()}}}}}{{b + {n()}}}$", lambda: f"\n\\[ F = \\sum_{{i=1}}^{{{n()}}} r_i \\times q_i \\]\n", lambda: f"$x_{{{n()}}} = y$",
        ],
    }
    for _ in range(pages):
        kind = rng.choice(STATES[:5])
        pieces: list[tuple[str, str]] = [(f"({n()} ILCS {n()}/{n()})\n", "plain")] if rng.random() < 0.5 else []
        for _ in range(rng.randint(2, 9)):
            for _ in range(rng.randint(1, 3)):
                if kind != "plain" and rng.random() < 0.6:
                    pieces.append((rng.choice(makers[kind])(), kind))
                elif rng.random() < 0.04:
                    other = rng.choice(STATES[1:5])
                    pieces.append((rng.choice(makers[other])(), other))
                else:
                    pieces.append((plain(), "plain"))
                pieces.append((rng.choice([" ", " ", "\n", "\n\n"]), "plain"))
        if rng.random() < 0.5:
            pieces.append((rng.choice([f"\n(Source: 'P.A. {n()}-{n()}', 'note ''a'' of 1-2-30'.)", f"\n(Source: P.A. {n()}-{n()} | {n()}-{n()}\n| {n()}-{n()}.)"]), "plain"))
        spans, at = [], 0
        for piece, label in pieces:
            spans.append((at, at + len(piece), label))
            at += len(piece)
        yield "".join(p for p, _ in pieces), kind, spans


@lru_cache(2)
def potentials(pages: int = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Log potentials (look given state, state given what the parent is and its state), counted on labelled pages."""
    unary, pair = np.full((len(STATES), len(looks())), UNSEEN), np.full((PARENTS, len(STATES), len(STATES)), SMOOTHING)
    for text, kind, spans in labelled_pages(pages):
        tree = Tree(text)
        starts = [s for s, _, _ in spans]
        state = [STATES.index("plain")] * len(tree.look)
        state[0] = STATES.index(kind)
        for node, start, end, _ in tree.signs:
            at = np.searchsorted(starts, max(start + (text[start : start + 1] == "\n"), 0), "right") - 1
            state[node] = STATES.index(spans[at][2])
            up = tree.parent[node]
            if tree.look[up] == looks()["trailer"]:
                state[up] = STATES.index("cited")
                state[node] = state[node] or state[up]
            if tree.look[up] == looks()["line"] and state[up] == 0:
                state[up] = state[node]
        kinds = _parent_kind(np.asarray(tree.look))
        for node, look in enumerate(tree.look):
            unary[state[node], look] += 1
            if (above := tree.parent[node]) >= 0:
                pair[kinds[above], state[above], state[node]] += 1
    unary = np.log(unary / unary.sum(1, keepdims=True))
    return unary.T.copy(), np.log(pair / pair.sum(2, keepdims=True))


def read_signs(texts: list[str | None]) -> list[list[tuple[int, int, str, str]]]:
    """Of each text its signs that are markup: (start, end, kind of sign, kind of markup)."""
    trees = [Tree(t) if t else None for t in texts]
    own = [t for t in trees if t is not None and t.signs]
    if not own:
        return [[] for _ in texts]
    belief = marginals(own, *potentials())
    best = belief.argmax(1)
    out, at = [], 0
    for t in trees:
        if t is None or not t.signs:
            out.append([])
            continue
        out.append([(max(s, 0), e, kind, STATES[best[at + node]]) for node, s, e, kind in t.signs if best[at + node] in MARKUP])
        at += len(t.look)
    return out


#: Characters of texts whose trees are held at once; a longer text is read by itself.
TOGETHER = 1 << 20


def read_in_groups(texts: Iterable[str | None]) -> Iterator[tuple[str | None, list[tuple[int, int, str, str]]]]:
    """Each text with its signs that are markup (:func:`read_signs`)."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            yield from zip(group, read_signs(group))
            group, size = [], 0
    yield from zip(group, read_signs(group))


_NAME = re.compile(r"</?([A-Za-z0-9]+)")
_ESCAPED = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?/?>")
_BREAKS = frozenset("p div br tr table ul ol dl center blockquote hr body html pre section article".split())


class _Parts:
    """Collects a text's parts: (kind, text) with kind ``text``, ``heading``, ``item``, ``code``, ``row`` or ``formula``."""

    def __init__(self) -> None:
        self.done: list[tuple[str, str]] = []
        self.kind, self.buffer, self.hidden, self.escaped = "text", [], 0, False

    def put(self, text: str) -> None:
        if not self.hidden:
            self.buffer.append(text)

    def close(self, kind: str = "text") -> None:
        text = "".join(self.buffer)
        if self.escaped:  # elements and references that were written in references
            text = _ESCAPED.sub(lambda m: "" if m[1].lower() in ELEMENTS else m[0], html.unescape(text))
        if self.kind == "code":
            text = text.strip("\n")
        else:
            text = "\n".join(" ".join(x.split()) for x in re.split(r"\n\s*\n", text.strip()) if x.strip())
        if text.strip(" |"):
            self.done.append((self.kind, text.strip(" |") if self.kind == "row" else text))
        self.kind, self.buffer, self.escaped = kind, [], False


def parts_of(text: str, signs: list[tuple[int, int, str, str]]) -> list[tuple[str, str]]:
    """The parts of a text without its markup; struck text, scripts, comments and templates are left out."""
    out, at, literal = _Parts(), 0, ""
    for start, end, sign, markup in signs:
        if start < at:
            continue
        out.put(text[at:start])
        content, at = text[start:end], end
        if literal and not (sign == "fence" and literal == "fence" or sign == "begin" and content.startswith("\\end") and literal == "begin"):
            out.put(content)
            continue
        if sign == "tag":
            name, closing = _NAME.match(content).group(1).lower(), content[1] == "/"
            if name in HIDDEN:
                if name == "head" and not closing:
                    continue
                out.hidden = max(0, out.hidden + (-1 if closing else 1)) if not content.endswith("/>") else out.hidden
            elif re.fullmatch("h[1-6]", name):
                out.close("text" if closing else "heading")
            elif name == "li":
                out.close("text" if closing else "item")
            elif name in ("code", "pre"):
                out.close("text" if closing else "code")
            elif name == "tr":
                out.close("text" if closing else "row")
            elif name in ("td", "th"):
                if out.kind != "row":
                    out.close("row")
                out.put(" | " if closing else "")
            elif name in _BREAKS:
                out.close()
        elif sign == "entity":
            out.put(html.unescape(content))
            out.escaped = True
        elif sign in ("comment", "opentag", "template", "tie", "magic", "rule"):
            if sign == "rule":  # underlines the line before it
                own = "".join(out.buffer)
                head = own.rstrip().rpartition("\n")
                if head[2].strip() and not own.endswith("\n\n"):
                    out.buffer = [head[0]]
                    out.close("heading")
                    out.put(head[2])
                out.close()
        elif sign in ("math", "dollars"):
            out.close("formula")
            out.put(content.strip("$") if content[0] == "$" else content[2:-2])
            out.close()
        elif sign in ("bold", "emphasis", "code", "quotes", "struck"):
            out.put("" if sign == "struck" else content.strip("*_`'"))
        elif sign == "fence":
            literal = "" if literal else "fence"
            out.close("code" if literal else "text")
        elif sign == "begin":
            verbatim = "verbatim" in content or "lstlisting" in content
            literal = "begin" if verbatim and content.startswith("\\begin") else ""
            out.close("code" if literal else "text")
        elif sign in ("hash", "wikihead"):
            out.close("heading")
            out.put(content.strip().strip("#=").strip())
            out.close()
        elif sign in ("dash", "star"):
            out.close("item")
        elif sign == "quote":
            out.put("\n")
        elif sign == "mdtable":
            out.close("row")
            cells = [c.strip() for c in content.strip().strip("|").split("|")]
            out.put("" if all(re.fullmatch(r":?-+:?", c) for c in cells) else " | ".join(cells))
            out.close()
        elif sign == "wikitable":
            out.close("row")
            line = content.strip()
            if line[:2] not in ("{|", "|}", "|-"):
                out.put(" | ".join(c.strip() for c in re.split(r"!!|\|\|", line[1:])))
            out.close()
        elif sign == "wikilink":
            inner = content[2:-2]
            out.put("" if re.match(r"\s*(?:Category|File|Image):", inner) else inner.rpartition("|")[2])
        elif sign == "mdlink":
            out.put(content.lstrip("!")[1:].partition("](")[0])
        elif sign == "extlink":
            out.put(content[1:-1].partition(" ")[2])
        elif sign in ("command", "bare"):
            name = content.strip("\\*")
            argument = re.compile(r"\s?(?:\[[^\]]*\])?\s?\{([^{}]*)\}").match(text, end) if sign == "command" else None
            if name == "item":
                out.close("item")
            elif argument is not None:
                at = argument.end()
                if name in ("section", "subsection", "subsubsection", "chapter", "title", "part", "paragraph"):
                    out.close("heading")
                    out.put(argument.group(1))
                    out.close()
                elif name not in ("ref", "label", "cite", "usepackage", "documentclass", "pageref", "eqref"):
                    out.put(argument.group(1))
            elif name not in BARE:
                out.put(content)
    out.put(text[at:])
    out.close()
    return out.done


def markup_kinds(text: Column) -> Column:
    """``ARRAY<STRING>``, sorted: the kinds of markup in ``text``; empty for null, blank and plain text."""

    @F.pandas_udf("array<string>")
    def kinds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([sorted({m for _, _, _, m in signs}) for _, signs in read_in_groups(texts)], dtype="object")

    return kinds(text)


def clean_parts(text: Column) -> Column:
    """``ARRAY<STRUCT<kind, text>>``: ``text`` without markup, in parts.

    ``kind`` is ``text``, ``heading``, ``item`` (of a list), ``code``, ``row`` (of a table, cells parted by ``|``) or
    ``formula``. Null and blank text give no parts; a text without markup gives one part of each paragraph's words.
    Whole texts are read, of any length; plain signs, among them hard line breaks, stay as they are.
    """

    @F.pandas_udf("array<struct<kind: string, text: string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(
                [[{"kind": k, "text": p} for k, p in parts_of(t, s)] if t else [] for t, s in read_in_groups(texts)], dtype="object"
            )

    return parts(text)


def kinds_found(texts: DataFrame, ids: list[str], text: Column) -> DataFrame:
    """``ids..., markup``: one row for each kind of markup in ``text``. One pass, no shuffle; repeated rows stay repeated."""
    return texts.where(text.isNotNull()).select(*ids, F.explode(markup_kinds(text)).alias("markup"))
