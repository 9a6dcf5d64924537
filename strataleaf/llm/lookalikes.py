"""Text that reads the same written in different characters: one form for all of it.

Pairs of strings that read the same are united into classes (union-find over code points and strings, so that what is
alike through a third is alike). Of each class, and for each script its letters belong to, the member that the corpus
writes most often stands for the others. Texts are rewritten greedily, the longest match first, by an automaton of all
members that stand for nothing themselves; letters of another script are rewritten only in words that mix scripts.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like a Latin letter, as in the confusables of Unicode's TR 39.
LATIN_OF_CYRILLIC = {
    "а": "a", "А": "A", "В": "B", "е": "e", "Е": "E", "К": "K", "М": "M", "Н": "H", "о": "o", "О": "O", "р": "p", "Р": "P",
    "с": "c", "С": "C", "Т": "T", "у": "y", "У": "Y", "х": "x", "Х": "X", "і": "i", "І": "I", "ј": "j", "Ј": "J", "ѕ": "s",
    "Ѕ": "S", "һ": "h", "ԁ": "d", "ԛ": "q", "Ԛ": "Q", "ԝ": "w", "Ԝ": "W", "ӏ": "l",
    "ѵ": "v", "Ѵ": "V",
}
LATIN_OF_GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "ο": "o", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ϲ": "c", "Ϲ": "C", "ϳ": "j",
    "α": "a", "ι": "i", "ν": "v", "ρ": "p", "υ": "u",
}
# Characters that are not seen at all, and hyphens drawn like hyphen-minus.
UNSEEN = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩﻿" + "".join(map(chr, range(0xFE00, 0xFE10)))
HYPHENS = "‐‑﹣－"
#: The part of all texts that the ordinary member of a class is given beyond those that hold it, whatever their number:
#: another member stands for the class only if it is in so many more texts.
ORDINARY = 0.5


class UnionFind:
    """Classes of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def unite(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b, key=lambda s: (len(s), s))] = min(a, b, key=lambda s: (len(s), s))

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return [sorted(c) for c in out.values() if len(c) > 1]


def script(text: str) -> str:
    """``Latin``, ``Cyrillic`` or ``Greek`` of the first letter that has one of these, else empty."""
    for ch in unicodedata.normalize("NFKD", text):
        at = ord(ch)
        if ch.isalpha():
            if at < 0x250 or 0x1E00 <= at < 0x1F00:
                return "Latin"
            if 0x400 <= at < 0x530:
                return "Cyrillic"
            if 0x370 <= at < 0x400 or 0x1F00 <= at < 0x2000:
                return "Greek"
    return ""


@lru_cache(1)
def classes() -> tuple[tuple[tuple[str, ...], frozenset[str]], ...]:
    """Each class of strings that read the same, with its ordinary members.

    From Unicode's own data: wide and narrow forms, spaces, ligatures, letters with a canonical equivalent and accents
    in a piece of their own; and from the lists above.
    """
    same, ordinary = UnionFind(), set(" -") | {chr(i) for i in range(33, 127)}
    same.unite("", UNSEEN[0])
    ordinary.add("")
    for ch in UNSEEN:
        same.unite("", ch)
    for ch in HYPHENS:
        same.unite("-", ch)
    for table in (LATIN_OF_CYRILLIC, LATIN_OF_GREEK):
        for a, b in table.items():
            same.unite(a, b)
            ordinary.add(a)
    for at in [*range(0x80, 0x3100), *range(0xA640, 0xAB70), *range(0xF900, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x2F800, 0x2FA1E)]:
        ch = chr(at)
        if ch in UNSEEN or ch in HYPHENS:
            continue
        if unicodedata.category(ch) == "Zs" and at != 0x1680:
            same.unite(" ", ch)
            continue
        parts = unicodedata.decomposition(ch).split()
        if not parts:
            continue
        if parts[0] in ("<wide>", "<narrow>") or parts[0] == "<compat>" and "LIGATURE" in unicodedata.name(ch, "") and at != 0xFB05:
            same.unite(ch, unicodedata.normalize("NFKC", ch))
            ordinary.add(unicodedata.normalize("NFKC", ch))
        elif parts[0][0] != "<":
            whole = unicodedata.normalize("NFC", ch)
            same.unite(ch, whole)
            ordinary.add(whole)
            apart = unicodedata.normalize("NFD", ch)
            if len(apart) > 1:
                same.unite(whole, apart)
                same.unite(whole, unicodedata.normalize("NFC", apart[:-1]) + apart[-1])
    return tuple((tuple(c), frozenset(ordinary & {*c})) for c in same.classes())


@lru_cache(1)
def pieces() -> ahocorasick.Automaton:
    """All members of more than one character that aren't all ASCII."""
    found = ahocorasick.Automaton()
    for members, _ in classes():
        for m in members:
            if len(m) > 1 and not m.isascii():
                found.add_word(m, m)
    found.make_automaton()
    return found


#: Letters of Greek and Cyrillic, and those beside a letter that isn't.
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u052f\u1f00-\u1fff]")
_BESIDE = re.compile("|".join(rf"[{x}][^\W\d_{x}]|[^\W\d_{x}][{x}]" for x in (r"Ͱ-Ͽἀ-῿", r"Ѐ-ԯ")))


def suspects(anywhere: dict[str, str]) -> tuple[re.Pattern[str], re.Pattern[str], bool]:
    """Any character without which a text is in its one form already, unless it mixes scripts: the last ones of all members
    that give way by ``anywhere``, and jamo, which may make a syllable; those beyond U+FFFF by themselves, first and last of
    each run, as sets of them are sought one by one; and whether ASCII is among them."""
    odd = sorted({m[-1] for m in anywhere if m})
    near, far = [c for c in odd if c <= "\uffff"], [c for c in odd if c > "\uffff"]
    runs = [c for c in far if chr(ord(c) - 1) not in far], [c for c in far if chr(ord(c) + 1) not in far]
    beyond = "".join(f"{a}-{b}" for a, b in zip(*runs))
    return re.compile("[" + "".join(map(re.escape, near)) + "\u1100-\u11ff]"), re.compile(f"[{beyond}]" if far else r"(?!)"), any(c.isascii() for c in odd)


def count_members(texts: DataFrame) -> dict[str, int]:
    """In how many texts of the corpus, a column ``text``, each member of a class stands, and under ``""`` their number.

    Texts and not places are counted, so that one long text can't outvote the others. At most as many rows as there are
    members reach the driver.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {m for members, _ in classes() for m in members if m}
        joined = [m for m in known if len(m) > 1 and m.isascii()]
        marks = re.compile("[" + "".join({re.escape(m[-1]) for m in known if len(m) > 1 and not m.isascii()}) + "]")
        sums: Counter[str] = Counter()
        for batch in batches:
            sums[""] += len(batch)  # the number of texts
            for text in batch["text"]:
                sums.update(set(text))
                sums.update([m for m in joined if m in text])
                if not text.isascii() and marks.search(text):
                    sums.update({m for _, m in pieces().iter_long(text)})
        kept = {m: n for m, n in sums.items() if m in known or not m}
        yield pd.DataFrame({"member": list(kept), "n": list(kept.values())}).astype({"member": "object", "n": "int64"})

    rows = texts.where("text IS NOT NULL").select("text").mapInPandas(counted, "member string, n bigint")
    return dict(rows.groupBy("member").agg(F.sum("n")).toPandas().itertuples(index=False, name=None))


def representatives(counts: dict[str, int]) -> tuple[dict[str, str], dict[tuple[str, str], str]]:
    """What stands for each member in any word, and for each (letter, script of its word) in a word of mixed scripts.

    In any word a member gives way to the most frequent member of its class that has its own script, or, if it has
    none, to the most frequent of all; the ordinary member has a part of all texts on its side. Members that Unicode
    composes are never chosen over their composed form.
    """
    prior = ORDINARY * max(1, counts.get("", 0))
    anywhere: dict[str, str] = {}
    mixed: dict[tuple[str, str], str] = {}
    for members, ordinary in classes():
        score = lambda m: (not m, unicodedata.is_normalized("NFC", m), counts.get(m, 0) + prior * (m in ordinary), m in ordinary, -len(m), m)  # noqa: B023, E731
        best = {s: max((m for m in members if script(m) == s), key=score) for s in {script(m) for m in members}}
        top = max(members, key=score)
        for m in members:
            if (to := best[script(m)] if script(m) else top) != m:
                anywhere[m] = to
        for s, to in best.items():
            if s:
                mixed |= {(m, s): to for m in members if len(m) == 1 and script(m) != s}
    return anywhere, mixed


_WORD = re.compile(r"[^\W\d_]+")
_OTHER = re.compile("[Ͱ-ԯἀ-῿]")
#: Joiners and variation selectors, and the tags of a flag: the unseen characters that can change how their neighbours look.
_JOINS = re.compile("[\u200c\u200d\u180b-\u180d\u180f\ufe00-\ufe0f\U000e0020-\U000e007f\U000e0100-\U000e01ef]+")


def _is_picture(ch: str) -> bool:
    return ord(ch) >= 0x1F000 or 0x2190 <= ord(ch) < 0x2C00 or unicodedata.category(ch) in ("So", "Sk", "Lo", "Mn", "Mc")


class Rewriter:
    """Rewrites texts by :func:`representatives`; made once in each worker."""

    def __init__(self, anywhere: dict[str, str], mixed: dict[tuple[str, str], str]) -> None:
        self.mixed = mixed
        self.words = ahocorasick.Automaton()
        for m, to in anywhere.items():
            if m:
                self.words.add_word(m, (len(m), to))
        self.words.make_automaton()
        self.odd, self.far, self.ascii = suspects(anywhere)

    def one(self, text: str) -> str:
        """The text's one form; a text without anything that gives way is passed on after one scan."""
        if text.isascii() and not self.ascii:
            return text
        if self.odd.search(text) is None and self.far.search(text) is None and (_FOREIGN.search(text) is None or _BESIDE.search(text) is None):
            return text
        return self(text)

    def _word(self, m: re.Match[str]) -> str:
        word = m.group()
        if _OTHER.search(word) is None:
            return word
        scripts = [script(c) for c in word]
        if len({s for s in scripts if s}) < 2:
            return word
        # the word's own script is that of the letters that belong to no other; a letter counts for each script it could be
        own = {s: sum(1 for c, of in zip(word, scripts) if of == s and not any((c, o) in self.mixed for o in ("Latin", "Cyrillic", "Greek"))) for s in ("Latin", "Cyrillic", "Greek")}
        to = max(own, key=lambda s: (own[s], scripts.count(s), s == "Latin"))
        return "".join(self.mixed.get((c, to), c) for c in word)

    def __call__(self, text: str) -> str:
        seen = set()
        while text not in seen:  # until nothing changes any more
            seen.add(text)
            out, at = [], 0
            for end, (size, to) in self.words.iter_long(text):
                start = end - size + 1
                if not to and _JOINS.fullmatch(text, start, end + 1) and (start and _is_picture(text[start - 1]) or end + 1 < len(text) and ord(text[end + 1]) >= 0x1F000):
                    continue  # joins or varies a picture, or a letter whose form it changes
                out += text[at:start], to
                at = end + 1
            new = "".join(out) + text[at:]
            if not unicodedata.is_normalized("NFC", new):
                new = unicodedata.normalize("NFC", new)
            text = _WORD.sub(self._word, new)
        return text


def one_form(counts: dict[str, int]) -> callable:
    """A pandas UDF that brings a text to its one form.

    Null stays null and an empty text empty; a text in its ordinary form comes out as it is, and a second application
    changes nothing. Whole texts are rewritten, of any length. What can be seen to differ (case, superscripts, dashes,
    curly quotes, a missing accent) stays, and so do words wholly in another script and pictures.

    Scale: no shuffle; texts without a suspect character are passed on after one scan.
    """
    anywhere, mixed = representatives(counts)

    @F.pandas_udf("string")
    def rewritten(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = Rewriter(anywhere, mixed)
        for texts in batches:
            yield pd.Series([t if t is None else rewrite.one(t) for t in texts], dtype="object")

    return rewritten


def corpus_counts(*columns: tuple[DataFrame, Column]) -> dict[str, int]:
    """:func:`count_members` over several columns of texts together."""
    texts = None
    for frame, column in columns:
        own = frame.select(column.alias("text"))
        texts = own if texts is None else texts.unionByName(own)
    return count_members(texts)
