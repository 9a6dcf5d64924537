import difflib
import hashlib
import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataleaf.functions import normalize as N
from strataleaf.functions import scalars as S
from strataleaf.operators import compare as C
from strataleaf.operators import extract as X
from strataleaf.operators import sections as P
from strataleaf.plans import texts as texts_plan


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o"))
    return [r.o for r in df.orderBy("i").collect()]


# --- normalisation ---


def test_each_rule(spark):
    cases = [("é", "é"), ("‘a’ “b” 1‑2 co­op﻿", "'a' \"b\" 1-2 coop"), (" a \n\tb c ", "a b c"), ("a , b ; (c )", "a, b; (c)"), ("( a [ b", "(a [b"), ("x.  y?\n\nz", "x. y? z"), (None, None), ("", "")]
    assert column(spark, [a for a, _ in cases], N.normalize) == [b for _, b in cases]


def test_what_must_stay_different(spark):
    pairs = [("shall", "must"), ("rule", "rules"), ("Act", "act"), ("5-1", "5.1"), ("a, b", "a b"), ("end.", "end"), ("0.15%", "0.15 %"), ("1999", "1998")]
    a, b = column(spark, [x for x, _ in pairs], N.normalize), column(spark, [y for _, y in pairs], N.normalize)
    assert all(x != y for x, y in zip(a, b))


def test_rules_in_declared_order_and_idempotent(spark):
    texts = ["“a  ,  b” (  c ).   D é"]
    assert column(spark, texts, lambda c: N.normalize(c, ["N4", "N3"])) == column(spark, texts, lambda c: N.normalize(c, ["N3", "N4"]))
    once = column(spark, texts, N.normalize)
    assert column(spark, once, N.normalize) == once
    with pytest.raises(ValueError):
        N.normalize(F.col("x"), ["N9"])


def test_rules_match_python_on_random_text(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab.,;:)]([?! \t\n\r  \u0085\u001c‘’“­‑é") for _ in range(40)) for _ in range(300)]

    def scalar(t):
        t = unicodedata.normalize("NFC", t)
        t = t.translate(str.maketrans(dict(zip("‘’‚′“”„″‑", "''''\"\"\"\"-")) | {"­": None, "﻿": None}))
        t = " ".join(t.split())
        t = re.sub(r"[ \t]+(?=[,;:.)\]])", "", t)
        t = re.sub(r"(?<=[(\[])[ \t]+", "", t)
        return re.sub(r"(?<=[.?!])\s{2,}", " ", t)

    assert column(spark, texts, N.normalize) == [scalar(t) for t in texts]


# --- scalars ---


def test_scalars(spark):
    assert column(spark, ["97-81", "097-0081", "103-12345", "x", None], S.padded_act) == ["097-0081", "097-0081", "103-12345", None, None]
    assert column(spark, ["97-81", "x-1", "", None], S.assembly_of) == [97, 0, 0, 0]
    assert [r and tuple(r) for r in column(spark, ["10 ILCS 5/ Election", "x", " ILCS 5/", None], S.act_key)] == [("10", "5"), None, None, None]
    assert column(spark, ["Sec. 1-2. (Repealed).", "Sec. 1. (Repealed)\n", "Sec. 1. Repealed here", None], S.is_repeal_stub) == [True, True, False, False]
    assert column(spark, ["Document: 86-1 is not currently available.", "An Act", None], S.is_placeholder) == [True, False, False]
    urls = ["https://ilga.gov/x", "ftp://ilga.gov/x", "https://evil.gov/x", "https://www.ilga.gov/Search/a", "https://ilga.gov/searching", "https://ilga.gov/api.json", None]
    assert column(spark, urls, S.url_verdict) == ["ok", "scheme", "host", "path", "ok", "path", None]
    assert column(spark, ["5", "45", "125", "7300", "-5", None], lambda c: S.duration(c.cast("double"))) == ["5s", "45s", "2m 5s", "2h 1m", "0s", None]


def test_document_names_round_half_to_even(spark):
    df = spark.createDataFrame([("5", "70", "4"), ("5", "5.25", "1"), ("5", "70a", "4"), (None, "1", "1")], "c string, a string, s string")
    assert [r[0] for r in df.select(S.document_name(F.col("c"), F.col("a"), F.col("s"))).collect()] == ["000500700K4", "000500052K1", None, None]


def test_wilson(spark):
    low, high = S.wilson(F.lit(83), F.lit(94))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert round(r.l, 3) == 0.802 and round(r.h, 3) == 0.933
    none = S.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(none[0].alias("l")).first().l is None


# --- extraction ---


def both(spark, page):
    r = spark.createDataFrame([(page,)], "p string").select(X.extraction(F.col("p")).alias("x")).first().x
    return r.text, r.pre_text, r.strike_spans, r.insert_spans


def test_readings_of_markup(spark):
    assert both(spark, "<p>A <strike>old</strike> <u>new</u> rule</p>") == ("A new rule", "A old rule", 1, 1)
    assert both(spark, "a <s>b</s>, c")[0] == "a, c"
    assert both(spark, "a<del>b</del>c")[0] == "ac"
    assert both(spark, "<head><title>t</title></head><style>x</style>b&nbsp;&sect; c&#167;")[0] == "b § c§"
    assert both(spark, "a<center>b</center>c<br/>d")[0] == "a\nb\nc\nd"
    assert both(spark, "<strike>a <s>b</s> c</strike>d") == ("d", "a b cd", 2, 0)
    assert both(spark, "x <strike>never closed <p>more")[0] == "x"
    assert both(spark, "a</strike> b")[0] == "a b"
    assert both(spark, "a <strike>b</strike>\n<strike>c</strike> d")[0] == "a d"
    assert both(spark, "") == ("", "", 0, 0)
    assert both(spark, None) == (None, None, None, None)
    assert both(spark, "a <strike/> b<!-- c --><!DOCTYPE x> d")[0] == "a  b d"  # ignored, without a mark


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n.,;)\x00", max_size=30), min_size=1, max_size=40))
def test_mark_repair_matches_a_scalar_statement(spark, texts):
    def scalar(t):
        out, i = [], 0
        while i < len(t):
            j = i
            while j < len(t) and t[j] in " \t\r\n\x00":
                j += 1
            run = t[i:j]
            if "\x00" in run:
                nxt = t[j : j + 1]
                out.append("" if nxt and nxt in ",;:.)]}!?" else " " if run.strip("\x00") else "")
            else:
                out.append(run)
            if j < len(t):
                out.append(t[j])
            i = j + 1
        return "".join(out)

    assert column(spark, texts, X.repair_marks) == [scalar(t) for t in texts]


def test_long_runs_of_marks_and_line_numbers(spark):
    assert column(spark, ["a " + "\x00 " * 20000 + "b"], X.repair_marks) == ["a b"]
    assert column(spark, ["a\n 12 \n1234\nb\n7"], X.drop_line_numbers) == ["a\n1234\nb"]


# --- sections ---

TWO = "intro (10 ILCS 5/1-2) (from Ch. 46, par. 1-2)\n(Text of Section before\namendment by P.A. 103-1)\nSec. 1-2. Old words.\n(Source: P.A. 97-81, eff. 1-1-12.)\n(Text of Section after amendment by P.A. 103-1)\nSec. 1-2. New words.\n(Source: P.A. 97-81; 103-1, eff.\n1-1-24.) tail (10 ILCS 5/) x (10 ILCS 5/Art. 2 heading) y"
ACT = "Section 5. The Code is amended:\n(5 ILCS 1/3 new)\nSec. 3. Added.\nMore.\nSection 99. Effective date.\n(5 ILCS 1/4 rep.)\nend (was 5 ILCS 1/9)"


def parsed(spark, text):
    df = spark.createDataFrame([(1, text, "x")], "doc_id int, text string, citation string")  # a clashing name
    return P.parse_blocks(df, "doc_id", F.col("text")).orderBy("pos", "ver").collect()


def test_versions_under_one_header(spark):
    a, b, h = parsed(spark, TWO)
    assert [(x.pos, x.ver, x.citation.section) for x in (a, b, h)] == [(0, 1, "1-2"), (0, 2, "1-2"), (2, 1, "Art. 2 heading")]
    assert a.body == "Sec. 1-2. Old words.\n" and b.body == "Sec. 1-2. New words.\n"
    assert a.legacy_cite == "46, par. 1-2" and b.legacy_cite is None
    assert a.version_marker == "(Text of Section before amendment by P.A. 103-1)"
    assert a.source.pa_numbers == ["97-81"] and b.source.pa_numbers == ["97-81", "103-1"] and h.source is None
    assert b.source.raw == "P.A. 97-81; 103-1, eff. 1-1-24." and a.catchline == "1-2"


def test_added_and_repealed_sections(spark):
    new, rep = parsed(spark, ACT)
    assert (new.op_marker, new.citation.section, new.body) == ("new", "3", "Sec. 3. Added.\nMore.\n")
    assert (rep.op_marker, rep.citation.section) == ("rep.", "4")
    assert rep.renumbered_from.section == "9"


def test_no_sections_and_long_documents(spark):
    assert parsed(spark, "") == [] and parsed(spark, None) == [] and parsed(spark, "no header") == []
    long = "".join(f"(5 ILCS 1/{i}) Sec. {i}. {'word ' * 200}(Source: P.A. 90-{i}.)\n" for i in range(1, 801))
    assert len(parsed(spark, long)) == 800


def scalar_blocks(text):
    """A plain statement of the parser: ``(pos, ver, citation, marker, catchline, legacy, version, was, raw, body, source)``."""
    flags = re.A | re.S | re.I
    heads = list(re.finditer(P.HEADER, text, re.A))
    for pos, m in enumerate(heads):
        window = text[m.start() : heads[pos + 1].start() if pos + 1 < len(heads) else len(text)]
        chapter, act, section = re.match(P.HEADER_PARTS, window, re.A).groups()
        section = " ".join(section.split())
        op = re.match(r"(.*?)\s+(new|rep\.)$", section, flags)
        section, op = (op[1], op[2].lower()) if op else (section, None)
        if not section:
            continue
        cuts = [0] + [s.end() for s in re.finditer(r"\(\s*Source:\s*[^)]*?\s*\)", window, flags)]
        pieces = [window[a:b] for a, b in zip(cuts, cuts[1:])] or [window]
        for ver, raw in enumerate(pieces, 1):
            find = lambda pattern, f=flags: re.search(pattern, raw, f)
            source, catch = find(r"\(\s*Source:\s*([^)]*?)\s*\)"), find(r"\bSec\.\s*([0-9A-Za-z.\-]+)\s*\.", re.A)
            legacy, version = find(r"\(\s*from\s+Ch\.\s*([^)]+?)\s*\)"), find(r"\(\s*Text of (?:Section|Sec\.)[^)]*?\)")
            order = re.compile(r"^[ \t]*Section\s+[0-9]+[0-9A-Za-z.\-]*\.", re.A | re.M).search(raw, catch.end() if catch else 0)
            end = source.start() if source else order.start() if order else len(raw)
            start = catch.start() if catch else max([m.end() for m in (legacy, version) if m and m.end() <= end], default=0)
            was = re.search(r"\(\s*was\s+([0-9]+)\s+ILCS\s+([0-9A-Za-z.\-]+)\s*/\s*([^)]+?)\s*\)", raw[:end] if end else raw, flags)
            yield (
                pos, ver, f"{chapter} ILCS {act}/{section}", op, catch and catch[1], legacy and legacy[1].strip(), version and " ".join(version[0].split()),
                was and f"{was[1]} ILCS {was[2]}/{' '.join(was[3].split())}", digest(raw), digest(raw[start:end]), source and " ".join(source[1].split()),
            )


def digest(text):
    return hashlib.md5(text.encode()).hexdigest()


ODD = [
    "(5 ILCS 1/2) (from Ch. 1, par. 2) (Text of Section after\nx) words\nSection 9. Next.\n",  # no catchline, no trailer
    "(5 ILCS 1/2)\nSec. 2. Words.\nSection 9. Next. Section 10. x",
    "(5 ILCS 1/2)\nxSec. 2. Sec. 2. Words (was 5 ILCS 1/7)\n(Source: P.A. 90-1.)\n (Text of Sec. 2 later) no catchline (Source: P.A. 91-1.) tail",
    "(5 ILCS 1/2) (Source: P.A. 90-1.)\nSec. 2. After its trailer. Section 4. (from Ch. 2, par. 3)",
    "(5 ILCS 1/2) Section 3. opens here\nSec. 2. Words of\n  Section 7. go.",
    "(5 ILCS 1/2) Sec. 2. Section 5. of this Act applies.",
    "(5 ILCS 1/2) Sec. 2. Words.Section 5. not at a line's start\n \t Section 5. at one",
]


def test_section_blocks_of_whole_tables_against_a_scalar_statement(spark, tmp_path):
    small = "/root/testdata/sf0.001"
    documents, blocks = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "blocks"))
    texts = [TWO, ACT, *ODD, "", None, *(r.text for r in documents.select("text").collect()), *(r.raw for r in blocks.select("raw").collect())]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    odd.select(F.col("doc_id").alias("block_id"), F.col("text").alias("raw")).write.parquet(str(tmp_path / "blocks.parquet"))
    got = sorted(map(repr, (tuple(r) for r in texts_plan.section_blocks(spark, str(tmp_path)).collect())))
    want = [(kind, i, *row) for kind in ("document", "block") for i, t in enumerate(texts) if t for row in scalar_blocks(t)]
    assert len(want) > 2 * len(ODD) and got == sorted(map(repr, want))


def test_source_lines(spark):
    raws = ["P.A. 102-839, eff. 5-13-22; 103-274", "Laws 1961, p. 5", "P.A.102-839", "P.A. 90-1; 90-1; 91-2", None]
    got = column(spark, raws, lambda c: F.array_join(P.source_line(c)["pa_numbers"], ","))
    assert got == ["102-839,103-274", "", "", "90-1,91-2", None]
    assert column(spark, raws, lambda c: P.source_line(c)["has_non_pa_provenance"]) == [False, True, False, False, None]


# --- comparison ---


def test_compared(spark):
    df = spark.createDataFrame([(1, "a b.  c", "a b. c", "x"), (2, "one two three", "one four three", None), (3, None, "x", None), (4, "", "", None)], "id int, p string, r string, diff string")
    got = {r.id: r for r in C.compared(df, F.lit("L"), F.col("p"), F.col("r")).collect()}
    assert (got[1].exact_match, got[1].normalized_match, got[1].similarity, got[1].changes, got[1].diff) == (False, True, 1.0, [], "")
    assert got[2].changes == ["replace 'two' -> 'four'"] and got[2].similarity == 0.6667 and "+one four three" in got[2].diff
    assert got[3].normalized_match is None and got[3].similarity is None
    assert got[4].exact_match and got[4].similarity == 1.0


def test_lines_and_changes():
    assert C.display_lines("Sec. 1-2. Words here. More; (a) b") == ["Sec. 1-2. Words here.", "More;", "(a) b"]
    long = C.display_lines("w" * 60 + " " + "x" * 30 + " " + "y" * 60)
    assert long == ["w" * 60 + " " + "x" * 30, "y" * 60]
    assert C.changed_words(list("abc"), list("ac")) == ["only in compilation: 'b'"] and C.changed_words([], ["z"]) == ["only in Act: 'z'"]
    many = C.changed_words([str(i) for i in range(60)], [str(i) if i % 2 else "x" for i in range(60)])
    assert len(many) == 13 and many[-1] == "..."
    assert C.word_similarity("", "") == 1.0 and C.word_similarity("a b", "b a") == difflib.SequenceMatcher(None, ["a", "b"], ["b", "a"], False).ratio()


def test_percentages_round_as_the_exact_double_does(spark):
    pairs = [(57, 400), (3, 2000), (1, 8), (5000, 1), (1, 3), (0, 5), (1, 0)]
    df = spark.createDataFrame(pairs, "a int, b int").select(S.percent(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in df.collect()] == [f"{100 * a / b:.1f}%" if b else "n/a" for a, b in pairs]
