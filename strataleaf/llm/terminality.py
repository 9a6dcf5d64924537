"""How terminal the closing words of a text are, learned from the texts themselves.

A text cut at any place ends like the beginning of a line that goes on elsewhere; a whole text ends like other whole
texts. Both are counted over all texts. Of every line each beginning is a place where a text could have been cut; its
*closing* is the shape of the line up to there (letters of a case as one letter, digits as ``9``), with the shapes of its
last word and of its last sign to fall back on where the whole line is seldom seen. With the part of texts that are cut,
the places say how many texts should end in a closing by being cut; what ends in it beyond that is whole. A word with a
full stop is an abbreviation's, and leaves its sentence open, if sentences mostly go on after it.

Everything is counted by built-in expressions into tables of fixed size, whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.session import written

#: Words of a line that its closing is made of; beyond, that of its last word.
LINE_WORDS = 6
#: Counters of a table; each closing is counted in two places, of which the smaller count holds. 16 bytes times four of
#: these are sent to the workers, whatever the data.
BUCKETS = 1 << 17
#: How many texts the closing to fall back on counts for.
PRIOR = 3.0
#: Shape of a line's beginning, of a last word within and beyond these words, of a last sign.
_KINDS = ("line", "word", "tail", "sign")


def shaped(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the column ``shape`` of the column ``text``: runs of capitals, of other cased letters and of uncased
    ones as ``A``, ``a`` and ``c``, digits as ``9`` each, spaces as one; and ``n0, n1, n2``, the letters of these kinds.

    Step by step, each a column of its own, so that no step is worked out twice.
    """
    steps = [text, "s0", "s1", "s2"]
    for i, pattern in enumerate((r"[\p{Lu}\p{Lt}]++", r"[\p{Ll}\p{M}\p{Lm}]++", r"\p{Lo}++")):
        rows = rows.withColumn(f"s{i}", F.regexp_replace(steps[i], pattern, "Aac"[i]))
    own = F.trim(F.regexp_replace(F.regexp_replace("s2", r"\p{Nd}", "9"), r"[\h\x0B\x0C]++", " "))
    # a run of n letters became one sign: n - 1 signs less
    letters = [F.length(steps[i]) - F.length(steps[i + 1]) + F.length("s2") - F.length(F.translate("s2", "Aac"[i], "")) for i in range(3)]
    return rows.withColumns({"shape": own, **{f"n{i}": n for i, n in enumerate(letters)}}).drop("s0", "s1", "s2")


def bare(text: Column | str) -> Column:
    """A text without the white space at its end."""
    return F.rtrim(text if isinstance(text, Column) else F.col(text), F.lit(" \t\r\n\x0b\x0c\x85\xa0\u2028\u2029\u3000"))


def _open(beginning: Column) -> Column:
    """``(`` where more brackets were opened than closed, else empty."""
    opened = F.length(beginning) - F.length(F.translate(beginning, "(", ""))
    closed = F.length(beginning) - F.length(F.translate(beginning, ")", ""))
    return F.when(opened > closed, "(").otherwise("")


def _closings(kind: Column, beginning: Column) -> Column:
    """The closings of a line's beginning, or of a word beyond a line's first: most telling first."""
    last = F.element_at(F.split(beginning, " "), -1)
    sign = F.concat(F.lit("sign "), F.when(kind == "line", _open(beginning)).otherwise(""), F.right(beginning, F.lit(1)))
    return F.when(
        kind == "line", F.array(F.concat(F.lit("line "), beginning), F.concat(F.lit("word "), _open(beginning), last), sign)
    ).otherwise(F.array(F.concat(F.lit("tail "), beginning), sign))


def _slots(closing: Column) -> Column:
    return F.array(F.pmod(F.xxhash64(closing), F.lit(BUCKETS)).cast("int"), (BUCKETS + F.pmod(F.xxhash64(closing, F.lit(2)), F.lit(BUCKETS))).cast("int"))


def with_closings(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``closings``, those of the column ``text``, most telling first."""
    line = F.substring_index(F.translate(bare(text), "\r", "\n"), "\n", -1)
    rows = shaped(rows.withColumn("line", line), "line").withColumn("words", F.split("shape", " "))
    short = F.size("words") <= LINE_WORDS
    kind, beginning = F.when(short, "line").otherwise("tail"), F.when(short, F.col("shape")).otherwise(F.element_at("words", -1))
    rows = rows.withColumns({"kind": kind, "beginning": beginning})
    return rows.withColumn("closings", _closings(F.col("kind"), F.col("beginning"))).drop("line", "shape", "n0", "n1", "n2", "words", "kind", "beginning")


#: A word with a full stop at its end, after which its sentence ends, or goes on.
_ENDS = r"(?<!\S)(\S*+)(?<=[\p{L}\p{N}_]\.)(?=\h*[\r\n]|\s+[A-Z(\"*\[“«]|\s+[^\x00-\x7F])"
_GOES_ON = r"(?<!\S)(\S*+)(?<=[\p{L}\p{N}_]\.)(?=\h+[!-~&&[^A-Z(\"*\[]])"


def form(word: Column) -> Column:
    """A word in lower case with digits as ``9`` and without opening brackets and quotes."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, r"^[(\"'“«\[]+", ""), r"[0-9]", "9"))


@dataclass
class Terminality:
    """What was learned: by slot how many different texts end so and how many places would be cut so; by slot how often
    sentences end after a stopped word and go on; the part of texts that are cut."""

    texts: int = 0
    places: float = 1.0
    cut: float = 0.0
    ends: np.ndarray = field(default_factory=lambda: np.zeros(2 * BUCKETS, "int64"))
    within: np.ndarray = field(default_factory=lambda: np.zeros(2 * BUCKETS))
    stops: np.ndarray = field(default_factory=lambda: np.zeros((2 * BUCKETS, 2), "int64"))

    def openness(self, slots: list[int]) -> float:
        """The probability that a text with these closings (pairs of slots, most telling first) was cut there. The text
        itself is not counted."""
        at = np.asarray(slots).reshape(-1, 2)
        ends = np.maximum(self.ends[at].min(1) - 1, 0)
        cuts = self.within[at].min(1) * (self.cut * self.texts / self.places)
        found, weight = 0.5, 1.0
        for e, c in zip(ends[::-1], cuts[::-1]):
            found = (c + weight * found) / (max(e, c) + weight)
            weight = PRIOR
        return float(found)

    def after_stop(self, slots: list[int]) -> bool | None:
        """Whether a sentence goes on after this stopped word; null where as often as not. Ends of texts are not counted,
        as they may be cut."""
        ends, goes_on = self.stops[slots].min(0)
        return None if ends == goes_on else bool(goes_on > ends)

    def is_open(self, slots: list[int], word: list[int] | None, least: float) -> bool:
        """Whether a text with these closings was cut: by its last word if that has a full stop, else by the least
        probability."""
        known = None if word is None else self.after_stop(word)
        return self.openness(slots) > least if known is None else known


def learn(texts: DataFrame) -> Terminality:
    """The terminality of the texts of a table ``mark, text``, ``mark`` being the same for equal texts.

    Null and blank texts count for nothing; texts of any length are counted whole. Of equal texts one counts as an end.
    """
    out = Terminality()
    texts = texts.where("text IS NOT NULL").withColumn("text", bare("text")).where("text <> ''")
    line = texts.select(F.explode(F.split("text", r"[\r\n]++")).alias("line"))
    line = shaped(line, "line").withColumn("words", F.split("shape", " "))
    first = F.array_join(F.slice("words", 1, LINE_WORDS), " ")
    none = F.lit(None).cast("int")
    piece = lambda kind, text, more, n: F.struct(F.lit(kind).alias("kind"), text.alias("text"), more.alias("more"), *[x.alias(f"n{i}") for i, x in enumerate(n)])
    counts = written(
        line.select(
            F.explode(
                F.concat(
                    F.array(piece("line", first, F.size("words") > LINE_WORDS, [F.col(f"n{i}") for i in range(3)])),
                    F.transform(
                        F.when(F.size("words") > LINE_WORDS, F.slice(F.col("words"), F.lit(LINE_WORDS + 1), F.greatest(F.size("words") - LINE_WORDS, F.lit(0)))).otherwise(F.array().cast("array<string>")),
                        lambda w: piece("tail", w, F.lit(True), [none] * 3),
                    ),
                )
            ).alias("p")
        )
        .select("p.*")
        .where("text <> ''")
        .groupBy("kind", "text", "more")
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)])
    )
    # how many letters a sign of a shape stands for
    runs = [(F.length("text") - F.length(F.translate("text", s, ""))) * F.col("n") for s in "Aac"]
    told = counts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(3)], *[F.sum(r).alias(f"r{i}") for i, r in enumerate(runs)]).first()
    mean = [float((told[f"n{i}"] or 0) / (told[f"r{i}"] or 1)) or 1.0 for i in range(3)]
    sign = F.right("start", F.lit(1))
    weight = F.when(sign == "A", mean[0]).when(sign == "a", mean[1]).when(sign == "c", mean[2]).otherwise(1.0)
    starts = counts.select(
        "kind", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - F.when(F.col("more"), 0).otherwise(1)), lambda i: F.left(F.col("text"), i))).alias("start")
    ).where("start <> ''")
    places = written(
        starts.select(F.explode(_closings(F.col("kind"), F.col("start"))).alias("closing"), (F.col("n") * weight).alias("n"))
        .groupBy("closing").agg(F.sum("n").alias("n"))
    )
    ends = written(
        with_closings(texts, "text").select("mark", "closings")
        .groupBy("mark").agg(F.min("closings").alias("closings"))
        .select(F.explode("closings").alias("closing"))
        .groupBy("closing").agg(F.count(F.lit(1)).alias("n"))
    )

    def table(counted: DataFrame, into: np.ndarray) -> None:
        got = counted.select(F.explode(_slots(F.col("closing"))).alias("slot"), "n").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        into[got["slot"]] = got["n"]  # at most 2 * BUCKETS rows

    table(places, out.within)
    table(ends, out.ends)
    # signs: letters and digits are three classes, so that these are the punctuation marks and symbols of Unicode at most
    signs = places.withColumnRenamed("n", "places").join(ends, "closing", "left").where("startswith(closing, 'sign ')").na.fill(0).toPandas()
    out.texts = int(ends.where("startswith(closing, 'sign ')").agg(F.sum("n")).first()[0] or 0)
    out.places = float(signs["places"].sum()) or 1.0
    if out.texts and len(signs):
        # most places are within words and sentences, where no whole text ends: what ends there was cut
        rate = (signs["n"] / out.texts / (signs["places"] / out.places)).to_numpy()
        order = np.argsort(rate)
        reached = signs["places"].to_numpy()[order].cumsum()
        out.cut = float(min(1.0, rate[order][np.searchsorted(reached, reached[-1] / 2)]))

    def said(pattern: str, goes_on: int) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(pattern)), lambda w: F.struct(w.alias("word"), F.lit(goes_on).alias("k")))

    stopped = texts.select(F.explode(F.concat(said(_ENDS, 0), said(_GOES_ON, 1))).alias("s"))
    words = stopped.groupBy("s.word", "s.k").agg(F.count(F.lit(1)).alias("n")).where("word <> ''")
    got = words.select(F.explode(_slots(form(F.col("word")))).alias("slot"), "k", "n").groupBy("slot", "k").agg(F.sum("n").alias("n")).toPandas()
    out.stops[got["slot"], got["k"]] = got["n"]
    return out
