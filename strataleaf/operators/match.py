"""Each published section matched with what its source Act prints, compared, and labelled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions import scalars as S
from strataleaf.functions.normalize import normalize
from strataleaf.operators.compare import compared, similarity
from strataleaf.session import written

# The labels of cases. FETCH_ERROR is apart from ACT_NOT_ONLINE: not having looked is not having found nothing.
EXCLUDED = ("UNRECONSTRUCTABLE", "ACT_NOT_ONLINE", "FETCH_ERROR")
LABELS = (*EXCLUDED, "MATCH", "REPEALED_STUB", "RENUMBERED", "TARGET_RESOLUTION", "NORMALIZE", "MULTI_VERSION", "MULTI_ACT", "DIVERGENCE")


def label(matched: Column, published: Column, replayed: Column, candidates: Column, version_marker: Column, acts: Column) -> Column:
    """The label of a compared case; the first that applies counts."""
    return (
        F.when(F.coalesce(matched, F.lit(False)), "MATCH")
        .when(S.is_repeal_stub(published), "REPEALED_STUB")
        .when(candidates == 0, "TARGET_RESOLUTION")
        .when(S.only_alphanumeric(published) == S.only_alphanumeric(replayed), "NORMALIZE")
        .when((candidates > 1) | version_marker.isNotNull(), "MULTI_VERSION")
        .when(acts > 1, "MULTI_ACT")
        .otherwise("DIVERGENCE")
    )


def early_label(reconstructable: Column, online: Column, failed: Column, candidates: Column, repealed_here: Column, body: Column, source_line: Column) -> Column:
    """The label of a case that can't be compared, or null."""
    return (
        F.when(~reconstructable, "UNRECONSTRUCTABLE")
        .when(F.coalesce(failed, F.lit(False)), "FETCH_ERROR")
        .when(~F.coalesce(online, F.lit(False)), "ACT_NOT_ONLINE")
        .when(candidates > 0, F.lit(None))
        .when(repealed_here | S.is_repeal_stub(body), "REPEALED_STUB")
        .when(S.is_renumbered(source_line), "RENUMBERED")
        .otherwise("TARGET_RESOLUTION")
    )


def note(label_: Column, terminal: Column, citation: Column, blocks_in_act: Column, repealed_here: Column) -> Column:
    """What is told of a case that can't be compared."""
    return (
        F.when(label_ == "UNRECONSTRUCTABLE", "source line names no Public Act")
        .when(label_ == "FETCH_ERROR", F.format_string("P.A. %s could not be fetched", terminal))
        .when(label_ == "ACT_NOT_ONLINE", F.format_string("P.A. %s is not published", terminal))
        .when((label_ == "REPEALED_STUB") & repealed_here, F.format_string("the Act repeals this section: (%s rep.)", citation))
        .when(label_ == "REPEALED_STUB", "the section is a repeal tombstone")
        .when(label_ == "RENUMBERED", "the source line says that the section was renumbered")
        .when(blocks_in_act > 0, F.format_string("the Act does not print this citation (%d section blocks found in it)", blocks_in_act))
        .otherwise("no section blocks parsed out of the Act")
    )


def candidates_of(sections: DataFrame, act_blocks: DataFrame) -> DataFrame:
    """JN1, JN2, AG12: each section with how many blocks of its source Act have its citation, and what they do.

    ``sections``: ``case_idx, citation, pa_key`` and more; ``act_blocks``: ``pa_key, citation, pos, op_marker``. Blocks
    are counted per key before the join, so that it keeps one row for each section.
    """
    counted = act_blocks.groupBy("pa_key", "citation").agg(
        F.count_if(~F.col("op_marker").eqNullSafe("rep.")).alias("candidates_in_act"),
        F.bool_or(F.col("op_marker").eqNullSafe("new")).alias("added_by_this_act"),
        F.bool_or(F.col("op_marker").eqNullSafe("rep.")).alias("repealed_here"),
    )
    return sections.join(counted, ["pa_key", "citation"], "left").withColumns(
        {
            "candidates_in_act": F.coalesce("candidates_in_act", F.lit(0)).cast("long"),
            "added_by_this_act": F.coalesce("added_by_this_act", F.lit(False)),
            "repealed_here": F.coalesce("repealed_here", F.lit(False)),
        }
    )


def best_candidates(sections: DataFrame, act_blocks: DataFrame) -> DataFrame:
    """WN1: the block to compare each section with: ``case_idx, chosen``, sections without a candidate left out.

    A lone candidate is it. Of several, the first with the section's version marker; else the one most similar after
    normalisation, the first of equals. Similarity is only worked out for sections with several and no such marker.
    """
    blocks = act_blocks.where(~F.col("op_marker").eqNullSafe("rep."))
    entry = F.struct(F.col("b.pos").alias("pos"), F.col("b.body").alias("body"), F.col("b.pre_body").alias("pre_body"), F.col("b.version_marker").alias("version_marker"))
    on = (F.col("s.pa_key") == F.col("b.pa_key")) & (F.col("s.citation") == F.col("b.citation"))
    pairs = sections.alias("s").join(blocks.alias("b"), on).select(
        F.col("s.case_idx").alias("case_idx"),
        F.col("s.body").alias("body"),
        F.col("s.candidates_in_act").alias("n"),
        F.coalesce(F.col("s.version_marker") == F.col("b.version_marker"), F.lit(False)).alias("same_marker"),
        entry.alias("entry"),
    )
    joined = written(pairs)  # read thrice below; the join and its shuffles run once
    marked = joined.groupBy("case_idx").agg(F.min_by("entry", F.when(F.col("same_marker"), F.col("entry.pos"))).alias("marked"), F.max("n").alias("n"), F.bool_or("same_marker").alias("any_marked"))
    single = joined.where("n = 1").select("case_idx", F.col("entry").alias("chosen"))
    by_marker = marked.where("n > 1 AND any_marked").select("case_idx", F.col("marked").alias("chosen"))
    rest = joined.where("n > 1").join(marked.where("any_marked").select("case_idx"), "case_idx", "left_anti")
    # of candidates with one text only the first can win, so that only different texts are scored, and none equal to the section's
    norms = rest.select("case_idx", "entry", normalize(F.col("body")).alias("a"), normalize(F.col("entry.body")).alias("b"))
    texts = norms.groupBy("case_idx", "a", "b").agg(F.min_by("entry", "entry.pos").alias("entry"))
    scored = texts.withColumn("score", F.when(F.col("a") == F.col("b"), 1.0).otherwise(similarity(F.when(F.col("a") != F.col("b"), F.col("a")), F.col("b"))))
    by_score = scored.groupBy("case_idx").agg(F.max_by("entry", F.struct(F.col("score"), -F.col("entry.pos"))).alias("chosen"))
    return single.unionByName(by_marker).unionByName(by_score)


def single_hop(sections: DataFrame, acts: DataFrame, act_blocks: DataFrame) -> DataFrame:
    """One labelled case for each published section.

    :param sections: ``case_idx`` (unique), ``citation`` (struct), ``body``, ``version_marker``, ``source`` (struct).
    :param acts: ``pa_key`` (unique), ``online``, ``failed``, ``blocks_in_act``, ``strike_spans``, ``insert_spans``.
    :param act_blocks: ``pa_key, citation, pos, body, pre_body, version_marker, op_marker``; ``pos`` orders an Act's blocks.
    """
    from strataleaf.operators import sections as P

    s = sections.withColumns(
        {"terminal_pa": P.terminal_act(F.col("source")), "acts": F.size("source.pa_numbers"), "reconstructable": P.is_reconstructable(F.col("source"))}
    ).withColumn("pa_key", S.padded_act(F.col("terminal_pa")))
    s = candidates_of(s.join(acts, "pa_key", "left"), act_blocks)
    s = s.withColumn("early", early_label(F.col("reconstructable"), F.col("online"), F.col("failed"), F.col("candidates_in_act"), F.col("repealed_here"), F.col("body"), F.col("source.raw")))
    chosen = best_candidates(s.where("early IS NULL"), act_blocks)
    joined = s.join(chosen, "case_idx", "left")
    made = compared(joined, S.citation_text(F.col("citation")), F.col("body"), F.col("chosen.body"))
    full = label(F.col("normalized_match"), F.col("published_norm"), F.col("replayed_norm"), F.col("candidates_in_act"), F.col("version_marker"), F.col("acts"))
    carried = normalize(F.col("chosen.pre_body")) != normalize(F.col("chosen.body"))
    labelled = made.withColumn("classification", F.coalesce("early", full))
    return labelled.select(
        "case_idx",
        S.citation_text(F.col("citation")).alias("citation"),
        F.col("source.raw").alias("source_line"),
        "terminal_pa",
        F.col("source.pa_numbers").alias("all_pas"),
        S.stratum(F.col("source.pa_numbers")).alias("stratum"),
        F.char_length("body").alias("published_chars"),
        F.char_length("chosen.body").alias("replayed_chars"),
        "candidates_in_act",
        "added_by_this_act",
        F.coalesce(carried, F.lit(False)).alias("carried_amendment_markup"),
        F.col("version_marker").alias("published_version_marker"),
        F.col("chosen.version_marker").alias("matched_version_marker"),
        F.col("strike_spans").alias("strike_spans_in_act"),
        F.col("insert_spans").alias("insert_spans_in_act"),
        F.coalesce("exact_match", F.lit(False)).alias("exact_match"),
        F.coalesce("normalized_match", F.lit(False)).alias("normalized_match"),
        "similarity",
        "classification",
        F.when(F.col("early").isNotNull(), note(F.col("early"), F.col("terminal_pa"), S.citation_text(F.col("citation")), F.coalesce("blocks_in_act", F.lit(0)), F.col("repealed_here"))).alias("note"),
        "changes",
        "diff",
    )


def latest_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which must settle ties.

    One aggregate for each column, so that columns that are not used later are neither read nor shuffled; they combine
    before the shuffle, so that a hot key is one row for each task.
    """
    last = F.struct(*order)
    kept = [F.max_by(F.col(f"`{c}`"), last).alias(c) for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(*kept).select(*[F.col(f"`{c}`") for c in rows.columns])
