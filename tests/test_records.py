from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from strataleaf.operators import ledger as L
from strataleaf.operators import match as M
from strataleaf.operators import metrics as G
from strataleaf.operators import ordered as O
from strataleaf.operators import sampling as A
from strataleaf.operators import temporal as V
from strataleaf.operators.sections import source_line
from strataleaf.plans import records
from strataleaf.sources import index_pages, store
from strataleaf.streaming import ledger_stream as T

T0 = datetime(2031, 1, 1)
CIT = "struct<chapter: string, act: string, section: string>"


# --- matching ---


def test_label_precedence(spark):
    rows = [
        (True, "Sec. 1. (Repealed).", "x", 0, "m", 2, "MATCH"),
        (False, "Sec. 1. (Repealed).", "x", 0, "m", 2, "REPEALED_STUB"),
        (False, "a b", "c", 0, None, 1, "TARGET_RESOLUTION"),
        (False, "a, b", "a b", 2, "m", 2, "NORMALIZE"),
        (False, "An Act", "an Act", 1, None, 1, "DIVERGENCE"),
        (False, "a", "b", 2, None, 1, "MULTI_VERSION"),
        (False, "a", "b", 1, "m", 1, "MULTI_VERSION"),
        (False, "a", "b", 1, None, 2, "MULTI_ACT"),
        (None, "a", "b", 1, None, 0, "DIVERGENCE"),
    ]
    df = spark.createDataFrame(rows, "m boolean, p string, r string, n int, v string, a int, want string")
    assert df.where(M.label(F.col("m"), F.col("p"), F.col("r"), F.col("n"), F.col("v"), F.col("a")) != F.col("want")).count() == 0


def test_single_hop(spark):
    c = lambda s: Row(chapter="5", act="1", section=s)
    sections = spark.createDataFrame(
        [
            (1, c("1"), "Sec. 1. Same words.", None, "P.A. 100-1"),
            (2, c("2"), "Sec. 2. Words.", None, "Laws 1961, p. 5"),
            (3, c("3"), "Sec. 3. Words.", None, "P.A. 90-9"),
            (4, c("4"), "Sec. 4. Words.", "(Text of Section after)", "P.A. 100-1"),
            (5, c("5"), "Sec. 5. alpha beta gamma", None, "P.A. 99-1; 100-1"),
            (6, c("6"), "Sec. 6. (Repealed).", None, "P.A. 100-1"),
            (7, c("7"), "Sec. 7. x", None, "P.A. 100-1. Renumbered by P.A. 100-1"),
            (8, c("8"), "Sec. 8. x", None, "P.A. 101-5"),
            (9, c("9"), "Sec. 9. x", None, "P.A. 100-1"),
        ],
        f"case_idx int, citation {CIT}, body string, version_marker string, raw string",
    ).withColumn("source", source_line(F.col("raw")))
    acts = spark.createDataFrame([("100-0001", True, False, 7, 3, 4), ("101-0005", True, True, 0, 0, 0)], "pa_key string, online boolean, failed boolean, blocks_in_act int, strike_spans int, insert_spans int")
    blocks = spark.createDataFrame(
        [
            ("100-0001", c("1"), 1, "Sec. 1.  Same words.", "Sec. 1. Older words.", None, "new"),
            ("100-0001", c("4"), 2, "Sec. 4. Before.", "x", "(Text of Section before)", None),
            ("100-0001", c("4"), 3, "Sec. 4. After.", "x", "(Text of Section after)", None),
            ("100-0001", c("5"), 4, "Sec. 5. alpha beta delta", "x", None, None),
            ("100-0001", c("5"), 5, "Sec. 5. omega", "x", None, None),
            ("100-0001", c("5"), 6, "Sec. 5. alpha beta delta", "x", None, None),
            ("100-0001", c("6"), 7, "", "", None, "rep."),
        ],
        f"pa_key string, citation {CIT}, pos int, body string, pre_body string, version_marker string, op_marker string",
    )
    got = {r.case_idx: r for r in M.single_hop(sections, acts, blocks).collect()}
    assert {i: r.classification for i, r in got.items()} == {
        1: "MATCH", 2: "UNRECONSTRUCTABLE", 3: "ACT_NOT_ONLINE", 4: "MULTI_VERSION", 5: "MULTI_VERSION", 6: "REPEALED_STUB", 7: "RENUMBERED", 8: "FETCH_ERROR", 9: "TARGET_RESOLUTION",
    }
    assert got[1].added_by_this_act and got[1].carried_amendment_markup and not got[1].exact_match and got[1].strike_spans_in_act == 3
    assert got[4].matched_version_marker == "(Text of Section after)"
    assert got[5].replayed_chars == len("Sec. 5. alpha beta delta") and got[5].changes == ["replace 'gamma' -> 'delta'"]
    assert got[9].note.startswith("the Act does not print") and got[1].note is None


def test_single_hop_cases_count_what_acts_print(spark, tmp_path):
    source = "struct<raw: string, pa_numbers: array<string>, has_non_pa_provenance: boolean>"
    c = lambda s: Row(chapter="5", act="1", section=s)
    src = lambda t: Row(raw=t, pa_numbers=[], has_non_pa_provenance=False)
    spark.createDataFrame(
        [
            (1, 1, T0, c("1"), 1, "a <strike>b</strike> <u>c</u> <s>d</s>", "a c", None, None, src("P.A. 100-1")),
            (2, 2, T0, c("2"), 1, "<ins>x</ins>", "x", None, None, src("P.A. 90-1; 100-1")),
            (3, 2, T0, c("3"), 1, "<u>y</u>", "y", None, None, src("P.A. 101-1")),
            (4, 8, T0, c("9"), 1, "z", "z", None, None, src("P.A. 100-1")),
            (5, 8, T0, c("8"), 1, "z", "z", None, None, src("P.A. 102-1")),
        ],
        f"block_id bigint, snapshot_no int, seen_at timestamp, citation {CIT}, ver int, raw string, body string, version_marker string, op_marker string, source {source}",
    ).write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([("P.A. 100-1", None), ("102-1", None)], "pa_number string, withdrawn_at timestamp").write.parquet(str(tmp_path / "enactments.parquet"))
    got = {r.case_idx: r for r in records.single_hop_cases(spark, str(tmp_path)).collect()}
    assert {r.classification for r in got.values()} == {"TARGET_RESOLUTION"}
    assert (got[4].strike_spans_in_act, got[4].insert_spans_in_act) == (2, 2) and "(2 section blocks found in it)" in got[4].note
    assert (got[5].strike_spans_in_act, got[5].insert_spans_in_act, got[5].note) == (0, 0, "no section blocks parsed out of the Act")


# --- sampling ---


def test_ranks_over_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.col("id"))
    got = A.ranked(rows, ["g"], ["id"])
    bad = got.withColumn("want", F.expr("row_number() over (partition by g order by id) - 1")).where("want <> rank")
    assert got.count() == 3000 and bad.count() == 0 and got.where("g = 'hot' AND size <> 2000").count() == 0


def test_carrying_along_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), F.col("id"), F.when(F.col("id") % 700 == 1, F.col("id")).alias("v"))
    got = O.with_last_before(rows, ["g"], ["id"], F.col("v"), "known")
    want = F.expr("last(v, true) over (partition by g order by id rows between unbounded preceding and 1 preceding)")
    assert got.count() == 4000 and got.withColumn("want", want).where("NOT (want <=> known)").count() == 0


def test_take_evenly(spark):
    df = spark.createDataFrame([(n, k) for n in (0, 1, 3, 7, 100) for k in (0, 1, 3, 7, 10)], "size int, wanted int")
    ranks = df.select("size", "wanted", F.explode(F.sequence(F.lit(0), F.greatest("size", F.lit(1)) - 1)).alias("rank")).where("size > 0")
    got = {}
    for r in ranks.where(A.evenly(F.col("rank"), F.col("size"), F.col("wanted"))).collect():
        got.setdefault((r.size, r.wanted), set()).add(r.rank)
    for n in (1, 3, 7, 100):
        for k in (0, 1, 3, 7, 10):
            want = set() if k == 0 else set(range(n)) if k >= n else {int(i * n / k) for i in range(k)}
            assert got.get((n, k), set()) == want


def test_queue_of_all_tiers(spark):
    known = [("5 ILCS 1/ A", 9, "5", "1"), ("5 ILCS 2/ B", 4, "5", "2"), ("30 ILCS 1/ C", 1, "30", "1"), ("7 ILCS 1/ D", 2, "7", "1"), ("5 ILCS 3/ E", 3, "5", "3"), ("no key", 0, None, None)]
    known = spark.createDataFrame(known, "act_label string, seq long, chapter string, act string")
    sample, cited = spark.createDataFrame([("5", "1")], "chapter string, act string"), spark.createDataFrame([("101-0003",), ("099-0001",)], "pa_key string")
    got = [(r.tier, r.label) for r in records.queue_of(known, sample, cited, ["092-0001", "090-0001"]).orderBy("place").collect()]
    assert got == [
        (0, "P.A. 099-0001"), (0, "P.A. 101-0003"), (1, "floor probe P.A. 092-0001"), (1, "floor probe P.A. 090-0001"),
        (2, "5 ILCS 3/ E"), (2, "5 ILCS 2/ B"), (3, "7 ILCS 1/ D"), (3, "30 ILCS 1/ C"), (3, "no key"),
    ]


def test_all_tiers_and_acts_of_the_tables(spark):
    small = "/root/testdata/sf0.001"
    named = {(r.chapter, r.act) for r in records.labels(spark, small).collect()}
    assert {(r.chapter, r.act) for r in records.all_resolved_acts(spark, small).collect()} == named
    assert {r.tier for r in records.crawl_queue(spark, "/root/testdata/sf0.01").collect()} == {0, 1, 2, 3}


# --- metrics ---


def test_headline_and_tallies(spark):
    rows = [(i, "A", "recent", cls, m, m, i % 2 == 0, False, "100-1") for i, (cls, m) in enumerate([("MATCH", True)] * 3 + [("DIVERGENCE", False), ("ACT_NOT_ONLINE", False), ("REPEALED_STUB", False)])]
    df = spark.createDataFrame(rows, "case_idx int, act_label string, stratum string, classification string, normalized_match boolean, exact_match boolean, carried_amendment_markup boolean, added_by_this_act boolean, terminal_pa string")
    h = G.headline(df).first()
    assert (h.sampled, h.attempted, h.matched, h.not_online, h.structural) == (6, 5, 3, 1, 1)
    assert (h.rate_fixed, h.rate_attempted, h.rate_reachable) == (0.5, 0.6, 0.75)
    t = {(r.grouping, r.value): (r.attempted, r.matched, r.excluded) for r in G.tallies(df, "act_label", "stratum").collect()}
    assert t == {("act_label", "A"): (5, 3, 1), ("stratum", "recent"): (5, 3, 1), ("all", None): (5, 3, 1)}
    empty = G.headline(df.limit(0)).first()
    assert empty.sampled == 0 and empty.rate_fixed == 0.0 and empty.wilson_low is None


def test_floor_probe_and_progress(spark):
    probes = spark.createDataFrame([("092-0001", 1), ("093-0001", 2), ("094-0001", 3), ("099-0001", 4)], "pa string, seq int")
    mirror = spark.createDataFrame([("092-0001", True), ("093-0001", True), ("094-0001", False)], "pa string, ok boolean")
    r = G.floor_probe(probes, mirror, "pa", F.col("ok")).first()
    assert r.probed == 3 and r.disagreements == ["092-0001 is available, but predates the 93rd GA", "094-0001 is unavailable, but is at or above the 93rd GA"]
    p = G.progress(spark.createDataFrame([(0, 0, 0.0), (5, 10, 50.0)], "done int, total int, elapsed_s double")).collect()
    assert (p[0].rate, p[0].part, p[0].to_go_s) == (0.0, 0.0, None) and (p[1].rate, p[1].part, p[1].to_go_s) == (0.1, 0.5, 50.0)


# --- the mirror, batch and stream ---

LOG = [(1, "u", 200, "x", T0), (2, "u", 304, None, T0 + timedelta(1)), (3, "u", 200, "x", T0 + timedelta(2)), (4, "u", 200, "y", T0 + timedelta(3)), (5, "u", 404, None, T0 + timedelta(4)), (6, "u", 200, "y", T0 + timedelta(5)), (7, "v", 404, None, T0), (8, None, 200, "x", T0)]
WANT = {1: "first", 2: "revalidated", 3: "revalidated", 4: "changed", 5: "missing", 6: "revalidated", 7: "missing"}


def test_refreshes_batch(spark):
    log = spark.createDataFrame(LOG, T.LOG)
    got = L.refreshes(log, F.col("url"), F.col("fetched_at"), F.col("status"), F.col("sha256"), ["fetch_id"])
    assert {r.fetch_id: r.refresh for r in got.collect()} == WANT


def test_refreshes_stream_resumes(spark, tmp_path):
    log, out, at = f"{tmp_path}/log", f"{tmp_path}/out", f"{tmp_path}/at"
    spark.createDataFrame(LOG[:3], T.LOG).write.mode("append").parquet(log)
    T.run_available(T.refresh_stream(T.read_log(spark, log)), out, at)
    spark.createDataFrame(LOG[3:], T.LOG).write.mode("append").parquet(log)
    T.run_available(T.refresh_stream(T.read_log(spark, log)), out, at)
    T.run_available(T.refresh_stream(T.read_log(spark, log)), out, at)  # nothing new
    assert {r.fetch_id: r.refresh for r in spark.read.parquet(out).collect()} == WANT


def test_queue_grows_once(spark, tmp_path):
    queue, found = f"{tmp_path}/queue", f"{tmp_path}/found"
    spark.createDataFrame([("a", 1)], "k string, tier int").write.parquet(queue)
    spark.createDataFrame([("a", 4), ("b", 4), ("b", 4)], "k string, tier int").write.parquet(found)
    T.append_found(spark.readStream.schema("k string, tier int").parquet(found), queue, f"{tmp_path}/at", "k")
    assert sorted(r.k for r in spark.read.parquet(queue).collect()) == ["a", "b"]
    q = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.k for r in L.remaining(q, spark.createDataFrame([("a",)], "k string"), "k").collect()] == [None]
    assert [r.k for r in L.appended(q, spark.createDataFrame([("a",), ("c",), ("c",)], "k string"), "k").collect()] == ["c"]


def test_delay_store_and_stops(spark):
    log = spark.createDataFrame([(1, "h", T0), (2, "h", T0 + timedelta(seconds=4)), (3, "h", T0 + timedelta(seconds=20)), (4, "i", T0)], "id int, host string, at timestamp")
    assert [(r.id, r.gap_s) for r in L.too_soon(log, F.col("host"), F.col("at"), ["id"]).collect()] == [(2, 4.0)]
    pages = spark.createDataFrame([("u", "d1", T0), ("v", "d1", T0), ("w", None, T0)], "u string, d string, at timestamp")
    assert [(r.sha256, r.urls, r.prefix) for r in L.stored_once(pages, F.col("d"), F.col("at"), F.col("u")).collect()] == [("d1", 2, "d1")]
    stops = spark.createDataFrame([(1, 2, 9.0, True, True), (2, 2, 9.0, True, False), (1, 2, 9.0, True, False), (1, 2, 1.0, True, False), (1, 2, 1.0, None, None)], "d int, t int, e double, f boolean, x boolean")
    got = [r[0] for r in stops.select(L.stop_reason(F.col("d"), F.col("t"), F.col("e"), F.lit(5.0), F.col("f"), F.col("x"))).collect()]
    assert got == ["throttled", "drained", "deadline", "stop file", "running"]


# --- sources and sinks ---


def test_index_pages(spark):
    html = 'x <a href="/Legislation/ILCS/Acts?ChapterID=2&ChapterNumber=5&Chapter= GENERAL ">g</a><a href="/Legislation/ILCS/Acts?ChapterID=2&ChapterNumber=6&Chapter=Again">g</a>'
    acts = '<a href="/Legislation/ILCS/Articles?ActID=7&x=1" class="a">5&nbsp;ILCS 70/\n <b>Statute</b></a> <a href="/Legislation/ILCS/Articles?ActID=7">later</a>'
    df = spark.createDataFrame([(1, html), (2, acts), (3, None)], "n int, p string")
    assert [tuple(r) for r in index_pages.chapters(df, F.col("n"), F.col("p")).collect()] == [("2", "5", "GENERAL")]
    assert [tuple(r) for r in index_pages.acts(df, F.col("n"), F.col("p")).collect()] == [("7", "5 ILCS 70/ Statute")]


def test_fallback_source(spark):
    rows = [("A", 1, "no sections", True), ("A", 2, "(5 ILCS 1/1) Sec. 1. x", False), ("B", 3, "(5 ILCS 2/1) x", True), ("B", 4, "(5 ILCS 2/9) y", False), ("C", 5, "(5 ILCS 3/Art. 1 heading)", True), (None, 6, "(5 ILCS 2/9) y", True)]
    df = spark.createDataFrame(rows, "act string, id int, text string, main boolean")
    got = index_pages.blocks_with_fallback(df, F.col("act"), "id", F.col("text"), F.col("main"))
    assert sorted((r.act_key, r.doc_id) for r in got.collect()) == [("A", 2), ("B", 3)]


def test_round_trips(spark, tmp_path):
    q = spark.createDataFrame([(1, "k", "u", 0, "l", "a", "c", None)], store.QUEUE)
    store.write_queue(q, f"{tmp_path}/q")
    store.write_queue(q, f"{tmp_path}/q")
    assert store.read_queue(spark, f"{tmp_path}/q").collect() == q.collect()
    (tmp_path / "r.json").write_text('{"summary": {"n": 2},\n "cases": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}')
    assert [(r.a, r.b) for r in store.read_results(spark, f"{tmp_path}/r.json").orderBy("a").collect()] == [(1, "x"), (2, None)]
    cases = spark.createDataFrame([(1, "5 ILCS 1/1", "DIVERGENCE", "90-1", "why", ["c1"], "d"), (2, "x", "MATCH", None, None, [], ""), (3, "y", "ACT_NOT_ONLINE", None, None, [], None)], "case_idx int, citation string, classification string, terminal_pa string, note string, changes array<string>, diff string")
    lines = store.mismatch_lines(cases)
    store.write_text_report(lines, ["case_idx"], "line", f"{tmp_path}/m")
    assert spark.read.text(f"{tmp_path}/m", wholetext=True).first()[0] == "=== 5 ILCS 1/1 [DIVERGENCE] P.A. 90-1\nwhy\n  * c1\nd\n"
    store.write_results(cases, {"classes": G.class_counts(cases)}, f"{tmp_path}/res")
    assert spark.read.parquet(f"{tmp_path}/res/classes").count() == 3
    store.write_run_summary(G.class_counts(cases).limit(1), f"{tmp_path}/last")
    assert spark.read.json(f"{tmp_path}/last").count() == 1
    store.write_bodies(spark.createDataFrame([("x",), ("x",), (None,)], "b string"), F.col("b"), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 1
    table = store.markdown_table(G.class_counts(cases), ["classification", "n"], [F.col("classification")])
    assert [r.line for r in table.orderBy("line_no").collect()][0] == "| ACT_NOT_ONLINE | 1 |"


# --- versions in time ---


def test_temporal(spark):
    d = lambda n: datetime(2031, 1, n)
    v = spark.createDataFrame(
        [(1, "p", d(1), d(5), d(1), None, "replayed"), (2, "p", d(5), None, d(1), None, "replayed"), (3, "p", d(4), None, d(1), None, "replayed"), (4, "p", d(4), None, d(1), None, "observed")],
        "id int, provision string, valid_from timestamp, valid_to timestamp, known_from timestamp, known_to timestamp, origin string",
    )
    at = lambda n: F.lit(d(n))
    assert [r.id for r in V.as_of(v, at(5), at(2)).orderBy("id").collect()] == [2, 3]
    assert V.as_of(v, at(5), at(1) - F.expr("INTERVAL 1 DAY")).count() == 0
    assert sorted((r.a, r.b) for r in V.overlaps(v, ["provision", "origin"], "id").collect()) == [(1, 3), (2, 3)]
    assert sorted((r.id, r.holds) for r in V.overlapped(v, ["provision", "origin"], "id").collect()) == [(2, 3), (3, 1)]
    s = spark.createDataFrame([("p", 1, "add", "a"), ("p", 2, "replace", None), ("q", 1, "add", "a"), ("q", 2, "repeal", "r"), ("r", 1, "repeal", None), ("r", 2, "replace", "b")], "k string, n int, op string, body string")
    assert sorted((r.k, r.replayed, r.stands, r.agrees) for r in V.replayed(s, ["k"], "n", "op", "body", 2).collect()) == [("p", "a", None, False), ("q", None, "r", False), ("r", "b", "b", True)]
    e = spark.createDataFrame([(1, "p", d(1), d(3), 7, "x"), (2, "p", d(2), d(4), 7, "y"), (3, "p", d(2), d(4), 7, "y"), (4, "p", d(20), d(21), 7, "z"), (5, "p", d(1), d(3), 8, "q")], "id int, provision string, begins timestamp, ends timestamp, base int, result string")
    assert sorted((r.a, r.b) for r in V.contested(e, "provision", "id", 3).collect()) == [(1, 2), (1, 3)]
    ops = spark.createDataFrame([("new", None, False), ("rep.", None, False), (None, "x", False), (None, None, True), (None, None, None)], "m string, r string, p boolean")
    assert [r[0] for r in ops.select(V.typed_operation(F.col("m"), F.col("r"), F.col("p"))).collect()] == ["add", "repeal", "renumber", "text_replace", "replace"]
    f = spark.createDataFrame([("p", 1, "s1", ["a", "b"]), ("p", 2, "s2", ["a", "c", ""])], "k string, ver int, src string, cl array<string>")
    assert sorted((r.since, r.source) for r in V.first_appearances(f, ["k"], "ver", F.col("cl"), "src").collect()) == [(1, "s1"), (1, "s1"), (2, "s2")]


def test_overlaps_of_a_hot_key_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    d = lambda n: T0 + timedelta(days=n)
    rows = []
    for i in range(400):
        a, b = rng.randrange(400), rng.randrange(400)
        rows.append((i, "hot" if i % 2 else f"k{i % 7}", d(a), None if rng.random() < 0.05 else d(a + rng.randrange(20)), d(b), None if rng.random() < 0.2 else d(b + rng.randrange(60)), "o"))
    v = spark.createDataFrame(rows, "id int, provision string, valid_from timestamp, valid_to timestamp, known_from timestamp, known_to timestamp, origin string")
    far = datetime(9999, 1, 1)
    want = {
        (x[0], y[0])
        for x in rows
        for y in rows
        if x[0] < y[0] and x[1] == y[1] and x[2] < (y[3] or far) and y[2] < (x[3] or far) and x[2] != x[3] and y[2] != y[3] and x[4] < (y[5] or far) and y[4] < (x[5] or far)
    }
    got = [(r.a, r.b) for r in V.overlaps(v, ["provision"], "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
