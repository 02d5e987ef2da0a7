"""Shared plan shapes against brute force, and the shape of the plans themselves."""

from __future__ import annotations

import random
import re
import statistics
import sys
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidepanel.functions import alias_key, fold_marks, group_key, label_key
from tidepanel.functions.normalize import GROUP_SEPARATORS, LABEL_SEPARATORS, WHITESPACE, key_of
from tidepanel.operators import tagging
from tidepanel.operators.select import ordered_page
from tidepanel.plans import (
    GramIndex,
    as_of_join,
    count_table,
    gram_counts,
    grouped_order_statistics,
    phrases,
    posting_lists,
    substring,
    substring_pairs,
    table_medians,
    top_per_group,
    with_rank,
)
from tidepanel.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_median_equals_sorting(spark):
    draw = random.Random(7)
    rows = [("hot", draw.choice([draw.gauss(0, 10), 1.0, -3.5])) for _ in range(30_000)]
    rows += [("even", float(i)) for i in range(100)] + [("odd", float(i * i)) for i in range(41)]
    rows += [("one", 4.0), ("two", 1.0), ("two", 2.0), ("same", 5.0), ("same", 5.0), ("same", 5.0)]
    rows += [("null", None), ("some", None), ("some", 3.0), ("signs", -0.0), ("signs", 0.0), ("signs", -1e-300)]
    rows += [("wide", v) for v in (-1e308, -1e-308, 5e-324, 1e308, float("inf"), -float("inf"))]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(8)
    result = grouped_order_statistics(
        frame, ["g"], "v", [F.count("v").alias("n"), F.max("v").alias("top")]
    )
    got = {r["g"]: r for r in result.collect()}
    for group in {g for g, _ in rows}:
        values = [v for g, v in rows if g == group and v is not None]
        expected = statistics.median(values) if values else None
        assert got[group]["median"] == expected
        assert (got[group]["n"], got[group]["top"]) == (len(values), max(values, default=None))


def test_medians_of_a_count_table(spark):
    draw = random.Random(5)
    rows = [("hot", draw.randint(0, 3), draw.choice([None, 1.5, 2.5, draw.random()])) for _ in range(5_000)]
    rows += [("few", 1, 2.0), ("none", 0, None), ("zero", 0, -0.0), ("zero", 0, 0.0)]
    frame = spark.createDataFrame(rows, "g string, p int, v double").repartition(8)
    table = count_table(frame, ["g"], "v", ["p"], {"most": F.max("p")})
    got = {r["g"]: r["median"] for r in table_medians(table, ["g"], "v").collect()}
    known = {g: [v for h, _, v in rows if h == g and v is not None] for g in ("hot", "few", "zero", "none")}
    assert got == {g: statistics.median(v) for g, v in known.items() if v}
    assert table.agg(F.sum("__rows")).first()[0] == len(rows)
    empty = count_table(frame.limit(0), ["g"], "v")
    assert empty.count() == table_medians(empty, ["g"], "v").count() == 0


def test_ranks_equal_sorting(spark):
    draw = random.Random(9)
    groups = ["hot"] * 8 + ["cold", None, "one"]
    rows = [(draw.choice(groups[:-1]), draw.randint(0, 40), i) for i in range(6000)] + [("one", 5, -1)]
    frame = spark.createDataFrame(rows, "g string, v int, id int").repartition(8)
    order = [F.desc("v"), F.asc("id")]
    got = {tuple(r) for r in with_rank(frame, ["g"], order).collect()}
    whole = {tuple(r) for r in with_rank(frame, [], order, "place").collect()}
    expected = set()
    for group in set(groups):
        ranked = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        expected |= {(*r, i) for i, r in enumerate(ranked, 1)}
    assert got == expected
    everything = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert whole == {(*r, i) for i, r in enumerate(everything, 1)}
    for top, skip in ((None, 5990), (None, 7000), (20, 9_995), (10, 3), (9_999, 100), (None, 0)):
        page = [tuple(r) for r in ordered_page(frame, order, top, skip).collect()]
        assert page == everything[skip:][:top], (top, skip)
    assert with_rank(frame.limit(0), ["g"], order).count() == with_rank(frame.limit(0), [], order).count() == 0


def test_as_of_equals_searching(spark):
    draw = random.Random(13)
    facts = [("hot", 1, p, float(p)) for p in draw.sample(range(20_000), 6000)]
    facts += [(draw.choice("ab"), draw.randint(0, 2), p, -p / 2) for p in range(0, 300, 7)] + [("x", 1, None, 1.0)]
    facts = list({f[:3]: f for f in facts}.values())
    asks = [("hot", 1, draw.randint(-50, 21_000), i) for i in range(3000)]
    asks += [(draw.choice(["a", "b", "c", "x", None]), draw.choice([0, 1, None]), draw.choice([None, 5, 40, 299]), i)
             for i in range(200)] + [("hot", 1, 500, -1)] * 3
    left = spark.createDataFrame(asks, "g string, h int, p int, id int").repartition(8)
    right = spark.createDataFrame(facts, "g string, h int, p int, v double").repartition(8)
    got = Counter(map(tuple, as_of_join(left, right, ["g", "h"], "p", ["v"], "found").collect()))
    series = {}
    for g, h, p, v in facts:
        if p is not None:
            series.setdefault((g, h), []).append((p, v))
    expected = Counter()
    for g, h, p, i in asks:
        before = [f for f in series.get((g, h), []) if p is not None and f[0] <= p]
        expected[(g, h, p, i, *max(before, default=(None, None)))] += 1
    assert got == expected
    assert as_of_join(left.limit(0), right, ["g", "h"], "p", ["v"], "found").count() == 0
    assert as_of_join(left, right.limit(0), ["g", "h"], "p", ["v"], "found").where("found is not null").count() == 0


def test_pages_behind_an_offset_have_no_single_task(spark):
    frame = spark.range(50_000).repartition(8)
    for top in (None, 9_000):
        plan = ordered_page(frame, [F.col("id")], top, 20_000)._jdf.queryExecution().executedPlan().toString()
        assert "Limit" not in plan and "SinglePartition" not in plan


def test_substring_pairs_equal_nested_loop(spark):
    draw = random.Random(11)
    alphabet = "abé %_0"
    texts = {i: "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30))) for i in range(300)}
    needles = {"".join(draw.choice(alphabet) for _ in range(draw.randint(1, 12))) for _ in range(120)}
    needles |= {texts[1][:10], texts[2], "not there", "aaaaaaaaaaaaaaaaaaaaaa"} - {""}
    text_frame = spark.createDataFrame(list(texts.items()), "id int, t string")
    needle_frame = spark.createDataFrame([(n,) for n in needles], "needle string")
    for sizes in ((1,), (1, 3), (1, 2, 4, 8)):
        for blank in (False, True):
            asked = needle_frame.union(spark.createDataFrame([("",)], "needle string"))
            pairs = substring_pairs(text_frame, "t", ["id"], asked, sizes=sizes, blank=blank).collect()
            got = [(r["needle"], r["id"]) for r in pairs]
            assert len(got) == len(set(got))
            wanted = needles | ({""} if blank else set())
            assert set(got) == {(n, i) for n in wanted for i, t in texts.items() if n in t}
    assert substring_pairs(text_frame, "t", ["id"], needle_frame.limit(0)).count() == 0


def test_keys_are_made_by_many_tasks(spark):
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert QUERIES["n1_lookup_keys"](spark, SMALL).rdd.getNumPartitions() == tasks


@pytest.mark.parametrize("k", [1, 30, 1500])
def test_top_k_equals_sorting(spark, k):
    draw = random.Random(3)
    rows = [("hot" if draw.random() < 0.7 else "cold", draw.randint(0, 50), i) for i in range(4000)]
    frame = spark.createDataFrame(rows, "g string, v int, id int")
    got = {tuple(r) for r in top_per_group(frame, ["g"], [F.desc("v"), F.asc("id")], k, ["id"], "rank").collect()}
    expected = set()
    for group in ("hot", "cold"):
        ranked = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))[:k]
        expected |= {(*r, i) for i, r in enumerate(ranked, 1)}
    assert got == expected


def test_texts_are_dealt_out_before_they_are_taken_apart(spark):
    texts = spark.createDataFrame([(i, f"text number {i}") for i in range(200)], "id int, text string").coalesce(1)
    needles = spark.createDataFrame([("number 1",), ("17",)], "needle string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert posting_lists(texts, "text", ["id"]).rdd.getNumPartitions() == tasks
    # No side of the last join, that of grams, is broadcast, small as the texts may seem.
    plan = substring_pairs(texts, "text", ["id"], needles)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan.partition("Join")[0] + plan.partition("Join")[1]


def test_indexed_grams_equal_taking_texts_apart(spark):
    draw = random.Random(17)
    texts = {i: "".join(draw.choice("abc é") for _ in range(draw.randint(0, 20))) for i in range(200)}
    needles = sorted({"".join(draw.choice("abc é") for _ in range(draw.randint(1, 9))) for _ in range(80)} | {""})
    frame = spark.createDataFrame(list(texts.items()), "id int, t string")
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    lists = posting_lists(frame, "t", ["id"])
    index = GramIndex(lists, gram_counts(lists))
    for blank in (False, True):
        pairs = substring_pairs(frame, "t", ["id"], asked, blank=blank, index=index).collect()
        assert sorted((r["needle"], r["id"]) for r in pairs) == sorted(
            (n, i) for n in needles for i, t in texts.items() if n in t and (n or blank))


@pytest.mark.parametrize("buckets", [substring.BUCKETS, 5])
def test_only_wanted_grams_of_an_index_are_shuffled(spark, monkeypatch, buckets):
    monkeypatch.setattr(substring, "BUCKETS", buckets)
    texts = spark.createDataFrame([(i, f"text number {i} of many") for i in range(400)] + [(None, "17"), (3, None)], "id int, t string")
    asked = spark.createDataFrame([("number 17 ",), ("17",), ("none",), ("",)], "needle string")
    lists = posting_lists(texts, "t", ["id"])
    pairs = substring_pairs(texts, "t", ["id"], asked, index=GramIndex(lists, gram_counts(lists)))
    assert sorted((r["needle"], r["id"] or -1) for r in pairs.collect()) == sorted(
        [("number 17 ", 17), ("17", -1), *[("17", i) for i in range(400) if "17" in str(i)]])
    # The lists are filtered where they are read: no exchange has grams that are not wanted.
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"BroadcastHashJoin [^\n]*LeftSemi, BuildRight", plan)


@pytest.mark.parametrize("block", [phrases.BLOCK_BYTES, 3000])
def test_phrases_of_a_table_equal_nested_loops(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    draw = random.Random(23)
    texts = ["".join(draw.choice("ab cdé漢😀") for _ in range(draw.randint(0, 60))) for _ in range(150)] + [None, "", "A B"]
    words = ["".join(draw.choice("ab cdé漢😀AB") for _ in range(draw.randint(1, 12))) for _ in range(120)]
    table = [(draw.choice("xyz"), i, w) for i, w in enumerate([*words, *words[:9]])] + [(None, 1, "a"), ("x", 2, None), ("x", 3, "")]
    listed = spark.createDataFrame(table, "tag string, position int, phrase string").repartition(4)
    rows = spark.createDataFrame([(draw.choice([1, 2, None]), i, t) for i, t in enumerate(texts)],
                                 "id int, n int, text string").repartition(4)
    known = [(tag, i, w) for tag, i, w in table if tag and w]
    found = tagging.match_phrases(rows, ["id", "n"], "text", listed.withColumnRenamed("tag", "indicator_code")).collect()
    got = {(r["n"], r["indicator_code"]): r["matched_phrases"] for r in found}
    assert len(got) == len(found) > 100
    expected, scores = {}, {}
    for n, text in enumerate(texts):
        for tag, _, w in known:
            if w.lower() in (text or "").lower():
                expected.setdefault((n, tag), []).append(w)
    assert got == expected
    tags = {}
    for r in tagging.tag_texts(rows, ["id", "n"], "text", listed, top=2, default_tag="none").collect():
        tags.setdefault(r["n"], []).append((r["rank"], r["tag"], r["score"]))
    for n in range(len(texts)):
        scores = sorted(((len(w), tag) for (m, tag), w in expected.items() if m == n), reverse=True)[:2]
        assert sorted(tags[n]) == [(i, tag, k) for i, (k, tag) in enumerate(scores, 1)] or (
            not scores and tags[n] == [(1, "none", 1)])


def test_texts_are_dealt_out_before_they_are_probed(spark):
    texts = spark.createDataFrame([(None if i % 3 else i, f"text number {i}") for i in range(200)], "id int, text string").coalesce(1)
    listed = spark.createDataFrame([("a", 0, "Number 17"), ("b", 1, "text number 1")], "indicator_code string, position int, phrase string")
    hits = phrases.phrase_hits(texts, ["id"], "text", listed.withColumn("phrase", F.lower("phrase")), "phrase")
    # Each of 200 texts has its row without a phrase; these are made by many tasks.
    made = hits.where("phrase is null").select(F.spark_partition_id().alias("task")).collect()
    assert len(made) == 200 and len({row["task"] for row in made}) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert hits.where("phrase is not null").groupBy("indicator_code").count().collect() and hits.where(
        "indicator_code = 'a'").count() == 11


def test_a_hundred_thousand_phrases(spark):
    numbers = spark.range(100_000).select(F.col("id"), F.concat(F.lit("Phrase no. "), F.conv("id", 10, 36)).alias("p"))
    listed = numbers.select((F.col("id") % 7).cast("string").alias("indicator_code"), F.col("id").alias("position"),
                            F.concat("p", F.lit(".")).alias("phrase"))
    texts = spark.range(300).select("id", F.concat(
        F.repeat(F.lit("filler phrase no. "), 100), F.lit("phrase no. "), F.lower(F.conv(F.col("id") * 331, 10, 36)),
        F.lit(". and phrase no. zzzz.")).alias("text"))
    found = tagging.match_phrases(texts, ["id"], "text", listed)
    got = {r["id"]: (r["indicator_code"], r["matched_phrases"]) for r in found.collect()}
    expected = {r["id"]: (str(r["id"] * 331 % 7), [f"Phrase no. {r['c']}."])
                for r in spark.range(300).select("id", F.conv(F.col("id") * 331, 10, 36).alias("c")).collect()
                if r["id"] * 331 < 100_000}
    assert got == expected
    # Texts are probed where they are scanned: no exchange has their column.
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = found._jdf.queryExecution().explainString(mode)
    exchanges = re.findall(r"\) \w*Exchange *\nInput \[\d+\]: \[(.*)\]", plan)
    assert exchanges and not any(phrases.LOWERED in columns for columns in exchanges)


SPELLINGS = [
    "Türkiye", "Türkiye", "  côte d'ivoire ", "Việt Nam", "straße", "ﬁrst", "Ǆ", "São Tomé & Príncipe",
    "low_and-middle  income", "a/b,c.d", "Ærø", "Ĳsselmeer", "ＦＵＬＬ", "KK", "½", "ñ́", "plain",
    "tab\tnew\nline", " wide ",
]


def test_keys_equal_full_normalisation(spark):
    def reference(text, separators):
        folded = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return re.sub(separators, " ", folded.upper()).strip()

    frame = spark.createDataFrame([(s,) for s in SPELLINGS], "s string")
    for key, separators in ((alias_key, WHITESPACE), (group_key, LABEL_SEPARATORS), (label_key, GROUP_SEPARATORS)):
        rows = frame.select("s", key(F.col("s")).alias("k")).collect()
        for row in rows:
            assert row["k"] == reference(row["s"], separators) == key_of(row["s"], separators), row["s"]
    assert frame.limit(0).select(fold_marks(F.col("s"))).count() == 0


def test_every_code_point_folds(spark):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p < 0xE000
              and unicodedata.category(chr(p)) not in ("Cn", "Co")]
    frame = spark.createDataFrame([(p, f"a{chr(p)}b") for p in points], "p int, s string").repartition(8)
    folded = {r["p"]: r["f"] for r in frame.select("p", fold_marks(F.col("s")).alias("f")).collect()}
    wrong = [hex(p) for p in points if folded[p] != "".join(
        c for c in unicodedata.normalize("NFKD", f"a{chr(p)}b") if not unicodedata.combining(c))]
    assert wrong == []
    keys = {r["p"]: r["k"] for r in frame.select("p", alias_key(F.col("s")).alias("k")).collect()}
    # Upper case is the business of either language's tables; they may know different Unicode versions.
    differ = [hex(p) for p in points if keys[p] != key_of(f"a{chr(p)}b", WHITESPACE)]
    assert len(differ) <= 60, differ


# Files and texts are read back from a scratch folder, so these queries write while being built.
WRITING = {"n4_find_entities_stored", "j5_match_names_stored", "n5_resolve_customers_stored",
           "f5_search_indicators_stored", "s6_build_snapshot", "s6_refresh_changed_ranges", "s7_version_lines", "s7_snapshot_status", "s11_export_csv", "s12_export_package"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "FlatMapGroups"):
        assert operator not in plan, f"{name} plans a {operator}"


@pytest.mark.parametrize("name", ["w4_top_bottom", "w3_rank_changes", "a6_trends_top_per_indicator"])
def test_top_k_is_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .*Partial", plan)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)

