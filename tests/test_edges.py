"""Rules that the small workbook does not reach."""

from __future__ import annotations

import datetime
from collections import Counter

import pytest
from fixture_panel import (
    CODEBOOK, DATA, INDICATORS, NOTES, cached, codebook_sheet, make_panel, notes_sheet, wide_sheet,
)
from pyspark.sql import functions as F

from tidepanel import Selection
from tidepanel.dims import tables
from tidepanel.operators import hierarchy, resolve, select, summarize
from tidepanel.sources import load
from tidepanel.sources import star_panels as star


def data_row(name, code, year, values, region="AFR", income="Low"):
    return (name, code, region, income, year, *[values.get(i) for i in INDICATORS])


EXTRA = [
    data_row("Niger", "NER", 2020, {"che_gdp": 0.0, "che": 10, "gghed": 100, "fs1": 60}),
    data_row("Niger (old name)", "NER", 2024, {"che_gdp": 4.0, "che": 30, "gghed": 0, "fs1": 0, "fs3": 0}),
    data_row("Nigeria", "NGA", 2020, {"che_gdp": -2.0, "che": 5, "gghed": 100, "fs1": 50, "fs3": 20}),
    data_row("Nigeria", "NGA", 2027, {"che_gdp": 2.0, "che": 25, "fs1": 5}),
    data_row("Chad", "TCD", None, {"che_gdp": 1.0}),
    data_row("Ghana", "GHA", 2024, {"che_gdp": 8.3}),
    data_row("Nobody", None, 2024, {"che_gdp": 9.0}),
]
EXTRA_NOTES = [
    ("Niger", "NER", "AFR", "Low", "che_gdp", "x", "n", "first", "-", "Estimated by hand", None, None, 2),
    ("Niger", "NER", "AFR", "Low", "che_gdp", "x", "n", "", "c", "", "m", "", 3),
    ("Nigeria", "NGA", "AFR", "Low", "che_gdp", "x", "n", "s", "-", "Estimated by hand", None, None, 4),
    ("Nigeria", "NGA", "AFR", "Low", None, "x", "n", "s", None, None, None, None, 5),
]


@pytest.fixture(scope="module")
def panel(spark):
    return cached(make_panel(spark, DATA + EXTRA, notes=NOTES + EXTRA_NOTES))


def test_entities_first_row_wins_and_null_periods_register(panel):
    names = {r["entity_code"]: r["entity_name"] for r in panel.entities.collect()}
    assert names["NER"] == "Niger" and names["TCD"] == "Chad" and len(names) == 7
    assert panel.observations.where("entity_code = 'TCD'").count() == 0


def test_notes_last_row_wins_and_dash_stays(panel):
    rows = {r["entity_code"]: r for r in panel.notes.where("indicator_code = 'che_gdp'").collect()}
    assert (rows["NER"]["sources"], rows["NER"]["comments"], rows["NER"]["methods_of_estimation"]) == ("", "c", "m")
    assert rows["NGA"]["comments"] == "-"
    assert len(rows) == 3


def test_codebook_dash_only_when_exact(spark):
    rows = CODEBOOK + [(None, "x", "x", "x", "x", "x", "x", "x"), ("", "x", "x", "x", "x", "x", "x", "x"),
                       ("z", " - ", "-", "a-b", "", "-", "-", "-")]
    book = {r["indicator_code"]: r for r in load.load_codebook(codebook_sheet(spark, rows)).collect()}
    assert "location" not in book and None not in book and "" not in book
    z = book["z"]
    assert (z["indicator_name"], z["long_code"], z["category_1"], z["category_2"]) == (" - ", None, "a-b", "")


def test_bad_cells_and_keys_fail(spark):
    sheet = wide_sheet(spark).withColumn("che", F.col("che").cast("string")).replace("100.0", "n/a", ["che"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|n/a"):
        load.wide_to_observations(sheet, ["che"]).collect()
    with pytest.raises(ValueError, match="observations duplicate_key"):
        make_panel(spark, DATA + DATA[:1])
    with pytest.raises(ValueError, match="indicators duplicate_key che_gdp"):
        make_panel(spark, codebook=CODEBOOK + CODEBOOK[1:2])
    with pytest.raises(ValueError, match="entities null_value entity_name"):
        make_panel(spark, DATA + [data_row(None, "XXX", 2020, {"che": 1})])


def test_no_known_column_gives_no_facts(spark):
    facts = load.wide_to_observations(wide_sheet(spark), ["other"])
    assert facts.count() == 0 and facts.columns == ["entity_code", "period", "indicator_code", "value"]


def test_ambiguous_names(panel, spark):
    with pytest.raises(ValueError, match=r"'niger' is ambiguous. Entities that fit: 2, first Niger / Nigeria"):
        resolve.entity_codes(panel, ["niger"])
    asked = tables.literal_table(
        spark, {"spelling": tables.TEXT},
        [("niger",), ("NER",), ("US",), (" ",), (None,), ("nobody",), ("per",), ("UNITED",), ("NIGERIA",)],
    )
    rows = {r["spelling"]: r for r in resolve.resolve_entities(asked, "spelling", panel).collect()}
    assert (rows["niger"]["status"], rows["niger"]["n_matches"], rows["niger"]["candidates"]) == (
        "ambiguous", 2, ["Niger", "Nigeria"])
    assert (rows["NER"]["entity_code"], rows["NER"]["status"]) == ("NER", "code")
    assert (rows["US"]["entity_code"], rows["US"]["status"]) == ("USA", "alias")
    assert rows[" "]["status"] == rows[None]["status"] == "empty"
    assert (rows["nobody"]["status"], rows["nobody"]["n_matches"]) == ("unknown", 0)
    assert (rows["per"]["status"], rows["UNITED"]["status"], rows["NIGERIA"]["entity_code"]) == ("code", "name", "NGA")
    exact = resolve.resolve_entities(asked, "spelling", panel, exact_first=True)
    assert {r["spelling"]: r for r in exact.collect()}["niger"]["entity_code"] == "NER"


def test_lists_of_any_length_resolve_alike(panel):
    names = ["US", "\tPeru", "\u00a0COL\x1c", "Nigeria"]
    assert resolve.entity_codes(panel, names) == ["USA", "PER", "COL", "NGA"]
    assert resolve.entity_codes(panel, [name + " " * i for i in range(60) for name in names]) == ["USA", "PER", "COL", "NGA"]
    for bad, message in (("\n", "cannot be empty"), ("niger", "ambiguous"), ("Atlantis", "Could not resolve")):
        for many in ([bad], names * 60 + [bad]):
            with pytest.raises(ValueError, match=message):
                resolve.entity_codes(panel, many)
    assert select.selected_entities(panel, Selection(entities=names)).count() == 4


def test_spellings_are_stripped_of_all_white_space(panel, spark):
    asked = tables.literal_table(spark, {"spelling": tables.TEXT}, [("\tPeru",), ("\u00a0us\u2003",), ("\x1f\n",)])
    rows = {r["spelling"]: r["entity_code"] for r in resolve.resolve_entities(asked, "spelling", panel).collect()}
    assert rows == {"\tPeru": "PER", "\u00a0us\u2003": "USA", "\x1f\n": None}


def test_blank_query_finds_everything(panel, spark):
    asked = tables.literal_table(spark, {"q": tables.TEXT}, [("",), ("\t",), ("niger",), (None,)])
    rows = resolve.find_entities(panel, asked, "q").groupBy("q").count().collect()
    n = panel.entities.count()
    assert {r["q"]: r["count"] for r in rows} == {"": n, "\t": n, "niger": 2}
    assert resolve.find_entity(panel, " ").count() == n


def test_parents_are_known_for_the_codebook_only(panel):
    codes = {r["indicator_code"] for r in panel.indicators.collect()}
    assert {r["child_code"] for r in hierarchy.known_parents(panel).collect()} <= codes


def test_selection_as_one_group(panel):
    row = summarize.summarize_groups(panel, None, ["che_gdp"], sel=Selection(entities=["NER", "NGA", "GHA", "TCD"])).head()
    assert (row["group_code"], row["n"], row["median"], row["entity_count"]) == ("selection", 3, 4.0, 4)


def test_change_rates(panel):
    rows = {r["entity_code"]: r for r in summarize.indicator_trends(panel, ["che_gdp"]).collect()}
    assert rows["NER"]["percent_change"] is None and rows["NER"]["cagr"] is None
    assert rows["NGA"]["percent_change"] == pytest.approx(2.0) and rows["NGA"]["cagr"] is None
    assert rows["PER"]["percent_change"] == 0.0 and rows["PER"]["cagr"] is None


def test_ties_and_ascending_rank(panel):
    down = summarize.rank_changes(panel, ["che"], "absolute_change", descending=False).collect()
    assert [(r["entity_code"], r["absolute_change"]) for r in down] == [
        ("PER", 0.0), ("USA", 0.0), ("COL", 10.0), ("NER", 20.0), ("NGA", 20.0)]
    up = summarize.rank_changes(panel, ["che"], "absolute_change", top=2).collect()
    assert [r["entity_code"] for r in up] == ["NER", "NGA"]
    by_rate = summarize.rank_changes(panel, ["che"], "percent_change", top=None).collect()
    assert [r["entity_code"] for r in by_rate] == ["NGA", "NER", "COL", "PER", "USA"]


def test_top_bottom_ties(panel):
    ends = summarize.top_bottom(panel, "income", ["che_gdp"], 3).where("group_code = 'Low'").collect()
    bottom = [r["entity_code"] for r in ends if r["side"] == "bottom"]
    assert bottom == ["NGA", "NER", "GHA"]
    assert [r["entity_code"] for r in ends if r["side"] == "top"] == ["GHA", "NER", "NGA"]


def test_span_warning(panel):
    trends = summarize.indicator_trends(panel, ["che"])
    warning = summarize.mixed_span_warnings(trends, "indicator_code").head()
    assert (warning["min_value"], warning["max_value"]) == (0, 7)
    one = summarize.indicator_trends(panel, ["che"], Selection(entities=["NGA"]))
    assert summarize.mixed_span_warnings(one, "indicator_code").count() == 0


def test_breakdown_cases(panel):
    edges = hierarchy.named_edges(panel, "gghed")
    rows = {(r["entity_code"], r["period"]): r for r in hierarchy.breakdown_totals(panel, edges).collect()}
    missing_child = rows[("NER", 2020)]
    assert (missing_child["child_sum"], missing_child["difference"], missing_child["balanced"]) == (60, -40, False)
    zero = rows[("NER", 2024)]
    assert (zero["parent_value"], zero["child_sum"], zero["relative_difference"], zero["balanced"]) == (0, 0, None, False)
    unbalanced = rows[("NGA", 2020)]
    assert unbalanced["relative_difference"] == pytest.approx(-0.3) and not unbalanced["balanced"]
    no_parent = rows[("NGA", 2027)]
    assert (no_parent["parent_value"], no_parent["difference"], no_parent["child_sum"]) == (None, None, 5)
    children = hierarchy.additive_breakdown(panel, edges, Selection(entities=["NER"], end=2020)).collect()
    assert {(r["child_code"], r["child_value"], r["share"]) for r in children} == {("fs1", 60.0, 0.6), ("fs3", None, None)}


def test_unknown_children_are_flagged(panel):
    edges = hierarchy.named_edges(panel, "che")
    rows = hierarchy.additive_breakdown(panel, edges, Selection(entities=["COL"], start=2023)).collect()
    assert len(rows) == 5 and not any(r["child_known"] or r["child_value"] for r in rows)


def test_quality_filters_apply_together(panel):
    sel = Selection(entities=["COL", "NGA"], region="Africa")
    row = summarize.assess_quality(panel, ["che_gdp"], sel).head()
    assert (row["observation_count"], row["note_rows"], row["data_types"]) == (2, 1, {"Estimated by hand": 1})
    assert row["estimated_data_present"]
    none = summarize.assess_quality(panel, ["che_gdp"], Selection(region="AFR", income="High")).head()
    assert (none["observation_count"], none["note_rows"], none["data_types"]) == (0, 0, {})
    assert none["no_observations"]
    everything = {r["indicator_code"]: r for r in summarize.assess_quality(panel).collect()}
    assert everything["che_gdp"]["data_types"] == {"Unspecified": 1, "Estimated by hand": 1, "Documented": 1}
    assert (everything["che_gdp"]["with_comments"], everything["che_gdp"]["with_sources"]) == (2, 2)
    assert everything["hc11"]["no_observations"]


def test_period_list_and_all_rows(panel):
    row = summarize.summarize_groups(panel, "region", ["che_gdp"], latest_only=False).where("group_code = 'AFR'").head()
    assert (row["n"], row["entities_with_data"], row["entity_count"], row["periods"]) == (5, 3, 4, [2020, 2024, 2027])
    one = summarize.summarize_groups(panel, "region", ["che_gdp", "hc11"], period=2020)
    rows = {(r["group_code"], r["indicator_code"]): r for r in one.collect()}
    assert (rows[("AFR", "che_gdp")]["n"], rows[("AFR", "che_gdp")]["median"]) == (2, -1.0)
    assert (rows[("AMR", "hc11")]["n"], rows[("AMR", "hc11")]["median"], rows[("AMR", "hc11")]["periods"]) == (0, None, [])
    assert rows[("AMR", "hc11")]["coverage_ratio"] == 0


def test_duplicate_requests_are_asked_once(panel):
    assert summarize.data_availability(panel, ["che", "che"]).count() == 1


def test_notes_selection(panel):
    rows = select.select_notes(panel, entity="Nigeria").collect()
    assert [(r["entity_code"], r["indicator_code"]) for r in rows] == [("NGA", "che_gdp")]
    assert select.select_notes(panel, code="che_gdp", top=2).count() == 2
    assert notes_sheet(panel.spark).columns[0] == "location"


def test_batch_search_equals_scalar_search(panel, spark):
    texts = ["share", "Millions", "SHA11.", "%", "ncu", "nothing at all", " functions ", "HF.1"]
    asked = tables.literal_table(spark, {"q": tables.TEXT}, [(t,) for t in texts] + [(" ",)])
    batch = {(r["q"], r["indicator_code"]) for r in
             select.search_indicators_batch(panel, asked, "q").collect()}
    scalar = {(t, r["indicator_code"]) for t in texts for r in select.search_indicators(panel, t).collect()}
    assert batch == scalar


def test_lines_are_dealt_before_they_are_summed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(star, "TASK_LINES", 20)
    day = datetime.datetime(1997, 5, 1)
    lines = [(i, None if i % 50 == 7 else i % 40, None if i % 60 == 9 else i % 6, 1, float(i % 9), 1.0, 0.0, 0.0, "A", "F",
              None if i % 70 == 3 else day.replace(year=1996 + i % 2)) for i in range(400)]
    parts = [(i, "hot ring", f"Brand#{i % 3}", "SMALL", 1, 1.0) for i in range(39)] + [(1, "twice", "Brand#9", "SMALL", 1, 1.0)]
    for name, rows in (("lineitem", lines), ("part", parts)):
        spark.createDataFrame(rows, star.SCHEMAS[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    facts = star.parts_facts(spark, str(tmp_path))
    # A task's share of the lines does not grow with them; nothing is summed on the far side of an exchange.
    assert facts.rdd.getNumPartitions() == 2 * 20
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    wanted = Counter()
    for line in lines:
        part, supplier, quantity, year = line[1], line[2], line[4], line[10] and line[10].year
        key = (None if supplier is None else str(supplier), year)
        wanted[(*key, None if part is None else f"p{part}")] += quantity
        for row in parts:
            if row[0] == part:
                wanted[(*key, f"b{row[2].removeprefix('Brand#')}")] += quantity
    assert {tuple(row)[:3]: row["value"] for row in facts.collect()} == dict(wanted)
