"""The values the small workbook must give."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from fixture_panel import cached, make_panel
from pyspark.sql import functions as F

from tidepanel import Selection
from tidepanel.dims import tables
from tidepanel.operators import hierarchy, resolve, select, summarize, tagging
from tidepanel.plans import posting_lists
from tidepanel.sources import catalog, export, snapshot, storage


@pytest.fixture(scope="module")
def panel(spark):
    return cached(make_panel(spark))


def codes(frame, column="entity_code"):
    return [row[column] for row in frame.collect()]


def test_counts(panel):
    assert panel.entities.count() == 3
    assert panel.indicators.count() == 10
    assert panel.observations.count() == 36
    assert codes(panel.version_lines.orderBy("line_no"), "line_no") == [1, 3]


def test_search(panel):
    found = select.search_indicators(panel, " Out-of-Pocket ", category_1=select.HEADLINE)
    assert codes(found, "indicator_code") == ["oops_che"]
    assert codes(select.search_indicators(panel, "  "), "indicator_code") == []
    # Underscore and percent are plain characters.
    assert codes(select.search_indicators(panel, "%gdp_"), "indicator_code") == ["che_gdp"]
    assert codes(select.search_indicators(panel, "g_p"), "indicator_code") == []
    # The method of measurement is not searched.
    assert codes(select.search_indicators(panel, "HF.1 +"), "indicator_code") == []


def test_listing(panel):
    headline = select.list_indicators(panel, category_1="INDICATORS")
    assert codes(headline, "indicator_code") == ["che", "che_gdp", "gghed", "oops_che"]
    assert select.count_indicators(panel, "HEALTH EXPENDITURE DATA").head()[0] == 6
    assert codes(select.list_indicators(panel, skip=1, top=2), "indicator_code") == ["che_gdp", "fs1"]


def test_lookup_keeps_order_and_flags(panel):
    rows = select.lookup_codes(panel, ["hc11", "nope", "che"]).collect()
    assert [(row["indicator_code"], row["found"]) for row in rows] == [
        ("hc11", True), ("nope", False), ("che", True)
    ]
    assert rows[0]["currency"] is None and rows[2]["currency"] == "NCU"


def test_availability(panel):
    sel = Selection(entities=["Colombia", "PER"], start=2022, end=2023)
    rows = {row["indicator_code"]: row for row in
            summarize.data_availability(panel, ["che_gdp", "oops_che", "hc11"], sel).collect()}
    assert (rows["che_gdp"]["observation_count"], rows["che_gdp"]["entity_count"]) == (3, 2)
    assert rows["oops_che"]["latest_period"] == 2023
    assert (rows["hc11"]["observation_count"], rows["hc11"]["first_period"]) == (0, None)


def test_groups(panel):
    counts = summarize.group_counts(panel).collect()
    assert ("region", "AMR", None, 3) in [tuple(row) for row in counts]
    assert ("income", None, "Upper-middle", 2) in [tuple(row) for row in counts]
    sizes = {row["group_code"]: row["member_count"] for row in select.list_groups(panel).collect()}
    assert sizes == {
        "EAP": 38, "ECA": 58, "LAC": 33, "LAC_TERRITORIES": 42, "MENA": 23,
        "MENA_EXCL_ISR_MLT": 21, "NAR": 3, "SAS": 6, "SSA": 48, "LDC": 44, "OECD": 38,
    }


def test_latest_and_export(panel, tmp_path):
    latest = select.compare_entities(panel, "che_gdp", Selection(entities=["COL", "PER"]), True)
    rows = latest.collect()
    assert [(r["entity_code"], r["period"], r["value"]) for r in rows] == [
        ("COL", 2023, 8.3), ("PER", 2022, 5.5)
    ]
    warning = summarize.mixed_period_warnings(latest, "indicator_code").head()
    assert (warning["type"], warning["values"]) == ("mixed_latest_years", [2022, 2023])
    export.export_csv(latest, str(tmp_path / "csv"))
    lines = [row[0] for row in panel.spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines[0].startswith("indicator_code,indicator_name,entity_code,entity_name,region,income,period")
    assert any(line.endswith("8.3,Percentage,") for line in lines)


def test_summary(panel):
    row = summarize.summarize_groups(panel, "income", ["che_gdp"]).where("group_code = 'Upper-middle'").head()
    assert (row["n"], row["coverage_ratio"], row["periods"]) == (2, 1.0, [2022, 2023])
    assert row["median"] == pytest.approx(6.9)
    ends = summarize.top_bottom(panel, "income", ["che_gdp"], 1)
    top = ends.where("group_code = 'Upper-middle' and side = 'top'").head()
    assert top["entity_code"] == "COL"


def test_curated_group_summary(panel):
    rows = {r["group_code"]: r for r in summarize.summarize_groups(panel, "group", ["che_gdp"]).collect()}
    assert set(rows) == {"LAC", "LAC_TERRITORIES", "NAR", "OECD"}
    assert (rows["OECD"]["n"], rows["OECD"]["entity_count"]) == (2, 2)


def test_entity_resolution(panel):
    assert resolve.entity_codes(panel, ["US", "peru", "COL"]) == ["USA", "PER", "COL"]
    assert codes(resolve.find_entity(panel, "u.s.")) == ["USA"]
    assert codes(resolve.find_entity(panel, "o")) == ["COL", "USA"]
    with pytest.raises(ValueError, match="Could not resolve"):
        resolve.entity_codes(panel, ["Atlantis"])
    with pytest.raises(ValueError, match="cannot be empty"):
        resolve.entity_codes(panel, [" "])


def test_hierarchy(panel):
    edges = hierarchy.relations_of(panel, ["gghed", "hc"]).collect()
    assert [e["child_code"] for e in edges if e["parent_code"] == "gghed"] == ["fs1", "fs3"]
    assert [e["child_code"] for e in edges if e["parent_code"] == "hc"] == ["hc1", "hc2"]
    # The curated relation of che names children the codebook does not have.
    che = hierarchy.relations_of(panel, ["che"]).where("priority = 0")
    assert codes(che, "child_code") == ["hf1", "hf2", "hf3", "hf4", "hfnec"]


def test_roles(panel):
    rows = {row["indicator_code"]: row for row in hierarchy.classify_indicators(panel).collect()}
    assert rows["gghed"]["role"] == "additive_parent"
    assert rows["fs1"]["role"] == "component"
    assert rows["che_gdp"]["role"] == "derived_ratio_or_share"
    assert rows["hc11"]["role"] == "context_or_conversion_series"
    assert rows["hc11"]["caution_no_known_hierarchy"]


def test_breakdown(panel):
    edges = hierarchy.named_edges(panel, "gghed")
    sel = Selection(entities=["COL"], start=2023, end=2023)
    rows = hierarchy.additive_breakdown(panel, edges, sel).orderBy("position").collect()
    assert [(r["child_code"], r["child_value"]) for r in rows] == [("fs1", 65.0), ("fs3", 15.0)]
    assert all(r["parent_value"] == 80 and r["child_sum"] == 80 and r["balanced"] for r in rows)
    assert rows[0]["share"] == pytest.approx(65 / 80)
    with pytest.raises(ValueError, match="No relationship"):
        hierarchy.named_edges(panel, "gghed", "nope")
    with pytest.raises(ValueError, match="No relationship"):
        hierarchy.named_edges(panel, "che_gdp")


def test_trends(panel):
    rows = {r["entity_code"]: r for r in summarize.indicator_trends(panel, ["che_gdp"]).collect()}
    assert rows["COL"]["absolute_change"] == pytest.approx(0.2)
    assert (rows["COL"]["period_span"], rows["PER"]["period_count"], rows["PER"]["period_span"]) == (1, 1, 0)
    assert rows["COL"]["cagr"] == pytest.approx(8.3 / 8.1 - 1)
    assert rows["PER"]["cagr"] is None
    assert codes(summarize.indicator_trends(panel, ["che_gdp"], min_count=2)) == ["COL"]
    ranked = summarize.rank_changes(panel, ["che_gdp"], min_span=1).collect()
    assert [(r["entity_code"], r["rank"]) for r in ranked] == [("COL", 1)]
    with pytest.raises(ValueError, match="metric must be"):
        summarize.rank_changes(panel, ["che_gdp"], "growth")


def test_quality(panel):
    row = summarize.assess_quality(panel, ["che_gdp"], Selection(entities=["COL"])).head()
    assert (row["observation_count"], row["data_types"], row["with_footnotes"]) == (2, {"Documented": 1}, 1)
    assert row["entity_notes_present"] and not row["estimated_data_present"] and not row["no_observations"]
    notes = summarize.sample_notes(panel, ["che_gdp"]).collect()
    assert [(n["entity_code"], n["footnote"]) for n in notes] == [("COL", "Calendar year")]


@pytest.mark.parametrize(
    ("income", "expected"),
    [("LMIC", ["COL", "PER"]), ("MIC", ["COL", "PER"]), ("High", ["USA"]), ("upper middle income", ["COL", "PER"]),
     ("UMIC", ["COL", "PER"]), ("Upper-middle", ["COL", "PER"]), ("  ", ["COL", "PER", "USA"])],
)
def test_income_aliases(panel, income, expected):
    assert codes(select.list_entities(panel, income=income)) == expected


def test_region_aliases_and_errors(panel):
    assert codes(select.list_entities(panel, region="Americas")) == ["COL", "PER", "USA"]
    with pytest.raises(ValueError, match="Available: AMR"):
        select.list_entities(panel, region="Atlantis")
    with pytest.raises(ValueError, match="Available: High, Upper-middle"):
        select.list_entities(panel, income="middle-class")
    with pytest.raises(ValueError, match="Available: EAP"):
        select.list_entities(panel, group="Atlantis")
    with pytest.raises(ValueError, match="cannot be empty"):
        resolve.group_code(panel, " ")
    with pytest.raises(ValueError, match="Unknown indicator"):
        select.indicator_data(panel, "nope")
    with pytest.raises(ValueError, match="at least one"):
        select.compare_group(panel, "che_gdp", Selection())


def test_group_composition(panel):
    assert codes(select.list_entities(panel, group="LAC", income="High")) == []
    assert codes(select.compare_group(panel, "che_gdp", Selection(group="latin america"))) == ["COL", "PER"]
    union = Selection(entities=["United States of America"], group="LAC")
    assert codes(select.compare_entities(panel, "che_gdp", union, True)) == ["COL", "PER", "USA"]
    # A group without members in the panel selects nothing, not everything.
    assert codes(select.compare_group(panel, "che_gdp", Selection(group="South Asia"))) == []


def test_lmic_panel(panel):
    rows = select.research_panel(panel, ["che_gdp"], Selection(income="LMIC"))
    assert codes(rows) == ["COL", "COL", "PER"]
    limited = summarize.limit_warnings(rows, 3).collect()
    assert [w["type"] for w in limited] == ["top_limit_reached"]
    assert summarize.limit_warnings(rows, 4).count() == 0


def test_profile(panel):
    rows = select.entity_profile(panel, ["che_gdp", "hc11", "che"], 2022, Selection(entities=["COL"])).collect()
    assert [(r["indicator_code"], r["period"], r["value"]) for r in rows] == [
        ("che_gdp", 2022, 8.1), ("hc11", None, None), ("che", 2022, 100.0)
    ]
    assert rows[1]["entity_name"] == "Colombia"
    with pytest.raises(ValueError, match="Unknown indicator"):
        select.entity_profile(panel)


def test_cards_and_topics(panel):
    card = select.indicator_cards(panel).where("indicator_code = 'che_gdp'").head()["card"]
    assert card.startswith("# che_gdp\n\nHealth spending as share of GDP\n\n- Long code: `CHE%GDP_SHA2011`")
    assert card.endswith("- Currency: \n\n## Method of measurement\nCHE / GDP")
    topic = select.select_by_topic(panel, "out_of_pocket")
    assert set(codes(topic, "indicator_code")) == {"oops_che"}
    with pytest.raises(ValueError, match="Available: capital"):
        select.select_by_topic(panel, "nope")


def test_pivot(panel):
    facts = panel.observations.where("indicator_code = 'che_gdp'")
    rows = [tuple(r) for r in select.pivot_panel(facts, ["COL", "PER"]).orderBy("period").collect()]
    assert rows == [(2022, 8.1, 5.5), (2023, 8.3, None)]


def test_tags(spark):
    texts = spark.createDataFrame(
        [(1, "How large are out-of-pocket payments by households under public insurance?"),
         (2, "nothing here"), (3, "Donor dependence and OOP share"), (4, None)],
        "id int, text string",
    )
    rows = tagging.tag_texts(texts, ["id"], "text").orderBy("id", "rank").collect()
    by_id = {i: [(r["tag"], r["score"]) for r in rows if r["id"] == i] for i in (1, 2, 3, 4)}
    assert by_id[1] == [("financial_protection_oop", 2), ("private_and_voluntary_insurance", 1),
                        ("government_priority", 1)]
    assert by_id[2] == by_id[4] == [("core_spending", 1)]
    assert by_id[3][0] == ("donor_dependence", 2)
    phrases = {(r["id"], r["indicator_code"]): r["matched_phrases"]
               for r in tagging.match_phrases(texts, ["id"], "text").collect()}
    assert phrases == {(3, "oops_che"): ["OOP share"], (3, "ext_che"): ["donor dependence"]}
    advice = tagging.recommend_indicators(tagging.tag_texts(texts.where("id = 2"), ["id"], "text"))
    assert codes(advice.orderBy("position"), "indicator_code") == [
        "che_gdp", "che_pc_usd", "che_ppp_pc", "che", "che_usd", "che_usd2023"]


def test_dictionaries_count_as_listed(spark):
    texts = spark.createDataFrame(
        [(1, "alpha beta"), (1, "alpha beta"), (None, "a cat"), (3, ""), (4, None), (5, "delta delta alpha")],
        "id int, text string",
    )
    words = {"a": ["alpha", "al", "zeta"], "b": ["Beta", "cat", "cat"], "c": ["gamma", "delta"], "d": []}
    words |= {f"x{i}": [f"never {i} {j}" for j in range(20)] for i in range(100)}
    tags = sorted((r["id"] or 0, r["rank"], r["tag"], r["score"]) for r in
                  tagging.tag_texts(texts, ["id"], "text", words, 2).collect())
    assert tags == sorted([
        (1, 1, "a", 2), (1, 2, "b", 1), (1, 1, "a", 2), (1, 2, "b", 1), (0, 1, "b", 2), (3, 1, "core_spending", 1),
        (4, 1, "core_spending", 1), (5, 1, "a", 2), (5, 2, "c", 1)])
    phrases = sorted((r["id"] or 0, r["indicator_code"], r["matched_phrases"])
                     for r in tagging.match_phrases(texts, ["id"], "text", words).collect())
    assert phrases == sorted([(1, "a", ["alpha", "al"]), (1, "b", ["Beta"])] * 2 + [
        (0, "b", ["cat", "cat"]), (5, "a", ["alpha", "al"]), (5, "c", ["delta"])])


TREE = """{"IsFolder": true, "Children": [{"IsFolder": true, "Name": "Download all data", "Children": [
 {"IsFolder": false, "Identifier": 1, "Name": "All data (December 2025)", "FileType": ".xlsx",
  "DateModified": "/Date(1765790273000)/"},
 {"IsFolder": false, "Identifier": 64396441, "Name": "ALL DATA (March 2026)", "FileType": ".XLSX",
  "DateModified": "/Date(1774900345000)/"},
 {"IsFolder": false, "Identifier": 3, "Name": "All data notes", "FileType": ".pdf", "Children": null,
  "DateModified": "/Date(1999900345000)/"},
 {"IsFolder": false, "Name": "All data without id", "FileType": ".xlsx",
  "DateModified": "/Date(1999900345000)/"}]}]}"""


def test_catalog(spark):
    trees = tables.literal_table(spark, {"tree": tables.TEXT}, [(TREE,)])
    files = catalog.flatten_catalog(trees)
    assert files.count() == 4
    newest = catalog.require_latest(files, "all data", ".xlsx").head()
    assert newest["doc_id"] == 64396441
    with pytest.raises(ValueError, match="No document"):
        catalog.require_latest(files, "other", ".xlsx")
    stamp = files.where("doc_id = 64396441").select(
        F.timestamp_millis("modified_ms").cast("string")).head()[0]
    assert stamp == "2026-03-30 19:52:25"
    with pytest.raises(Exception, match="nests deeper"):
        catalog.flatten_catalog(trees, max_depth=1).collect()


def test_catalog_of_any_depth_is_listed_depth_first(spark):
    def file(i, children="null"):
        return '{"IsFolder":%s,"Identifier":%d,"Name":"x [%d","FileType":".f","Children":%s}' % (
            "false", i, i, children)

    deep = file(1)
    for _ in range(12):
        deep = '{"IsFolder":true,"Children":[%s,null]}' % deep
    tree = '{"Children":[%s,%s,%s],"Identifier":9,"Name":"x"}' % (deep, file(2, f"[{file(3)}]"), file(4))
    rows = [(0, tree), (1, file(5)), (2, '{"IsFolder":true}'), (3, None), (4, '{"IsFolder":true,"Children":[]}')]
    trees = tables.literal_table(spark, {"t": tables.INT, "tree": tables.TEXT}, rows)
    found = catalog.flatten_catalog(trees, keep=["t"]).orderBy("t", "position").collect()
    assert [(r["t"], r["position"], r["doc_id"]) for r in found] == [
        (0, 0, 9), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4), (1, 0, 5)]
    newest = catalog.latest_document(catalog.flatten_catalog(trees, keep=["t"]), "x [", ".f", ["t"]).collect()
    assert {r["t"]: r["doc_id"] for r in newest} == {0: 1, 1: 5}


def test_catalog_of_a_thousand_levels(spark):
    def chain(depth):
        inner = '{"Identifier":7,"Name":"a]\\"{","Children":null}'
        return '{"IsFolder":true,"x":{"Children":[{"Name":"no"}]},"Children":[' * depth + inner + ",{}]}" * depth

    rows = [
        (1, chain(2000)), (2, chain(1)), (3, "[{}]"), (4, "{"), (5, '{"Identifier":5,"Name":{"a":[1]},"Children":[[{}]]}'),
        (6, ' \n{"Children":[{"Identifier":1},{"Identifier":2,"Children":[{"Identifier":3}],"Name":"n"}],"Identifier":9}'),
    ]
    trees = spark.createDataFrame([*rows, rows[1]], "t int, tree string")
    files = catalog.flatten_catalog(trees, keep=["t"])
    found = sorted((r["t"], r["position"], r["doc_id"] or 0, r["name"] or "") for r in files.collect())
    assert found == sorted(
        [(1, 0, 7, 'a]"{')] + [(1, i, 0, "") for i in range(1, 2001)] + [(2, 0, 7, 'a]"{'), (2, 1, 0, "")] * 2
        + [(5, 0, 5, ""), (6, 0, 9, ""), (6, 1, 1, ""), (6, 2, 2, "n"), (6, 3, 3, "")])
    short = catalog.flatten_catalog(spark.createDataFrame([(2, chain(1))], "t int, tree string"), keep=["t"])
    assert len(str(files._jdf.queryExecution().analyzed())) == len(str(short._jdf.queryExecution().analyzed()))


def test_trees_are_dealt_out_whole(spark):
    trees = spark.createDataFrame([('{"Children":[{"Name":"a"}]}',)] * 20, "tree string").coalesce(1)
    plan = catalog.flatten_catalog(trees)._jdf.queryExecution().executedPlan().toString()
    # One exchange, of texts; tokens are not shuffled.
    assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.rindex("Generate ")


def test_parents_in_a_row_are_one_step_of_a_tree(spark):
    """Tokens do not become rows, and levels that open in a row, with shallow values in their fields, are one token."""
    deep = '{"Name":"p","Owner":{"Children":[{"x":"]}"}]},"Children":[ ' * 500 + '{"Name":"f"}' + "]}" * 500
    trees = spark.createDataFrame([(deep,)], "tree string")
    plain = F.regexp_replace("tree", F.lit(catalog._field_values()), F.lit("$1null"))
    assert trees.select(F.size(F.regexp_extract_all(plain, F.lit(catalog.TOKEN), F.lit(0)))).first()[0] == 1
    files = catalog.flatten_catalog(trees)
    assert [r["name"] for r in files.orderBy("position").collect()] == ["p"] * 500 + ["f"]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort " not in plan


def test_broken_trees_keep_what_brackets_enclose(spark):
    rows = [
        (1, '{"Identifier":1,{"Identifier":2},"Children":[{"Identifier":3}, ,{"Identifier":4}],"Name":"n"}'),
        (2, '{"Owner":{"a":1}{ null} , "Children"\n : [ {"Identifier":5,"x":[[[[[[{"Children":[{}]}]]]]]]}],"Identifier":6}'),
        (3, '{}{"Identifier":7}'), (4, '{"Identifier":8}}{'), (5, '{"Children":[{"Name":"a]"}]'),
        (6, '{"IsFolder":true,"Children":[{"IsFolder":true,"Name":"q\\"IsFolder","IsFolder":false}]}'),
    ]
    files = catalog.flatten_catalog(spark.createDataFrame(rows, "t int, tree string"), keep=["t"])
    assert sorted((r["t"], r["position"], r["doc_id"] or 0, r["name"] or "") for r in files.collect()) == [
        (1, 0, 0, ""), (1, 1, 2, ""), (1, 2, 3, ""), (1, 3, 4, ""), (2, 0, 6, ""), (2, 1, 0, ""), (2, 2, 5, ""),
        (3, 0, 0, ""), (3, 1, 7, ""), (4, 0, 8, ""), (6, 0, 0, 'q"IsFolder')]


def test_catalog_changes(spark):
    columns = "series int, doc_id bigint, size bigint, modified_raw string, name string"
    old = spark.createDataFrame([(1, 7, 10, "a", "n"), (2, 8, None, "a", "n"), (3, 9, 1, "a", "n")], columns)
    new = spark.createDataFrame([(1, 7, 10, "b", "n"), (2, 8, None, "a", "n"), (4, 9, 1, "a", "n")], columns)
    rows = {r["series"]: r["changed"] for r in catalog.catalog_changes(old, new, ["series"]).collect()}
    assert rows == {1: True, 2: False, 3: True, 4: True}


def test_snapshot(spark, panel, tmp_path):
    path = str(tmp_path / "snap")
    assert snapshot.current_build(spark, path) is None
    first = snapshot.build_snapshot(panel, path, "a")
    assert snapshot.build_snapshot(panel, path, "a") == first
    status = {r["item"]: r["value"] for r in snapshot.snapshot_status(spark, path, "a").collect()}
    assert (status["observations"], status["entities"], status["notes"]) == ("36", "3", "1")
    assert status["is_current"] == "true"
    assert codes(snapshot.version_lines(spark, path), "text") == ["Release of March", "Second line"]
    again = snapshot.read_snapshot(spark, path)
    assert sorted(map(tuple, again.observations.collect())) == sorted(map(tuple, panel.observations.collect()))
    # A failing build leaves the current one in place; a changed signature makes a new one.
    broken = panel.replace(observations=panel.observations.union(panel.observations))
    with pytest.raises(ValueError, match="violates its keys"):
        snapshot.build_snapshot(broken, path, "b")
    assert snapshot.current_build(spark, path)["version"] == first
    assert not snapshot.is_current(spark, path, "b")
    second = snapshot.build_snapshot(panel, path, "b")
    assert second != first and snapshot.is_current(spark, path, "b")


def builds(path):
    return sorted(name for name in os.listdir(path) if name.startswith("v="))


def test_a_file_is_put_once(spark, tmp_path):
    path = f"{tmp_path}/m/0001.json"
    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: storage.put_if_absent(spark, path, f"text {i}\n"), range(8)))
    assert done.count(True) == 1 and os.listdir(tmp_path / "m") == ["0001.json"]
    assert Path(path).read_text() == f"text {done.index(True)}\n"


@pytest.mark.parametrize("signatures", [("a", "a"), ("a", "b")])
def test_builders_at_once_leave_one_current_build(spark, panel, tmp_path, signatures):
    path = str(tmp_path / "snap")
    with ThreadPoolExecutor(2) as pool:
        versions = list(pool.map(lambda s: snapshot.build_snapshot(panel, path, s), signatures))
    current = snapshot.current_build(spark, path)
    numbers = [r["number"] for r in snapshot.manifest(spark, path).collect()]
    assert sorted(numbers) == list(range(1, len(set(signatures)) + 1))
    assert current["version"] in versions and len(set(versions)) == len(set(signatures))
    assert len(builds(path)) == len(set(signatures))
    assert snapshot.read_snapshot(spark, path).observations.count() == panel.observations.count()


def test_old_and_failed_builds_go(spark, panel, tmp_path):
    path = str(tmp_path / "snap")
    first = snapshot.build_snapshot(panel, path, "a")
    second = snapshot.build_snapshot(panel, path, "b")
    assert builds(path) == sorted([f"v={first}", f"v={second}"])
    os.makedirs(f"{path}/v=unfinished")
    assert snapshot.remove_old_builds(spark, path, 3600) == []
    # Whatever its age, the current build stays.
    assert sorted(snapshot.remove_old_builds(spark, path, -1)) == sorted([first, "unfinished"])
    assert builds(path) == [f"v={second}"]
    broken = panel.replace(observations=panel.observations.union(panel.observations))
    with pytest.raises(ValueError):
        snapshot.build_snapshot(broken, path, "c")
    assert builds(path) == [f"v={second}"]
    third = snapshot.build_snapshot(panel, path, "c", retention=-1)
    assert builds(path) == [f"v={third}"] and snapshot.remove_old_builds(spark, str(tmp_path / "none")) == []


def test_a_refresh_writes_only_changed_ranges(spark, panel, tmp_path, monkeypatch):
    def folders():
        return sorted(f"{v}/{r}" for v in os.listdir(f"{path}/observations")
                      for r in os.listdir(f"{path}/observations/{v}") if r.startswith("range="))

    def built(rows, name):
        frame = spark.createDataFrame(rows, "entity_code string, period int, indicator_code string, value double")
        before = set(folders()) if os.path.isdir(f"{path}/observations") else set()
        version = snapshot.build_snapshot(panel.replace(observations=frame.repartition(7)), path, name)
        assert sorted(map(tuple, snapshot.read_snapshot(spark, path).observations.collect())) == sorted(rows)
        return version, set(folders()) - before

    monkeypatch.setattr(snapshot, "MOST_RANGES", 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    path = str(tmp_path / "snap")
    rows = [(f"e{e:02}", p, f"i{i}", float(p)) for e in range(40) for i in range(5) for p in range(3)]
    try:
        first, made = built(rows, "a")
        assert len(made) == 8
        # One entity's value of one indicator: one range. Then a new entity behind all others, and nothing at all.
        _, made = built([r if r[:3] != ("e07", 1, "i2") else (*r[:3], -1.0) for r in rows], "b")
        assert len(made) == 1
        _, made = built([*rows, ("zz", 1, "i9", 9.0)], "c")
        assert len(made) == 2
        version, made = built([*rows, ("zz", 1, "i9", 9.0)], "d")
        assert made == set()
        # A range whose rows are gone has no folder; another one that changes later is found by the same ends.
        few = [r for r in rows if r[2] == "i0"]
        _, made = built(few, "e")
        _, made = built(rows, "f")
        with pytest.raises(ValueError, match="violates its keys"):
            built([*rows, rows[0]], "g")
        built([], "h")
        last, _ = built(rows, "i")
        snapshot.remove_old_builds(spark, path, -3600)
        assert builds(path) == [f"v={last}"]
        assert sorted(map(tuple, snapshot.read_snapshot(spark, path).observations.collect())) == sorted(rows)
        assert {f.partition("/")[0] for f in folders()} <= {last, first} | set(os.listdir(f"{path}/observations"))
        assert len(folders()) <= 8
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_exports_appear_whole(spark, panel, tmp_path):
    assert export.export_csv(panel.observations, f"{tmp_path}/facts", None) == panel.observations.count()
    with pytest.raises(FileExistsError):
        export.export_csv(panel.observations, f"{tmp_path}/facts", None)
    broken = panel.replace(observations=panel.observations.withColumn(
        "value", F.when(F.col("value") > 0, F.raise_error(F.lit("broken"))).otherwise(F.col("value"))))
    with pytest.raises(Exception, match="broken"):
        export.export_package(broken, ["che_gdp"], f"{tmp_path}/package")
    assert os.listdir(tmp_path) == ["facts"]
    export.export_package(panel, ["che_gdp"], f"{tmp_path}/package")
    assert sorted(os.listdir(tmp_path)) == ["facts", "package"]
    assert sorted(os.listdir(tmp_path / "package")) == ["availability", "codebook", "data", "readme"]


def test_grams_stand_in_segments(spark, panel, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "SEGMENT_CHARS", 120)
    rows = [(str(i), None if i % 7 == 0 else f"Name\u0130 {i * 37} of {i}", "AFR", "Low") for i in range(60)]
    entities = spark.createDataFrame(rows + rows[:3], panel.entities.schema)
    own = panel.replace(entities=entities)
    path = str(tmp_path / "grams")
    version = snapshot.build_snapshot(own, path, "a", check=False)
    lists = f"{path}/grams/{version}"
    read = snapshot.read_snapshot(spark, path)
    for source in ("name", "entity", "codebook"):
        wanted = posting_lists(own.searched_texts(source), "text", ["code"])
        index = read.gram_index(source)
        assert sorted(map(tuple, index.lists.collect())) == sorted(map(tuple, wanted.collect()))
        counted = wanted.groupBy("__gram").count()
        assert sorted(map(tuple, index.counts.collect())) == sorted(map(tuple, counted.collect()))
    # Grams of names are those of entities, not stored twice; a task's grams do not grow with the number of texts.
    assert sorted(os.listdir(lists))[-2:] == ["source=codebook", "source=entity"]
    lists = f"{lists}/source=entity/gram_lists"
    files = [name for name in os.listdir(lists) if name.endswith(".parquet")]
    assert len(files) >= 9
    for name in files:
        grams = [row[0].encode() for row in spark.read.parquet(f"{lists}/{name}").select("__gram").collect()]
        assert grams == sorted(grams)


def test_builds_of_the_same_texts_share_their_grams(spark, panel, tmp_path):
    path = str(tmp_path / "shared")
    rows = panel.entities.collect()
    frame = spark.createDataFrame

    def build(signature, entities):
        changed = panel.replace(entities=frame(entities, panel.entities.schema).repartition(3))
        version = snapshot.build_snapshot(changed, path, signature, check=False, retention=3600)
        index = snapshot.read_snapshot(spark, path).gram_index("entity")
        wanted = posting_lists(changed.searched_texts("entity"), "text", ["code"])
        assert sorted(map(tuple, index.lists.collect())) == sorted(map(tuple, wanted.collect()))
        made = f"{path}/grams/{version}"
        return version, sorted(os.listdir(made)) if os.path.exists(made) else []

    first, made = build("a", rows)
    assert made == ["source=codebook", "source=entity"]
    second, made = build("b", rows[::-1])
    assert made == []
    # Only the texts that changed are taken apart; repeated rows cancel in no hash.
    assert build("c", rows + rows[:1] * 2)[1] == build("d", rows + rows[1:2] * 2)[1] == ["source=entity"]
    snapshot.remove_old_builds(spark, path, -1)
    # The current build still uses the first one's grams of the codebook, nothing uses its grams of entities.
    assert os.listdir(f"{path}/grams/{first}") == ["source=codebook"] and len(os.listdir(f"{path}/grams")) == 2
    assert snapshot.read_snapshot(spark, path).gram_index("codebook").lists.count() > 0


def test_snapshot_prunes_and_pushes_down(spark, panel, tmp_path):
    path = str(tmp_path / "snap")
    snapshot.build_snapshot(panel, path, "a")
    facts = snapshot.read_snapshot(spark, path).observations
    plan = facts.where("indicator_code = 'che' and period >= 2023").select("value")
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    text = plan._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(indicator_code,che)" in text
    assert "GreaterThanOrEqual(period,2023)" in text
    assert "ReadSchema: struct<period:int,value:double,indicator_code:string>" in text


def test_package(spark, panel, tmp_path):
    path = str(tmp_path / "package")
    export.export_package(panel, ["che_gdp", "hc11", "che_gdp"], path, Selection(income="LMIC"))
    read = spark.read.option("header", True)
    assert read.csv(f"{path}/data").count() == 3
    assert codes(read.csv(f"{path}/codebook"), "indicator_code") == ["che_gdp", "hc11"]
    assert codes(read.csv(f"{path}/availability"), "observation_count") == ["3", "0"]
    assert "rows = 3" in codes(spark.read.text(f"{path}/readme"), "value")
