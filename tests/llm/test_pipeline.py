"""Every stage of the corpus pipeline against brute force on what the stage before it kept."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from oracle import TABLES, connect
from test_corpus_operators import decoded, plain_fingerprint
from test_row_operators import substring_distance

import __spark_entry__
import corpus_pipeline
from tidepanel.llm import decontaminate, quality, queries, tokens
from tidepanel.llm.common import saved, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, then what each stage returned."""
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(saved(stage(spark, out[-1], SF), name))
    return out


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_all_but_the_last_keep_the_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, stages):
    weights, bias = quality.train(stages[0], table(spark, SF, "labels"))
    expected = Counter()
    for row in stages[0].collect():
        slots = quality.features([(row.text or "").encode()])[1]
        if bias + (quality.SCALE * np.mean(weights[slots]) if len(slots) else 0) >= 0:
            expected[tuple(row)] += 1
    assert rows_of(stages[1]) == expected
    poor = {r.doc_id for r in table(spark, SF, "labels").where("quality = 0").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert 0 < stages[1].count() < stages[0].count() and len(poor & kept) < 0.5 * len(poor)


def test_dedup_stage(stages):
    rows = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    group = {}
    for row in rows:
        near = {group[d] for d in group if (prints[d] ^ prints[row.doc_id]).bit_count() <= 3}
        group[row.doc_id] = row.doc_id
        for d, g in list(group.items()):
            if g in near or d == row.doc_id:
                group[d] = min([*near, row.doc_id])
    expected = Counter(tuple(r) for r in rows if group[r.doc_id] == r.doc_id)
    assert rows_of(stages[2]) == expected


def test_decontamination_stage(spark, stages):
    items = [decontaminate.normalised(r.text) for r in table(spark, SF, "benchmark").collect()]
    expected = Counter()
    for row in stages[2].collect():
        text = decontaminate.normalised(row.text)
        # With these budgets a match leaves some stretch of eleven characters untouched; then the full table.
        close = [i for i in items if any(i[k:k + 11] in text for k in range(len(i) - 10))]
        if not any(substring_distance(f" {i} ", f" {text} ") <= decontaminate.budget(len(i)) for i in close):
            expected[tuple(row)] += 1
    assert rows_of(stages[3]) == expected


def test_mixing_stage(stages):
    connection = duckdb.connect()
    connection.register("documents", stages[3].toPandas())
    taken = {r[0]: r[4] // r[1] if r[1] else 0
             for r in connection.execute(queries.ORACLES["op9_source_mixing"]).fetchall()}
    expected = Counter()
    for row in stages[3].collect():
        if taken[row.doc_id]:
            expected[tuple(row)] += int(taken[row.doc_id])
    assert rows_of(stages[4]) == expected


def test_token_stage(stages):
    rows = stages[5].collect()
    assert sorted(r.slot for r in rows) == list(range(stages[4].count()))
    out, _ = decoded(tokens.write_training_order(stages[4]), tokens.ROW_TOKENS)
    assert Counter(out.values()) == Counter((r.doc_id, r.text or "") for r in stages[4].collect())


def test_run_returns_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[5].columns
    count = Counter((r.doc_id, r.n_tokens) for r in got.collect())
    assert count == Counter((r.doc_id, r.n_tokens) for r in stages[5].collect())


def test_empty_and_awkward_tables(spark, stages, edge_docs, no_docs, tmp_path):
    folder = str(tmp_path)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{folder}/{name}.parquet")
    for docs in (no_docs, edge_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, folder), name)
        docs.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    with connect(SF) as connection:
        result = connection.execute(queries.ORACLES[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(frame.columns)
        expected = Counter(tuple(r[columns.index(c)] for c in frame.columns) for r in result.fetchall())
    assert rows_of(frame) == expected


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in names and set(queries.ORACLES) <= set(__spark_entry__.oracle_sql())
    assert "documents" in TABLES
