"""Versioned Parquet snapshots of a panel.

Layout: ``<path>/v=<hash>/<table>`` holds the data of one build, ``<path>/manifest/<number>.json`` one row per
finished build. A build writes its tables first and then claims the next number, which only one of several builders
can, so readers never see a half-written build, a failed one leaves the previous build current, and the highest number
is the one current build. Builds that are no longer current, and what failed ones left, go after a retention time.
Facts stand in ranges of their series (``<path>/observations/<version>/range=<n>``), and ``ranges`` of a build lists its
folders and a hash of each range: a later build writes only the ranges whose rows changed and shares the others. Observations are
range-partitioned by their key before the write, so that a hot indicator spreads over many files and a
filter on indicator, entity or period skips the rest by file statistics. Grams of names and codebook rows stand in
segments (``<path>/grams/<version>/source=<kind>``): each holds all grams of some of the texts, sorted by gram. ``grams`` of
a build names their folders with hashes of the texts: a later build of the same texts shares them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.dims import tables
from tidepanel.model import OBSERVATION_KEY, Panel
from tidepanel.plans import posting_lists
from tidepanel.plans.spread import tasks_for
from tidepanel.sources.load import require_keys
from tidepanel.sources.storage import delete, exists, listed, put_if_absent

SCHEMA_VERSION = 2
MANIFEST_SCHEMA = "signature string, schema_version int, version string, built_at timestamp, number bigint"
#: Seconds for which readers of an earlier build, and builders at work, are left alone.
RETENTION = 7 * 24 * 3600
FACTS = "observations"
TABLES = (FACTS, "entities", "indicators", "notes", "memberships", "relations", "version_lines")
SERIES = OBSERVATION_KEY[:2]
FACT_SCHEMA = "entity_code string, period int, value double, indicator_code string"
#: Ranges that facts are compared by, at most; a range may cover several folders of the first build.
MOST_RANGES = 256
RANGE_SCHEMA = ("range int, indicator_code string, entity_code string, folder string, rows bigint, hash_1 bigint, "
                "hash_2 bigint")
NOTHING = (0, None, None)
GRAMS, GRAM_LISTS, GRAM_COUNTS = "grams", "gram_lists", "gram_counts"
GRAM_SCHEMA = "source string, folder string, chars bigint, texts bigint, hash bigint, low bigint, high bigint"
#: Texts whose grams are stored; those of names are among those of entities.
INDEXED = ("entity", "codebook")
#: Characters of the texts of one segment of grams on average, at most and, if a shuffle has the tasks, at least.
SEGMENT_CHARS, LEAST_CHARS = 500_000, 20_000
COUNTED = (FACTS, "entities", "indicators", "notes")


def source_signature(spark: SparkSession, *paths: str) -> str:
    """Signature of source files: schema version, paths, sizes and modification times.

    The file listing is hashed by Spark; file contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    file_hash = F.xxhash64("path", "length", "modificationTime")
    row = files.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("size"),
        F.bit_xor(file_hash).alias("hash"),
    ).head()
    return f"{SCHEMA_VERSION}|{','.join(paths)}|{row['n']}|{row['size']}|{row['hash']}"


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """All finished builds, or None before the first."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")
    except AnalysisException:
        return None


def current_build(spark: SparkSession, path: str):
    """The newest manifest row, or None."""
    builds = manifest(spark, path)
    if builds is None:
        return None
    return builds.orderBy(F.desc_nulls_last("number"), F.desc("built_at"), F.desc("version")).head()


def is_current(spark: SparkSession, path: str, signature: str) -> bool:
    build = current_build(spark, path)
    return (
        build is not None
        and build["signature"] == signature
        and build["schema_version"] == SCHEMA_VERSION
    )


# ---- ranges of facts ----------------------------------------------------------------------------------------


def _range_of(lowers: Sequence[tuple[str, str]]) -> Column:
    """The number of the range of a row's series, by halving the list of lower ends."""
    indicator, entity = F.col(SERIES[0]), F.col(SERIES[1])

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        first, second = lowers[middle]
        below = (indicator < first) | ((indicator == first) & (entity < second))
        return F.when(below, pick(low, middle - 1)).otherwise(pick(middle, high))

    return pick(0, max(len(lowers) - 1, 0))


def _hash_columns() -> list[Column]:
    """Rows and two hashes of a group of facts, whatever the order of its rows."""
    columns = (*OBSERVATION_KEY, "value")
    return [F.count(F.lit(1)).alias("rows"),
            *[F.bit_xor(F.xxhash64(F.lit(seed), *columns)).alias(f"hash_{seed}") for seed in (1, 2)]]


def _hashes(ranged: DataFrame) -> dict[int, tuple]:
    """Rows and two hashes of each range; at most ``MOST_RANGES`` rows come back."""
    rows = ranged.groupBy("range").agg(*_hash_columns()).collect()
    return {row["range"]: (row["rows"], row["hash_1"], row["hash_2"]) for row in rows}


def _write_ranges(ranged: DataFrame, folder: str) -> DataFrame:
    """Write facts with their ``range``, each range sorted by the key, and read them again."""
    ordered = ranged.sortWithinPartitions("range", *OBSERVATION_KEY)
    ordered.write.mode("errorifexists").partitionBy("range").parquet(folder)
    return ranged.sparkSession.read.schema(f"{FACT_SCHEMA}, range int").parquet(folder)


def _first_ranges(facts: DataFrame, path: str, version: str) -> list[tuple]:
    """Write all facts, and make ranges of the partitions in which their series were sorted."""
    parts = facts.repartitionByRange(*SERIES).withColumn("range", F.spark_partition_id())
    written = _write_ranges(parts, f"{path}/{FACTS}/{version}")
    # One pass for lower ends and hashes: a series lies in one folder, and folders follow each other in order.
    firsts = written.groupBy("range").agg(
        F.min(F.struct(*SERIES)).alias("low"), *_hash_columns()).orderBy("range").collect()
    number = {row["range"]: i * min(MOST_RANGES, len(firsts)) // len(firsts) for i, row in enumerate(firsts)}
    lowers, hashes = {}, {}
    for row in firsts:
        i = number[row["range"]]
        lowers.setdefault(i, tuple(row["low"]))
        n, first, second = hashes.get(i, (0, 0, 0))
        hashes[i] = (n + row["rows"], first ^ row["hash_1"], second ^ row["hash_2"])
    return [(number[row["range"]], *lowers[number[row["range"]]], f"{version}/range={row['range']}",
             *hashes[number[row["range"]]]) for row in firsts]


def _changed_ranges(facts: DataFrame, path: str, version: str, before: list[tuple]) -> list[tuple]:
    """Write the ranges whose rows differ from those of an earlier build, and take the others from there."""
    lowers = {row[0]: row[1:3] for row in before}
    known = {row[0]: row[4:] for row in before}
    ranged = facts.withColumn("range", _range_of([lowers[i] for i in sorted(lowers)]))
    hashes = _hashes(ranged)
    changed = sorted(i for i in lowers if hashes.get(i, NOTHING) != known[i])
    if changed:
        rows = ranged.where(F.col("range").isin(changed)).repartitionByRange("range", *SERIES)
        _write_ranges(rows, f"{path}/{FACTS}/{version}")
    # A range without rows keeps its place, without a folder.
    return [row for row in before if row[0] not in changed] + [
        (i, *lowers[i], f"{version}/range={i}" if i in hashes else None, *hashes.get(i, NOTHING)) for i in changed]


def _ranges(spark: SparkSession, location: str) -> list[tuple]:
    """The ranges of a build: number, lower end, folder, rows and hashes; at most one row per folder."""
    return [tuple(row) for row in spark.read.schema(RANGE_SCHEMA).parquet(f"{location}/ranges").collect()]


def _write_facts(facts: DataFrame, path: str, version: str, before: list[tuple]) -> list[str]:
    """Write what is new of the facts and the list of ranges; the folders that were written."""
    rows = _changed_ranges(facts, path, version, before) if before else _first_ranges(facts, path, version)
    spark = facts.sparkSession
    spark.createDataFrame(rows, RANGE_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(f"{path}/v={version}/ranges")
    return [row[3] for row in rows if row[3] and row[3].startswith(version)]


def _facts(spark: SparkSession, path: str, folders: Sequence[str]) -> DataFrame:
    read = spark.read.schema(FACT_SCHEMA)
    facts = read.parquet(*[f"{path}/{FACTS}/{folder}" for folder in folders]) if folders else \
        spark.createDataFrame([], FACT_SCHEMA)
    return facts.select("entity_code", "period", "indicator_code", "value")


def _state(texts: DataFrame) -> tuple:
    """Characters, rows and hashes of texts, whatever their order; sums tell repeated rows, which ``bit_xor`` does not."""
    columns = [column for name in texts.columns for column in (F.col(name).isNull(), F.col(name))]
    first, second = F.xxhash64(F.lit(1), *columns), F.xxhash64(F.lit(2), *columns)
    sums = [F.length("text").cast("bigint"), first.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright(first, 32)]
    chars, low, high = [F.coalesce(F.sum(column), F.lit(0)) for column in sums]
    return tuple(texts.agg(chars, F.count(F.lit(1)), F.coalesce(F.bit_xor(second), F.lit(0)), low, high).first())


def _grams(spark: SparkSession, location: str) -> list[tuple]:
    """The grams of a build: source, folder, and the state of the texts; none if it was built without this list."""
    if not exists(spark, f"{location}/{GRAMS}/_SUCCESS"):
        return []
    return [tuple(row) for row in spark.read.schema(GRAM_SCHEMA).parquet(f"{location}/{GRAMS}").collect()]


def _write_grams(panel: Panel, path: str, version: str, before: list[tuple]) -> None:
    """The grams of all searched texts in segments, each sorted by gram, and how many texts, and names, have each.

    Grams stay in the task that takes their texts apart: nothing made of a text is shuffled, or made a second time for
    a sample of it. ``name_at`` is where the name begins in the text of an entity, if it has the gram. Grams of texts
    that an earlier build has are taken from there.
    """
    spark = panel.spark
    known = {(source, *state): folder for source, folder, *state in before}
    rows = []
    for source in INDEXED:
        texts = panel.searched_texts(source)
        state = _state(texts)
        folder = known.get((source, *state))
        if folder is None:
            folder = f"{version}/source={source}"
            target = f"{path}/{GRAMS}/{folder}"
            tasks = tasks_for(spark, state[0], SEGMENT_CHARS, LEAST_CHARS)
            if source == "entity":
                start = F.length("text") - F.length("name") + 1
                lists = posting_lists(texts, "text", ["code", "name"], tasks=tasks).withColumn(
                    "name_at", F.when(F.contains("name", "__gram"), start)).drop("name")
            else:
                lists = posting_lists(texts, "text", ["code"], tasks=tasks).withColumn(
                    "name_at", F.lit(None).cast("int"))
            lists.sortWithinPartitions("__gram").write.mode("errorifexists").parquet(f"{target}/{GRAM_LISTS}")
            counts = spark.read.schema(lists.schema).parquet(f"{target}/{GRAM_LISTS}").groupBy("__gram").agg(
                F.count(F.lit(1)).alias("__texts"), F.count("name_at").alias("__names"))
            counts.write.mode("errorifexists").parquet(f"{target}/{GRAM_COUNTS}")
        rows.append((source, folder, *state))
    spark.createDataFrame(rows, GRAM_SCHEMA).coalesce(1).write.mode("errorifexists").parquet(
        f"{path}/v={version}/{GRAMS}")


def _stored_grams(spark: SparkSession, location: str, table: str) -> DataFrame | None:
    """The lists or the counts of a build's grams with their source; an older build has them in its own folder."""
    grams = _grams(spark, location)
    if not grams:
        return _optional(spark, f"{location}/{table}")
    path = location.rpartition("/")[0]
    return reduce(DataFrame.unionByName, [
        spark.read.parquet(f"{path}/{GRAMS}/{folder}/{table}").withColumn("source", F.lit(source))
        for source, folder, *_ in grams])


def _commit(spark: SparkSession, path: str, version: str, signature: str) -> str:
    """Make a written build current and return the version that is: another one, if that has the same signature."""
    while True:
        build = current_build(spark, path)
        if build and build["signature"] == signature and build["schema_version"] == SCHEMA_VERSION:
            return build["version"]
        number = (build["number"] or 0) + 1 if build else 1
        entry = {
            "signature": signature, "schema_version": SCHEMA_VERSION, "version": version, "number": number,
            "built_at": datetime.now(timezone.utc).isoformat(),
        }
        if put_if_absent(spark, f"{path}/manifest/{number:012d}.json", json.dumps(entry) + "\n"):
            return version
        # Somebody else took the number: look again who is current.


def build_snapshot(
    panel: Panel, path: str, signature: str, check: bool = True, retention: float = RETENTION
) -> str:
    """Write the panel as a new build unless the current one has the same signature.

    Returns the version that is current afterwards. A build whose keys turn out to be violated never becomes current
    and is removed. Of two builders with one signature the first to finish is kept; with different ones the last to
    finish is current. Facts are compared with the current build's by ranges, and only ranges that differ are written.
    Builds not current for ``retention`` seconds are removed.
    """
    spark = panel.spark
    build = current_build(spark, path)
    current = build is not None and build["schema_version"] == SCHEMA_VERSION
    if current and build["signature"] == signature:
        return build["version"]
    version = hashlib.sha256(f"{signature}|{uuid.uuid4().hex}".encode()).hexdigest()[:16]
    target = f"{path}/v={version}"
    try:
        for name in TABLES[1:]:
            table = getattr(panel, name)
            if table is not None:
                table.write.mode("errorifexists").parquet(f"{target}/{name}")
        # Of the written names and rows: their sources are not computed a second time.
        _write_grams(panel.replace(**{
            name: spark.read.parquet(f"{target}/{name}") for name in ("entities", "indicators")}), path, version,
            _grams(spark, f"{path}/v={build['version']}") if current else [])
        before = _ranges(spark, f"{path}/v={build['version']}") if current else []
        written = _write_facts(panel.observations, path, version, before)
        if check:
            # On the written columns: the sources are not computed a second time. Ranges taken over were checked before.
            require_keys(_read_build(spark, target).replace(observations=_facts(spark, path, written)))
        current = _commit(spark, path, version, signature)
    except BaseException:
        _drop(spark, path, version)
        raise
    if current != version:
        _drop(spark, path, version)
    remove_old_builds(spark, path, retention)
    return current


def _drop(spark: SparkSession, path: str, version: str) -> None:
    delete(spark, f"{path}/v={version}")
    delete(spark, f"{path}/{FACTS}/{version}")
    delete(spark, f"{path}/{GRAMS}/{version}")


def remove_old_builds(spark: SparkSession, path: str, retention: float = RETENTION) -> list[str]:
    """Remove builds that another one replaced over ``retention`` seconds ago, and unfinished ones as old; their names.

    A build is as old as the one that replaced it, so readers of the former current build have the whole time. The
    current build stays whatever its age.
    """
    builds = manifest(spark, path)
    if builds is None:
        return []
    now = datetime.now(timezone.utc).timestamp()
    finished = builds.select("version", "number", F.unix_micros("built_at").alias("at")).orderBy(
        F.asc_nulls_first("number"), "at", "version").collect()
    replaced = {build["version"]: after["at"] / 1e6 for build, after in zip(finished, finished[1:])}
    current = finished[-1]["version"]
    removed = []
    for name, changed in listed(spark, path):
        version = name.removeprefix("v=")
        if name.startswith("v=") and version != current and now - replaced.get(version, changed) > retention:
            delete(spark, f"{path}/{name}")
            removed.append(version)
    left = [f"{path}/{name}" for name, _ in listed(spark, path) if name.startswith("v=")]
    ranges = [row[3] for build in left if exists(spark, f"{build}/ranges/_SUCCESS") for row in _ranges(spark, build)]
    _remove_unused(spark, f"{path}/{FACTS}", ranges, now - retention)
    _remove_unused(spark, f"{path}/{GRAMS}", [row[1] for build in left for row in _grams(spark, build)], now - retention)
    return removed


def _remove_unused(spark: SparkSession, path: str, folders: Sequence[str | None], until: float) -> None:
    """Remove folders of shared rows that no build lists and that were last changed before ``until``."""
    used = {folder for folder in folders if folder}
    kept = {folder.partition("/")[0] for folder in used}
    for version, changed in listed(spark, path):
        if changed >= until:
            continue
        if version not in kept:
            delete(spark, f"{path}/{version}")
            continue
        for name, _ in listed(spark, f"{path}/{version}"):
            if "=" in name and f"{version}/{name}" not in used:
                delete(spark, f"{path}/{version}/{name}")


def _optional(spark: SparkSession, location: str) -> DataFrame | None:
    try:
        return spark.read.parquet(location)
    except AnalysisException:
        return None


def _read_build(spark: SparkSession, location: str) -> Panel:
    folders = [row[3] for row in _ranges(spark, location) if row[3]]
    return Panel(
        observations=_facts(spark, location.rpartition("/")[0], folders),
        entities=lambda: spark.read.parquet(f"{location}/entities"),
        indicators=lambda: spark.read.parquet(f"{location}/indicators"),
        **{name: _optional(spark, f"{location}/{name}") for name in TABLES[3:]},
        gram_lists=lambda: _stored_grams(spark, location, GRAM_LISTS),
        gram_counts=lambda: _stored_grams(spark, location, GRAM_COUNTS),
    )


def read_snapshot(spark: SparkSession, path: str) -> Panel:
    """The panel of the current build; filters on indicator, entity and period are pushed down to sorted files."""
    build = current_build(spark, path)
    if build is None:
        raise ValueError(f"No snapshot at {path}.")
    return _read_build(spark, f"{path}/v={build['version']}")


def snapshot_status(spark: SparkSession, path: str, signature: str | None = None) -> DataFrame:
    """``(item, value)``: row counts of the four tables, signature, build time, whether it is current."""
    build = current_build(spark, path)
    if build is None:
        raise ValueError(f"No snapshot at {path}.")
    panel = read_snapshot(spark, path)
    facts = [
        ("signature", build["signature"]),
        ("schema_version", str(build["schema_version"])),
        ("version", build["version"]),
        ("built_at", build["built_at"].isoformat()),
    ]
    if signature is not None:
        same = build["signature"] == signature and build["schema_version"] == SCHEMA_VERSION
        facts.append(("is_current", str(same).lower()))
    status = tables.literal_table(spark, {"item": tables.TEXT, "value": tables.TEXT}, facts)
    for name in COUNTED:
        table = panel.source_notes if name == "notes" else getattr(panel, name)
        counted = table.agg(F.count(F.lit(1)).cast("string").alias("value"))
        status = status.unionByName(counted.select(F.lit(name).alias("item"), "value"))
    return status


def version_lines(spark: SparkSession, path: str) -> DataFrame:
    """The source's version lines in order; none when the source had none."""
    lines = read_snapshot(spark, path).version_lines
    if lines is None:
        return tables.literal_table(spark, {"line_no": tables.INT, "text": tables.TEXT}, [])
    return lines.orderBy("line_no")
