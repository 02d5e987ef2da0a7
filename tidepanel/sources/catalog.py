"""Document catalogs: nested folder trees, newest document per series, changes since last time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import dotnet_millis, starts_with_text
from tidepanel.plans import spread

# Field of the tree -> our column. ``DateModified`` stays as text beside its milliseconds, because
# a change of the raw text counts as a change.
FIELDS = {
    "Identifier": "doc_id bigint",
    "Name": "name string",
    "Description": "description string",
    "FileType": "file_type string",
    "FileName": "file_name string",
    "FileSize": "size bigint",
    "DateModified": "modified_raw string",
}
COMPARED = ("doc_id", "size", "modified_raw", "name")
NODE = "IsFolder boolean, " + ", ".join(f"{name} {column.split()[1]}" for name, column in FIELDS.items())
STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TEXT = rf'(?:{STRING}|[^\[\]{{}}"]++)++'
#: An object with what stands before the list of its children, and the bracket that opens the list.
PARENT = rf'\{{(?:{TEXT})?+(?<="Children"\s{{0,8}}:\s{{0,8}})\[\s*+'
#: An opening bracket if there is one, the text behind it (strings may hold brackets), and closing brackets.
PIECE = rf"[\[{{](?:{TEXT})?+[\]}}]*+|{TEXT}[\]}}]*+|[\]}}]++"
#: Parents within each other, or none, and a piece behind them: levels change in a row and are followed in one step.
TOKEN = rf"(?:{PARENT})++(?:[\[{{](?:{TEXT})?+)?+[\]}}]*+|{PIECE}"
_NAME, _STRING, _NUMBER = (r'[^"\\\x00-\x1f]{0,1000}+"[ \t\r\n]*+:[ \t\r\n]*+', r'"[^"\\\x00-\x1f]{0,10000}+"', r"null|0|[1-9][0-9]{0,8}")
_FIELD = rf'[ \t\r\n]*+"(?:(?!IsFolder"|Identifier"|FileSize"){_NAME}(?:{_STRING}|true|false|{_NUMBER})|(?:Identifier|FileSize)"[ \t\r\n]*+:[ \t\r\n]*+(?:{_NUMBER}))[ \t\r\n]*+'
#: A folder whose fields are plain: it is no file, whatever parsing it would give.
FOLDER = rf'^\{{(?:{_FIELD},)*+[ \t\r\n]*+"IsFolder"[ \t\r\n]*+:[ \t\r\n]*+true[ \t\r\n]*+(?:,{_FIELD})*+\}}$'
CLOSING, LIST_END = "]}", "[ \t\n\x0b\f\r"
CHILDREN, VALUE = r'"Children"\s*:\s*$', r":\s*$"
#: Arrays and objects up to so many levels are taken from the fields they are values of before a tree is taken apart.
SHALLOW = 4
#: Tasks for trees, times the session's shuffle partitions: tokens take many times a tree's bytes.
SHARE = 4
#: Bits of a sorting key that tell a token's place in its tree.
PLACE_BITS = 32
OBJECT, LIST, PARENTS = 1, 2, 3


def _field_values() -> str:
    """A pattern of all text up to an array or object that is the value of a field other than ``Children``, and of this
    value, if it has few levels; one match follows the other, so that a quote always begins a string."""
    value = rf'[\[{{](?:{TEXT})?+[\]}}]'
    for _ in range(SHALLOW - 1):
        value = rf'[\[{{](?:{TEXT}|{value})*+[\]}}]'
    value += r'(?!"?[\[{])'
    foreign = rf'{STRING}(?:\s*+:\s*+(?=\{{)|(?<!"Children")\s*+:\s*+(?=\[))'
    other = rf'[^"]++|{STRING}(?!\s*+:\s*+[\[{{])|{STRING}(?<="Children")(?=\s*+:\s*+\[)|{foreign}(?!{value})'
    return rf'\G((?:{other})*+{foreign}){value}'


def _held(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns. Exploding an array of one keeps those that use them from computing them again."""
    for name, column in columns.items():
        rows = rows.select("*", F.explode(F.array(column)).alias(name))
    return rows


def _places(start: Column, end: Column) -> Column:
    """Places from one up to, but not including, another. (``slice`` would copy all of an array for each part of it.)"""
    return F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def _let(value: Column, result) -> Column:
    """A function of a value that is computed once, however often the function names it."""
    return F.get(F.transform(F.array(value), result), F.lit(0))


def _opens(piece: Column) -> Column:
    parents = F.endswith(F.rtrim(piece, F.lit(LIST_END[1:])), F.lit("["))
    return F.when(F.startswith(piece, F.lit("{")), F.when(parents, PARENTS).otherwise(OBJECT)).when(
        F.startswith(piece, F.lit("[")), LIST).otherwise(0)


def _steps(tokens: str, pieces: str) -> Column:
    """Levels that each token opens and closes, and the first of them that is foreign, 0 if none is.

    A node is the outermost object, or an object in the ``Children`` array of a node. Brackets that open anything else
    are foreign, with all that they enclose.
    """
    def step(own: Column, at: Column) -> Column:
        first, last, before = F.get(own, F.lit(0)), F.element_at(own, -1), F.coalesce(F.get(tokens, at - 1), F.lit(""))
        return _let(F.struct(F.size(own).alias("size"), last.alias("last"), _opens(last).alias("opens")), lambda end: F.struct(
            F.when(end["opens"] == PARENTS, 2 * end["size"]).when(end["opens"] > 0, 2 * end["size"] - 1)
            .otherwise(2 * end["size"] - 2).alias("opened"),
            (F.length(end["last"]) - F.length(F.rtrim(end["last"], F.lit(CLOSING)))).alias("closed"),
            F.when(F.startswith(first, F.lit("{")) & before.rlike(VALUE), 1)
            .when(F.startswith(first, F.lit("[")) & ~before.rlike(CHILDREN), 1)
            .when((end["opens"] == LIST) & (end["size"] > 1), 2 * end["size"] - 1).otherwise(0).alias("foreign")))
    return F.transform(pieces, step)


def _levels(steps: str) -> Column:
    """The level before each token and that of the outermost foreign bracket that is open behind it, 0 if none is, and
    the level after the last.

    What is found is put together in stretches of the root of the tokens' number, as an array is copied for each element
    added.
    """
    def follow(state: Column, at: Column) -> Column:
        step = F.get(steps, at)
        foreign = F.when(state["foreign"] > 0, state["foreign"]).when(
            step["foreign"] > 0, F.greatest(state["level"] + step["foreign"], F.lit(0))).otherwise(0)
        now = F.struct(state.alias("before"), foreign.alias("foreign"),
                       (state["level"] + step["opened"] - step["closed"]).alias("level"))
        return _let(now, lambda now: F.struct(
            now["level"].alias("level"),
            F.when(now["foreign"] > now["level"], 0).otherwise(now["foreign"]).alias("foreign"),
            F.concat(now["before"]["found"], F.array(F.struct(
                now["before"]["level"].alias("level"), now["foreign"].alias("foreign")))).alias("found")))

    def follow_stretch(state: Column, first: Column) -> Column:
        start = F.struct(state["level"].alias("level"), state["foreign"].alias("foreign"), none.alias("found"))
        stretch = _places(first, F.least(first + number, F.size(steps)))
        return _let(F.aggregate(stretch, start, follow), lambda end: F.struct(
            end["level"].alias("level"), end["foreign"].alias("foreign"),
            F.concat(state["found"], F.array(end["found"])).alias("found")))

    none = F.array().cast("array<struct<level:int,foreign:int>>")
    number = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("foreign"),
                     F.array().cast("array<array<struct<level:int,foreign:int>>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.size(steps), number), start, follow_stretch, lambda end: F.struct(
        F.flatten(end["found"]).alias("found"), end["level"].alias("rest")))


def _elements(pieces: str, found: str) -> Column:
    """``(level, opens, text)`` of all pieces in order; the level is null within foreign brackets."""
    def element(piece: Column, before: Column, at: Column) -> Column:
        known = F.struct(piece.alias("piece"), _opens(piece).alias("opens"))
        return _let(known, lambda k: _let(before["level"] + 2 * at + F.when(k["opens"] > 0, 1).otherwise(0), lambda level: F.struct(
            F.when((before["foreign"] == 0) | (level < before["foreign"]), level).alias("level"),
            k["opens"].alias("opens"),
            F.when(k["opens"] == PARENTS, F.substr(F.rtrim(k["piece"], F.lit(LIST_END)), F.lit(2)))
            .when(k["opens"] > 0, F.substr(F.rtrim(k["piece"], F.lit(CLOSING)), F.lit(2)))
            .otherwise(F.rtrim(k["piece"], F.lit(CLOSING))).alias("text"))))

    return F.flatten(F.transform(pieces, lambda own, i: F.transform(
        own, lambda piece, at: element(piece, F.get(found, i), at))))


def _keys(elements: str) -> Column:
    """Level and place of the elements outside foreign brackets, sorted; between two places is that of a parent's list.

    As a rule objects stand at odd levels and lists at even ones, whose text is nobody's. In broken trees both may stand
    at a level: there all text is kept, behind the bracket that opens it, be it that of a list.
    """
    def key(level: Column, place: Column) -> Column:
        return F.shiftleft(level.cast("bigint"), PLACE_BITS) + place

    def known(chosen=lambda e: F.lit(True), own=0) -> Column:
        return F.transform(elements, lambda e, at: F.when((e["level"] > -own) & chosen(e), key(e["level"] + own, 2 * at + own)))

    mixed = F.exists(elements, lambda e: (e["level"] >= 0) & F.when(e["level"] % 2 == 0, e["opens"].isin(OBJECT, PARENTS))
                     .otherwise(e["opens"] == LIST))
    return F.sort_array(F.array_compact(
        F.when(mixed, F.concat(known(), known(lambda e: e["opens"] == PARENTS, 1)))
        .otherwise(known(lambda e: (e["opens"] > 0) | (e["level"] % 2 == 1)))))


def _nodes(trees: DataFrame, tree: str, keep: Sequence[str]) -> DataFrame:
    """``(kept, nodes)``: the nodes of every tree as they open, with their level and fields, which plain folders lack.

    Everything is arrays of a tree's tokens, in a number of passes that does not depend on the depth: tokens are neither
    rows nor shuffled. Sorted by level and place, a node's own text stands behind the bracket that opens it.
    """
    text = F.ltrim(F.col(tree), F.lit(" \t\r\n"))
    texts = trees.where(F.startswith(text, F.lit("{"))).select(
        F.monotonically_increasing_id().alias("tree"), F.struct(F.lit(True).alias("__here"), *keep).alias("kept"),
        text.alias("text"))
    # Whole trees are dealt out, before they are taken apart.
    rows = spread(texts, "tree", share=SHARE).select("kept", "text")
    plain = F.regexp_replace("text", F.lit(_field_values()), F.lit("$1null"))
    rows = _held(rows, tokens=F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))).drop("text")
    rows = _held(rows, pieces=F.transform("tokens", lambda t: F.regexp_extract_all(t, F.lit(f"{PARENT}|{PIECE}"), F.lit(0))))
    rows = _held(rows, steps=_steps("tokens", "pieces")).drop("tokens")
    rows = _held(rows, levels=_levels("steps")).where("levels.rest = 0").drop("steps")
    rows = _held(rows, elements=_elements("pieces", "levels.found")).drop("pieces", "levels")
    place = (1 << PLACE_BITS) - 1

    def sorted_element(key: Column) -> Column:
        return _let(key.bitwiseAND(place).cast("int"), lambda at: _let(F.get("elements", F.shiftright(at, 1)), lambda e: F.struct(
            at.alias("at"), e["level"].alias("level"), F.when(at % 2 == 1, LIST).otherwise(e["opens"]).alias("opens"),
            F.when(at % 2 == 1, "").otherwise(e["text"]).alias("text"))))

    rows = _held(rows, sorted=F.transform(_keys("elements"), sorted_element)).drop("elements")
    rows = _held(rows, openers=F.array_compact(F.transform("sorted", lambda e, i: F.when(e["opens"] > 0, i))))

    def node(start: Column, number: Column) -> Column:
        after = F.coalesce(F.get("openers", number + 1), F.size("sorted"))
        # Between two pieces of a node's own text stands one array or object.
        pieces = F.filter(F.transform(_places(start, after), lambda i: F.get("sorted", i)["text"]), lambda text: text != "")
        return _let(F.get("sorted", start), lambda first: F.when(first["opens"] != LIST, F.struct(
            first["at"].alias("at"), first["level"].alias("level"),
            F.when(after == start + 1, first["text"]).otherwise(F.array_join(pieces, "null")).alias("text"))))

    def parsed(text: Column) -> Column:
        whole = F.concat(F.lit("{"), text, F.when(text.rlike(VALUE), "null").otherwise(""), F.lit("}"))
        return _let(whole, lambda node: F.when(~node.rlike(FOLDER), F.from_json(node, NODE)))

    nodes = _held(rows, nodes=F.array_sort(F.array_compact(F.transform("openers", node)))).drop("sorted", "openers")
    return nodes.select("kept", F.transform("nodes", lambda n: F.struct(
        n["level"].alias("level"), parsed(n["text"]).alias("node"))).alias("nodes"))


def flatten_catalog(
    trees: DataFrame, tree: str = "tree", keep: Sequence[str] = (), max_depth: int | None = None
) -> DataFrame:
    """One row per file of every JSON tree, however deep the trees nest.

    ``position`` numbers the files of a tree depth first, as a reader would list them: in the order in which they
    open. Columns in ``keep`` are carried along. Deeper nodes than ``max_depth``, if given, are an error. A text that
    is no object, or whose brackets don't balance, has no files; a field that holds an object or array is null.
    """
    nodes = _nodes(trees, tree, keep)
    if max_depth is not None:
        message = F.lit(f"the catalog nests deeper than {max_depth} levels")
        deep = F.exists("nodes", lambda n: n["level"] > 2 * max_depth + 1)
        nodes = nodes.where(F.when(deep, F.raise_error(message)).otherwise(F.lit(True)))
    files = F.filter(F.transform("nodes", lambda n: n["node"]),
                     lambda n: n.isNotNull() & ~F.coalesce(n["IsFolder"], F.lit(False)))
    return nodes.select("kept", F.posexplode(files).alias("position", "node")).select(
        *[F.col("kept")[name].alias(name) for name in keep],
        "position",
        *[F.col("node")[name].alias(column.split()[0]) for name, column in FIELDS.items()],
    ).withColumn("modified_ms", dotnet_millis(F.col("modified_raw")))


def latest_document(
    catalog: DataFrame,
    prefix: str,
    extension: str,
    series: Sequence[str] = (),
) -> DataFrame:
    """Newest document of each series whose name has the prefix and whose type is the extension.

    Prefix and extension ignore case; documents without an id are left out; a missing date counts as
    0. Among equally new documents the first in the catalog wins. Without ``series`` the whole catalog
    is one series.
    """
    fits = (
        starts_with_text(F.col("name"), prefix)
        & (F.lower(F.coalesce("file_type", F.lit(""))) == extension.lower())
        & F.col("doc_id").isNotNull()
        & (F.col("doc_id") != 0)
    )
    columns = [name for name in catalog.columns if name not in series]
    newest = F.max_by(
        F.struct(*columns), F.struct(F.col("modified_ms"), -F.col("position"), -F.col("doc_id"))
    )
    found = catalog.where(fits)
    if series:
        return found.groupBy(*series).agg(newest.alias("doc")).select(*series, "doc.*")
    return found.agg(newest.alias("doc")).where("doc is not null").select("doc.*")


def require_latest(catalog: DataFrame, prefix: str, extension: str) -> DataFrame:
    """``latest_document`` of a whole catalog, or an error when nothing fits."""
    newest = latest_document(catalog, prefix, extension)
    if newest.isEmpty():
        raise ValueError(f"No document named '{prefix}...' of type {extension} in the catalog.")
    return newest


def catalog_changes(old: DataFrame, new: DataFrame, series: Sequence[str]) -> DataFrame:
    """Per series: whether id, size, raw date or name differ between two catalogs (null equals null).

    A series only one side has counts as changed.
    """

    def side(df: DataFrame, mark: str) -> DataFrame:
        return df.select(
            *series, *[F.col(name).alias(f"{mark}_{name}") for name in COMPARED],
            F.lit(True).alias(f"__{mark}"),
        )

    joined = side(old, "old").join(side(new, "new"), list(series), "full")
    changed = F.col("__old").isNull() | F.col("__new").isNull()
    for name in COMPARED:
        changed = changed | ~F.col(f"old_{name}").eqNullSafe(F.col(f"new_{name}"))
    return joined.withColumn("changed", changed).drop("__old", "__new")
