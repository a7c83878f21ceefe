"""CSV, JSON and Markdown exports and versioned snapshots of the aggregates.

A report is a table of lines ordered by (section, part, rank, name): part 0 is the heading, 1 the column names, 2 the rows,
3 a blank line. It is written by a range-partitioned sort, so the part files in name order are the report.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text

C = F.col
SNAPSHOT_VERSION = 4
# The basis of dated usage that is trusted, and what is kept of dated usage on another basis.
DATE_BASIS = "model-call-utc"
UNDATED_COLUMNS = ["date", "prompts", "output_tokens"]


@dataclass
class Section:
    """One table of a report: `columns` maps headings to expressions; rows are sorted by `rank` descending, then `name`
    (descending if so stated). An optional section without rows is left out with its heading."""

    title: str
    table: DataFrame
    columns: dict[str, Column]
    name: Column
    rank: Column = field(default_factory=lambda: F.lit(0.0))
    optional: bool = False
    descending: bool = False


@dataclass
class Listing:
    """Lines of text below a Markdown heading, in the order of a section."""

    title: str
    table: DataFrame
    line: Column
    name: Column
    rank: Column = field(default_factory=lambda: F.lit(0.0))
    optional: bool = True
    descending: bool = False
    heading: str = "## "


@dataclass
class Entry:
    """A member of a JSON document: an object with a member per row if `key` is given, a list of the rows if only `order`
    is, else the value of the one row. Members are sorted by key, rows by `order` (descending if so stated)."""

    name: str
    table: DataFrame
    value: Column
    key: Column | None = None
    order: Column | None = None
    descending: bool = False


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.round(value, 1))


def percent(value: Column) -> Column:
    """Percentage with one decimal, empty where unknown."""
    return F.when(value.isNotNull(), F.concat(one_decimal(value), F.lit("%"))).otherwise(F.lit(""))


def credits_text(nano: Column, digits: int = 9, unknown: str = "") -> Column:
    """Credits with a number of decimals, from whole nano-credits without rounding through floating point."""
    scale, unit = 10 ** (9 - digits), 10**digits
    units = F.floor((nano + scale // 2) / F.lit(scale).cast("decimal(12,0)")).cast("long") if scale > 1 else nano
    parts = F.format_string(f"%d.%0{digits}d", F.call_function("div", units, F.lit(unit)), (units % unit).cast("long"))
    return F.when(nano.isNotNull(), parts).otherwise(F.lit(unknown))


def _cells(section: Section, render) -> list[Column]:
    return [F.coalesce(render(value.cast("string")), F.lit("")) for value in section.columns.values()]


def _keys(section: Section | Listing | Entry, number: int, name: Column, rank: Column) -> list[Column]:
    """The place of a row in the report; `back` holds names that run backwards."""
    name, none = name.cast("string"), F.lit("")
    return [
        F.lit(number).alias("section"), F.lit(2).alias("part"), (-rank).cast("double").alias("rank"),
        (name if section.descending else none).alias("back"), (none if section.descending else name).alias("name"),
    ]


def _fixed(source: DataFrame, number: int, lines: list[tuple[int, str]]) -> DataFrame:
    """Fixed lines (part, text) for the one row of `source`, or none if it has none."""
    rows = [
        F.struct(
            F.lit(number).alias("section"), F.lit(part).alias("part"), F.lit(float(i)).alias("rank"),
            F.lit("").alias("back"), F.lit("").alias("name"), F.lit(line).alias("line"),
        )
        for i, (part, line) in enumerate(lines)
    ]
    return source.select(F.inline(F.array(*rows)))


def _lines(section: Section | Listing, number: int, heading: str, header: list[str], row: Column, gap: bool) -> DataFrame:
    some = section.table.limit(1) if section.optional else section.table.sparkSession.range(1)
    fixed = [(0, heading), *[(1, line) for line in header], *([(3, "")] if gap else [])]
    rows = section.table.select(*_keys(section, number, section.name, section.rank), row.alias("line"))
    return _fixed(some, number, fixed).unionByName(rows)


def csv_report(sections: list[Section], gaps: bool = False) -> DataFrame:
    """Lines of a CSV file with one block per section; texts are quoted and kept from being read as formulas. With `gaps`
    a blank line follows each block."""
    safe = lambda value: text.csv_field(text.spreadsheet_safe(value))
    parts = []
    for number, section in enumerate(sections):
        row = F.concat_ws(",", *_cells(section, safe))
        parts.append(_lines(section, number, f"# {section.title}", [",".join(section.columns)], row, gaps))
    return _union(parts)


def markdown_report(sections: list[Section | Listing], gaps: bool = False) -> DataFrame:
    """Lines of a Markdown document with one table or list per section. With `gaps` blank lines part heading, body and
    next section."""
    parts = []
    for number, section in enumerate(sections):
        blank = [""] if gaps else []
        if isinstance(section, Listing):
            parts.append(_lines(section, number, section.heading + section.title, blank, section.line, gaps))
            continue
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *_cells(section, text.markdown_safe)), F.lit(" |"))
        header = [*blank, "| " + " | ".join(section.columns) + " |", "|" + "---|" * len(section.columns)]
        parts.append(_lines(section, number, f"## {section.title}", header, row, gaps))
    return _union(parts)


def json_report(sections: list[Section]) -> DataFrame:
    """One JSON object per row, tagged with its section."""
    parts = []
    for number, section in enumerate(sections):
        record = F.to_json(F.struct(*[value.alias(name) for name, value in section.columns.items()]))
        parts.append(section.table.select(
            *_keys(section, number, section.name, section.rank),
            F.concat(F.lit(f'{{"section":"{section.title}","row":'), record, F.lit("}")).alias("line"),
        ))
    return _union(parts)


def json_text(value: Column) -> Column:
    """A value as JSON, unknown parts as null."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def json_document(entries: list[Entry]) -> DataFrame:
    """Lines of one JSON object with all entries, one line per member or row, so that no row holds the whole.

    A comma goes before each member but the first of its object, which is the least (or greatest) name of the table.
    """
    spark = entries[0].table.sparkSession
    parts = [_fixed(spark.range(1), -1, [(0, "{")]), _fixed(spark.range(1), len(entries), [(0, "}")])]
    for number, entry in enumerate(entries):
        opening = f'{"," if number else ""}"{entry.name}":'
        name = entry.key if entry.key is not None else entry.order
        if name is None:
            line = F.concat(F.lit(opening), json_text(entry.value))
            parts.append(entry.table.select(*_keys(entry, number, F.lit(""), F.lit(0.0)), line.alias("line")))
            continue
        name = name.cast("string")
        first = entry.table.agg((F.max if entry.descending else F.min)(name)).scalar()
        value = json_text(entry.value)
        body = value if entry.key is None else F.concat(json_text(name), F.lit(":"), value)
        line = F.concat(F.when(name == first, F.lit("")).otherwise(F.lit(",")), body)
        brackets = "[]" if entry.key is None else "{}"
        parts.append(_fixed(spark.range(1), number, [(0, opening + brackets[0]), (3, brackets[1])]))
        parts.append(entry.table.select(*_keys(entry, number, name, F.lit(0.0)), line.alias("line")))
    return _union(parts)


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "part", "rank", C("back").desc(), "name", "line").select("line").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a written report with their position in it.

    Rows are numbered inside a split of a part file; the lines before the split are a running sum over the (few) splits.
    """
    rows = spark.read.text(path).select(
        C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), C("value").alias("line"),
    )
    splits = rows.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "block", (F.coalesce(before, F.lit(0)) - C("first")).alias("offset"))
    return rows.join(offsets, ["file", "block"]).select((C("row") + C("offset")).alias("position"), "line")


def save_snapshot(tables: dict[str, DataFrame], path: str, date_basis: dict[str, str] | None = None) -> str:
    """Write aggregate tables as one snapshot; returns its id.

    Each snapshot has a folder of its own. Its manifest, one row per table, is written after all tables, so a snapshot
    that was broken off has none and is not read. `date_basis` names the basis of tables with dated usage.
    """
    spark = next(iter(tables.values())).sparkSession
    snapshot = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/tables/{snapshot}/{name}")
    names = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit((date_basis or {}).get(name)).cast("string").alias("date_basis"))
        for name in tables
    ])
    manifest = spark.range(1).select(
        F.lit(snapshot).alias("snapshot"), F.lit(SNAPSHOT_VERSION).alias("version"),
        F.current_timestamp().alias("saved_at"), F.inline(names),
    )
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return snapshot


def load_snapshot(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the newest whole snapshot of this version (all, or those named); nothing if there is none.

    Dated usage on another basis than the date of the model call is not comparable: of such a table only the columns
    UNDATED_COLUMNS are kept.
    """
    try:
        manifest = spark.read.parquet(f"{path}/manifest").where(C("version") == SNAPSHOT_VERSION)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    newest = manifest.agg(F.max_by("snapshot", F.struct("saved_at", "snapshot"))).scalar()
    loaded = {}
    # One row per table of a snapshot, a list that the caller stated when it was saved.
    for row in manifest.where(C("snapshot") == newest).select("snapshot", "name", "date_basis").collect():
        if names is not None and row.name not in names:
            continue
        table = spark.read.parquet(f"{path}/tables/{row.snapshot}/{row.name}")
        if row.date_basis is not None and row.date_basis != DATE_BASIS:
            table = table.select(*[c for c in UNDATED_COLUMNS if c in table.columns])
        loaded[row.name] = table
    return loaded
