"""Attribute text files: reading, parsing, categories, export."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import attribute_key, has_text, key_category, key_name, trimmed
from ..session import rows_of


# Part files as Spark's writers name them, for callers whose files are folders of parts.
SPARK_PARTS = r"part-\d{5}-[^/]*"


def source_path(path: Column, parts: str | None = None) -> Column:
    """The dropped file by its plain name.

    Files whose name matches ``parts`` belong to the folder they lie in; without
    ``parts`` every file is one of its own, whatever its name.  Scans say file:/x
    where listings say file:///x, and both escape characters of the name.
    """
    whole = F.regexp_replace(path, f"/(?:{parts})$", "") if parts else path
    plain = F.try_url_decode(F.replace(whole, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(plain, whole), r"^(\w+):///", "$1:/")


def text_lines(text: DataFrame, parts: str | None = None) -> DataFrame:
    """``file, part, block, time, line`` of a text source read line by line, batch or streaming."""
    return text.select(
        source_path(F.col("_metadata.file_path"), parts).alias("file"),
        F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_modification_time").alias("time"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )


def with_order(lines: DataFrame) -> DataFrame:
    """Add ``ord``: part file, split and row of the task, which sort like the
    lines of one long file.  Must see the lines as they were read, unshuffled."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ord_ = F.struct("part", "block", row.alias("row")).alias("ord")
    return lines.select("file", ord_, "time", "line")


def read_attribute_files(
    spark: SparkSession, paths: str | list[str], parts: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Lines ``file, ord, line`` and the files ``file, place``, empty ones included.

    Scans leave out names that begin with ``_`` or ``.``; ``ignored_files`` lists them.
    """
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(paths)
    return with_order(text_lines(text, parts)).drop("time"), list_files(spark, paths, parts)


def ignored_files(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Files with content that no scan reads because of their names.

    Markers and check sums that Spark's writers leave next to their parts do not count.
    """
    marker = re.compile(r"_SUCCESS$|_(committed|started)_\d+$|\..*\.crc$")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found, folders = [], [paths] if isinstance(paths, str) else list(paths)
    # one listing per folder, of the names that begin with "_" or "." only
    while folders:
        top = hadoop.Path(folders.pop())
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.globStatus(hadoop.Path(top, "[_.]*")) or []:
            if entry.isFile() and entry.getLen():
                found.append(entry.getPath().toUri().toString())
        folders += [e.getPath().toString() for e in fs.globStatus(hadoop.Path(top, "*")) or [] if e.isDirectory()]
    return sorted(p for p in found if not marker.match(p.rsplit("/", 1)[-1]))


def listed_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``raw``: the files that a scan of the paths looks at, those without content included.

    Spark lists in parallel and hands the names over at once.
    """
    text = spark.read.option("recursiveFileLookup", True).text(paths)
    jvm = spark.sparkContext._jvm
    names = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(text._jdf.inputFiles())
    names = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(names.toDF(), spark).toDF("raw")


def list_files(spark: SparkSession, paths: str | list[str], parts: str | None = None) -> DataFrame:
    """``file, place`` below the paths; ``place`` is the position of the path in the list.

    Scans skip files without content, so the names come from the listing.
    """
    each = [listed_files(spark, p).withColumn("place", F.lit(n)) for n, p in enumerate([paths] if isinstance(paths, str) else paths)]
    listed = each[0]
    for more in each[1:]:
        listed = listed.union(more)
    return listed.groupBy(source_path(F.col("raw"), parts).alias("file")).agg(F.min("place").alias("place"))


def modified_millis(spark: SparkSession, raw: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(raw))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()


def category_from_path(path: Column) -> Column:
    """Last path part without query, fragment and extension; a leading dot is no extension."""
    bare = F.regexp_extract(path, r"^[^?#]*", 0)
    name = F.substring_index(bare, "/", -1)
    name = F.when(name == "", bare).otherwise(name)
    return trimmed(F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", ""))


def category_of_file(path: Column) -> Column:
    """The same for the plain name of a file, where no character starts a query or a fragment."""
    escaped = path
    for plain, code in (("%", "%25"), ("+", "%2B"), ("?", "%3F"), ("#", "%23")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(code))
    return F.url_decode(category_from_path(escaped))


def category_from_file_name(name: Column) -> Column:
    """The form used for uploaded files: only the last extension goes."""
    last = F.substring_index(name, "/", -1)
    return F.regexp_replace(F.when(last == "", name).otherwise(last), r"\.[^/.]+$", "")


def not_blank(line: Column) -> Column:
    return trimmed(line) != ""


def _has_tab(line: Column) -> Column:
    return F.contains(line, F.lit("\t"))


def _parts(line: Column, tabbed: Column) -> Column:
    return F.when(tabbed, F.split(line, "\t")).otherwise(F.split(line, ","))


def _field(parts: str, number: int) -> Column:
    """A field of the column of split lines, so that a line is split once."""
    return trimmed(F.get(F.col(parts), F.lit(number)))


def _several_fields(line: Column, tabbed: Column) -> Column:
    """A line with a separator has at least two fields; no need to split it to know."""
    return F.when(tabbed, _has_tab(line)).otherwise(F.contains(line, F.lit(",")))


def with_fields(lines: DataFrame) -> DataFrame:
    """Add ``identifier, attr, value`` of each line, all null if it is no valid one.

    Each line picks its own separator: tab if it has one, else comma.  A missing
    value is "1", an empty one stays empty.
    """
    line = F.col("line")
    tabbed = _has_tab(line)
    valid = not_blank(line) & _several_fields(line, tabbed)
    value = F.when(F.col("_parts").isNotNull(), F.coalesce(_field("_parts", 2), F.lit("1")))
    fields = {"identifier": _field("_parts", 0), "attr": _field("_parts", 1), "value": value}
    return lines.withColumn("_parts", F.when(valid, _parts(line, tabbed))).withColumns(fields).drop("_parts")


def split_attribute_lines(lines: DataFrame) -> DataFrame:
    """``category, identifier, attr, value, ord`` per valid line.

    Each line picks its own separator: tab if it has one, else comma.  A
    missing value is "1", an empty one stays empty.
    """
    line = F.col("line")
    tabbed = _has_tab(line)
    valid = lines.filter(not_blank(line) & _several_fields(line, tabbed))
    return valid.select("category", _parts(line, tabbed).alias("_parts"), "ord").select(
        "category",
        _field("_parts", 0).alias("identifier"),
        _field("_parts", 1).alias("attr"),
        F.coalesce(_field("_parts", 2), F.lit("1")).alias("value"),
        "ord",
    )


def split_attribute_lines_strict(lines: DataFrame) -> DataFrame:
    """Variant with one separator per file, no empty names, and "1" for empty values.

    Separators, a row per category, go to the lines: most lines may be of one
    category, so they are not shuffled by it.
    """
    line, tabbed = F.col("line"), F.col("tabbed")
    full = lines.filter(not_blank(line))
    format_of = full.groupBy("category").agg(F.bool_or(_has_tab(line)).alias("tabbed"))
    value = _field("_parts", 2)
    rows = full.join(F.broadcast(format_of), "category").filter(_several_fields(line, tabbed))
    rows = rows.select("category", _parts(line, tabbed).alias("_parts"), "ord").select(
        "category",
        _field("_parts", 0).alias("identifier"),
        _field("_parts", 1).alias("attr"),
        F.when(has_text(value), value).otherwise("1").alias("value"),
        "ord",
    )
    return rows.filter("identifier <> '' AND attr <> ''")


def parse_attribute_lines(lines: DataFrame, mode: str = "live") -> DataFrame:
    """One entry per category, identifier and attribute: last value, first position."""
    rows = split_attribute_lines(lines) if mode == "live" else split_attribute_lines_strict(lines)
    # rows are sorted to be grouped, which is quick by identifiers and slow by the few categories
    entries = rows.groupBy("identifier", "attr", "category").agg(
        F.max_by("value", "ord").alias("value"), F.min("ord").alias("ord")
    )
    return entries.select("category", "identifier", "attr", "value", "ord")


def attribute_names(entries: DataFrame) -> DataFrame:
    """Attribute names of each category with the position where they came up first."""
    return entries.groupBy("category", "attr").agg(F.min("ord").alias("ord"))


def line_counts(lines: DataFrame, files: DataFrame, mode: str = "live") -> DataFrame:
    """``category, total, is_empty`` for every file, also for files without lines."""
    rows = split_attribute_lines(lines) if mode == "live" else split_attribute_lines_strict(lines)
    total = rows.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    filled = total.select("category") if mode != "live" else lines.filter(not_blank(F.col("line"))).select("category")
    filled = filled.distinct().withColumn("filled", F.lit(True))
    return (
        files.select("category")
        .distinct()
        .join(total, "category", "left")
        .join(filled, "category", "left")
        .select(
            "category",
            F.coalesce("total", F.lit(0)).alias("total"),
            F.isnull("filled").alias("is_empty"),
        )
    )


def category_registry(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Where each category came from.  ``files`` has ``category, url, batch``; of
    several files of a category the last one counts."""
    shape = lines.groupBy("category", "url").agg(
        F.bool_or(_has_tab(F.col("line"))).alias("tabbed"), F.bool_or(not_blank(F.col("line"))).alias("filled")
    )
    name = F.split_part(F.substring_index("url", "/", -1), F.lit("?"), F.lit(1))
    filled = F.coalesce("filled", F.lit(False))
    seen = files.join(shape, ["category", "url"], "left").select(
        "category",
        "batch",
        F.struct(
            F.when(name != "", name).otherwise(F.concat("category", F.lit(".txt"))).alias("filename"),
            "url",
            F.when(filled & F.col("tabbed"), "tab").otherwise("comma").alias("format"),
            (~filled).alias("is_empty"),
        ).alias("info"),
    )
    last = seen.groupBy("category").agg(F.max_by("info", "batch").alias("info"))
    return last.select("category", "info.*", F.lit(False).alias("modified"))


def empty_categories(registry: DataFrame) -> DataFrame:
    return registry.filter("is_empty").select("category")


def as_keyed(table: DataFrame) -> DataFrame:
    """Category and name as the combined key shows them: a "::" inside a name ends it."""
    key = attribute_key(F.col("category"), F.col("attr"))
    return table.withColumns({"category": key_category(key), "attr": key_name(key)})


def export_lines(
    person_attr: DataFrame, index: DataFrame, registry: DataFrame | None = None, separator: str | None = None
) -> DataFrame:
    """``category, line`` of the export: e-mail or id, and the attribute, without the value.

    The separator follows the category's source format unless one is given.
    """
    contact = index.select(F.col("id").alias("person_id"), "email")
    rows = as_keyed(person_attr).select("person_id", "category", "attr").join(contact, "person_id", "left")
    if separator is None:
        rows = rows.join(registry.select("category", "format"), "category")
        between = F.when(F.col("format") == "tab", "\t").otherwise(",")
    else:
        between = F.lit(separator)
    identifier = F.when(has_text(F.col("email")), F.col("email")).otherwise(F.col("person_id"))
    return rows.select("category", F.concat(identifier, between, "attr").alias("line"))


def export_category(
    person_attr: DataFrame, index: DataFrame, registry: DataFrame, category: str, path: str
) -> DataFrame:
    """Write a category's sorted lines and return the registry with its flag cleared.

    The lines come as ordered part files, so no task holds the whole export.
    """
    lines = export_lines(person_attr, index, registry).filter(F.col("category") == category)
    lines.select("line").orderBy("line").write.text(path)
    done = F.when(F.col("category") == category, F.lit(False)).otherwise(F.col("modified"))
    return registry.withColumn("modified", done)


def export_category_tsv(person_attr: DataFrame, index: DataFrame, category: str, base: str) -> str | None:
    """Tab-separated export to ``<base>/<safe name>.tsv``; nothing is written for an empty category."""
    rows = as_keyed(person_attr).filter(F.col("category") == category)
    if rows.isEmpty():
        return None
    path = f"{base}/{_safe_name(category)}.tsv"
    lines = export_lines(rows, index, separator="\t")
    lines.select("line").orderBy("line").write.text(path)
    return path


def _safe_name(category: str) -> str:
    allowed = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789äöüÄÖÜß_-")
    return "".join(c if c in allowed else "_" for c in category)


def safe_file_name(category: Column) -> Column:
    return F.concat(F.regexp_replace(category, "[^a-zA-Z0-9äöüÄÖÜß_-]", "_"), F.lit(".tsv"))
