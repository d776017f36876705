"""Attribute files that arrive over time.

The store keeps state by file: an entry per file, identifier and attribute, with
null for the lines that are no entries, as mergeable figures (last value, first
position, oldest part).  The rows of a file add up to what is known of the file.
A micro-batch adds the pieces that it saw of each file, so it does not matter
how the parts of a file, or files, are dealt over batches.  Which file is newer
is told by its time, not by its batch.  A batch that runs again writes its own
folders and its own state of the manifest again, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..graph import Graph
from ..operators.attributes import ATTR_KEY, TYPE_FIELDS, register_loads
from ..operators.numbering import dense_index
from ..schema import PLACE
from ..session import rows_of
from ..sources.attributes import (
    category_from_file_name,
    listed_files,
    modified_millis,
    not_blank,
    source_path,
    text_lines,
    with_fields,
    with_order,
)
from ..sources.slots import Manifest, Slots, slots_of

# Which load is newer: ``batch`` is 0 for all drops, so what is set by hand later can be newer than any.
LOAD = "STRUCT<batch: BIGINT, time: TIMESTAMP, file: STRING>"
# Pieces of files: entries, and with a null identifier the lines that are none.
PIECES = (
    "category STRING, file STRING, identifier STRING, attr STRING, value STRING, "
    f"last {PLACE}, ord {PLACE}, time TIMESTAMP, tabbed BOOLEAN, filled BOOLEAN, persons ARRAY<STRING>"
)
# Rows are sorted to be grouped, which is quick by identifiers and slow by the few files.
PIECE_KEY = ["identifier", "file", "category", "attr"]


def merge_pieces(pieces: DataFrame) -> DataFrame:
    """One row per file, identifier and attribute, whatever pieces they come in."""
    return pieces.groupBy(*PIECE_KEY).agg(
        F.max_by("value", "last").alias("value"),
        F.max("last").alias("last"),
        F.min("ord").alias("ord"),
        F.min("time").alias("time"),
        F.bool_or("tabbed").alias("tabbed"),
        F.bool_or("filled").alias("filled"),
        F.max("persons").alias("persons"),
    )


def _pieces(graph: Graph, lines: DataFrame) -> DataFrame:
    """The pieces of files in a batch of lines, in one pass over them; identifiers with the persons they mean.

    A line is one row, as narrow as can be, since a task sorts what it reads.
    """
    line = F.col("line")
    rows = with_fields(lines).select(
        "identifier",
        "file",
        "attr",
        "value",
        "ord",
        "time",
        F.contains(line, F.lit("\t")).alias("tabbed"),
        not_blank(line).alias("filled"),
    )
    merged = rows.groupBy("identifier", "file", "attr").agg(
        F.max_by("value", "ord").alias("value"),
        F.max("ord").alias("last"),
        F.min("ord").alias("ord"),
        F.min("time").alias("time"),
        F.bool_or("tabbed").alias("tabbed"),
        F.bool_or("filled").alias("filled"),
    )
    merged = merged.withColumn("category", category_from_file_name(F.col("file")))
    merged = merged.select("category", "file", "identifier", "attr", "value", "last", "ord", "time", "tabbed", "filled")
    people = graph.index.filter("type = 'person'").select(F.col("id").alias("lowered"), F.col("id").alias("by_id"))
    mails = graph.email_index.select(F.col("email").alias("lowered"), F.col("person_id").alias("by_mail"))
    known = merged.withColumn("lowered", F.lower("identifier")).join(people, "lowered", "left").join(mails, "lowered", "left")
    persons = F.array_distinct(F.array_compact(F.array("by_id", "by_mail")))
    return known.select(*merged.columns, persons.alias("persons"))


class Drops:
    """The store of a folder of drops: its pieces by slot, and its files without content."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store, self.manifest = spark, store, Manifest(spark, store)

    def state(self, before: str | None = None) -> tuple[Slots, list[list]]:
        said = self.manifest.read(before)
        pieces = {int(s): [f"{self.store}/{f}" for f in folders] for s, folders in said.get("pieces", {}).items()}
        return Slots(self.spark, PIECES, pieces), said.get("empty", [])

    def save(self, number: str, pieces: Slots, empty: list[list]) -> None:
        inside = {s: [f.removeprefix(f"{self.store}/") for f in folders] for s, folders in pieces.pieces.items()}
        self.manifest.write(number, {"pieces": inside, "empty": empty})

    def add(self, graph: Graph, batch: DataFrame, number: int) -> None:
        name = f"{number:012d}"
        before, empty = self.state(name)
        after = before.append(_pieces(graph, with_order(batch)), f"{self.store}/pieces/{name}")
        self.save(name, after.compact(merge_pieces, f"{self.store}/pieces/{name}-whole"), empty)

    def add_empty(self, listed: DataFrame) -> None:
        """Remember the listed files (``raw, file``) of which no line was seen."""
        pieces, empty = self.state()
        seen = pieces.read().select("file").distinct()
        void = listed.join(seen, "file", "left_anti").groupBy("file").agg(F.max("raw").alias("raw"))
        known = {f for f, _ in empty}
        new = [[r.file, int(modified_millis(self.spark, r.raw))] for r in void.collect() if r.file not in known]
        if new:
            self.save(self.manifest.after(), pieces, empty + new)

    def rows(self, categories: list[str] | None) -> DataFrame:
        """The pieces as they were added; ``merge_pieces`` makes them whole."""
        pieces, _ = self.state()
        if categories is None:
            return pieces.read()
        return pieces.read(slots_of(self.spark, categories)).filter(F.col("category").isin(categories))


class Ingest:
    """A run over the files of a folder; files without content, of which no stream tells, are added when it ends."""

    def __init__(self, query: StreamingQuery, drops: Drops, listed: DataFrame):
        self.query, self._drops, self._listed = query, drops, listed

    def awaitTermination(self) -> None:
        self.query.awaitTermination()
        self._drops.add_empty(self._listed)


def ingest_attribute_drops(
    graph: Graph, folder: str, store: str, files_per_batch: int | None = None, parts: str | None = None
) -> Ingest:
    """Merge every attribute file found in ``folder`` into the store, each one once.

    Files whose names match ``parts`` are pieces of the folder they lie in.
    ``files_per_batch`` bounds the work of a micro-batch and changes no result.
    """
    spark = graph.spark
    # The run sees all files that are there now, so those without a line in the end have no content.
    listed = listed_files(spark, folder).select("raw", source_path(F.col("raw"), parts).alias("file"))
    reader = spark.readStream.format("text").option("lineSep", "\n").option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    drops = Drops(spark, store)
    query = (
        text_lines(reader.load(folder), parts)
        .writeStream.option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, number: drops.add(graph, batch, number))
        .start()
    )
    return Ingest(query, drops, listed)


def _files(rows: DataFrame) -> DataFrame:
    """``category, file, load, tabbed, filled`` of the files with content."""
    load = F.struct(F.lit(0).cast("bigint").alias("batch"), "time", "file").alias("load")
    files = rows.groupBy("category", "file").agg(
        F.min("time").alias("time"), F.bool_or("tabbed").alias("tabbed"), F.bool_or("filled").alias("filled")
    )
    return files.select("category", "file", load, "tabbed", "filled")


def _with_load(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Entries with the load they came in, a row per file."""
    return entries.join(F.broadcast(_files(rows).select("file", "load")), "file")


def read_attribute_store(spark: SparkSession, store: str, categories: list[str] | None = None) -> DataFrame:
    """All drops merged: one row per person, category and attribute, the newest file wins.

    If several identifiers of a file mean the same person, the one that came up
    last in it wins.  ``categories`` reads the slots of these only.
    """
    rows = Drops(spark, store).rows(categories)
    # dealt out and sorted once, for the entries and for the first position of an identifier
    dealt = rows.filter("identifier IS NOT NULL").repartition("identifier", "file", "category")
    first = F.min("ord").over(Window.partitionBy("identifier", "file", "category")).alias("first_ord")
    entries = merge_pieces(dealt).filter(F.size("persons") > 0).select("category", "file", "attr", "value", "ord", first, "persons")
    hits = _with_load(entries, rows).select("category", "attr", "value", "load", "ord", "first_ord", F.explode("persons").alias("person_id"))
    rank = F.min(F.struct(F.col("load").alias("batch"), "first_ord", "ord")).alias("rank")
    newest = F.max_by("value", F.struct("load", "first_ord")).alias("value")
    return hits.groupBy(*ATTR_KEY).agg(newest, rank).select(*ATTR_KEY, "value", "rank.*")


def read_attribute_types(spark: SparkSession, store: str) -> DataFrame:
    """``category, attr, ordinal, active`` as loading the files one by one numbers them."""
    rows = Drops(spark, store).rows(None)
    first = rows.filter("identifier IS NOT NULL").groupBy("attr", "category", "file").agg(F.min("ord").alias("ord"))
    names = _with_load(first, rows).select("category", "attr", "load", "ord")
    placed = dense_index(names, ["ord", "attr"], ("category", "load"), "place")
    return register_loads(rows_of(spark, [], TYPE_FIELDS), placed.select("category", "attr", "load", "place"))


def read_category_registry(spark: SparkSession, store: str) -> DataFrame:
    """The last file of each category; files without content or of blank lines make empty categories."""
    drops = Drops(spark, store)
    files = _files(drops.rows(None)).select("file", "load", "tabbed", "filled")
    _, empty = drops.state()
    void = rows_of(spark, [(f, t) for f, t in empty], "file STRING, millis BIGINT").join(files.select("file"), "file", "left_anti")
    load = F.struct(F.lit(0).cast("bigint").alias("batch"), F.timestamp_millis("millis").alias("time"), "file").alias("load")
    void = void.groupBy("file").agg(F.max("millis").alias("millis")).select("file", load, F.lit(False).alias("tabbed"), F.lit(False).alias("filled"))
    info = F.struct(
        F.substring_index("file", "/", -1).alias("filename"),
        F.lit(None).cast("string").alias("url"),
        F.when(F.col("filled") & F.col("tabbed"), "tab").otherwise("comma").alias("format"),
        (~F.col("filled")).alias("is_empty"),
    )
    category = category_from_file_name(F.col("file")).alias("category")
    last = files.unionByName(void).groupBy(category).agg(F.max_by(info, "load").alias("info"))
    return last.select("category", "info.*", F.lit(False).alias("modified"))
