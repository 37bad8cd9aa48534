"""Sources S1-S11: every reader takes an explicit schema (no inference on the hot path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convrec import schemas
from convrec.session import staged

MOVIE_TEXT_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in [
            "asin", "parent_asin", "title", "overview", "origin_country", "genres", "keywords", "casts",
            "belongs_to_collection", "Visual Caption",
        ]
    ]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", **opts) -> DataFrame:
    r = spark.read.schema(schema)
    for k, v in opts.items():
        r = r.option(k, v)
    return r.format(fmt).load(path)


def with_arrival(df: DataFrame, name: str = "arrival") -> DataFrame:
    """``df``, which reads files, with the place of every row in them: ``(file, byte at which the
    row's piece of the file begins, place in that piece)``, whose order is that of the files by
    name and of the rows inside.  Spark keeps no row order beyond the scan, so operators whose
    result depends on it (W4's parity order, W11) get it as a column that joins and shuffles
    carry along.  The scan numbers its rows upwards within a task and reads a task's pieces one
    after the other, so the numbers order the rows of a piece whatever else the task reads."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("piece"),
        F.monotonically_increasing_id().alias("row"),
    )
    return df.select("*", place.alias(name))


def read_ratings(spark, path, fmt: str = "parquet") -> DataFrame:
    """``user_id, parent_asin``."""
    return _read(spark, path, schemas.RATINGS, fmt)


def read_item_meta(spark, path) -> DataFrame:
    """Item metadata JSON lines."""
    return _read(spark, path, schemas.ITEM_META)


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``: the text of every object of a file that is one JSON array, read by as many tasks as
    the file has byte ranges (``multiLine`` reads a whole file in one task).

    The file is read as text cut at every ``}``, which any task can do from any byte on.  A brace or
    bracket counts if it is outside strings, and whether a fragment begins inside one is the parity
    of all quotes before it: a sum.  So is the depth of nesting.  Sums inside a byte range are
    taken for both cases (the range begins outside or inside a string), the sums of whole ranges,
    one row each, tell which case holds, and an object of the array ends where the depth comes
    back to one.  Fragments of one object are put together again; an object may cross ranges.
    ``\\}`` is no escape of JSON, so no escape is cut."""
    rows = with_arrival(spark.read.option("lineSep", "}").text(path)).select("value", "arrival.*")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    rows = staged(rows.select("*", (F.size(parts) - 1).alias("quotes"), *[_depth_change(parts, inside).alias(f"d{inside}") for inside in (0, 1)]), "json-fragments")

    # numbers only from here to the records' places
    piece = Window.partitionBy("file", "piece").orderBy("row")
    before = F.coalesce(F.sum("quotes").over(piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    n = rows.select("file", "piece", "row", "quotes", "d0", "d1").withColumn("within", before)
    ends_in = (F.col("within") + F.col("quotes")) % 2
    for case in (0, 1):  # the range begins outside or inside a string
        inside, closes = (F.col("within") == 1 - case), (ends_in == case)
        change = F.when(inside, F.col("d1")).otherwise(F.col("d0")) - F.when(closes, 1).otherwise(0)
        n = n.withColumn(f"closes{case}", closes).withColumn(f"depth{case}", F.sum(change).over(piece))
    n = staged(n, "json-depths")
    last = F.max_by(F.struct(ends_in.alias("flip"), "depth0", "depth1"), F.col("row"))
    ranges = n.groupBy("file", "piece").agg(last.alias("t")).select("file", "piece", "t.*")
    earlier = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("begins", F.coalesce(F.sum("flip").over(earlier), F.lit(0)) % 2)
    gained = F.when(F.col("begins") == 1, F.col("depth1")).otherwise(F.col("depth0"))
    ranges = ranges.withColumn("above", F.coalesce(F.sum(gained).over(earlier), F.lit(0))).select("file", "piece", "begins", "above")
    n = n.join(ranges, ["file", "piece"])
    case = lambda name: F.when(F.col("begins") == 1, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    n = n.select("file", "piece", "row", (case("closes") & (F.col("above") + case("depth") == 1)).cast("int").alias("end"))
    n = n.withColumn("in_piece", F.sum("end").over(piece) - F.col("end"))
    ended = n.groupBy("file", "piece").agg(F.sum("end").alias("ended"))
    ended = ended.withColumn("first", F.coalesce(F.sum("ended").over(earlier), F.lit(0))).select("file", "piece", "first")
    n = n.join(ended, ["file", "piece"]).select("file", "piece", "row", "end", (F.col("first") + F.col("in_piece")).alias("number"))

    texts = rows.select("file", "piece", "row", "value").join(n, ["file", "piece", "row"])
    inside = F.array_sort(F.collect_list(F.struct("piece", "row", "value")))["value"]
    whole = texts.groupBy("file", "number").agg(F.array_join(inside, "}").alias("t"), F.max("end").alias("end")).filter("end = 1")
    return whole.select(F.regexp_replace(F.concat("t", F.lit("}")), r"^[\s\[,\uFEFF]+", "").alias("record"))


def _depth_change(parts: Column, inside: int) -> Column:
    """Opening less closing braces and brackets in a fragment's ``parts`` between quotes that lie
    outside strings: every other one, from the first or, if it begins ``inside``, the second."""
    outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == inside), "")
    return F.length(F.regexp_replace(outside, r"[^\[{]", "")) - F.length(F.regexp_replace(outside, r"[^\]}]", ""))


def read_movie_json(spark, path) -> DataFrame:
    """S3: JSON array files of movie metadata, each read by many tasks.  Nested columns are read as
    text, so values that are real objects arrive as their JSON text (no spaces between tokens)
    and values that are Python-literal strings arrive as that text; ``build_catalogue`` parses both."""
    return json_array_records(spark, path).select(F.from_json("record", MOVIE_TEXT_SCHEMA).alias("r")).select("r.*")


def read_reviews(spark, path) -> DataFrame:
    """Review JSON lines (``timestamp`` as epoch milliseconds)."""
    return _read(spark, path, schemas.REVIEWS)


def read_responses(spark, path, schema: T.StructType = schemas.TEACHER) -> DataFrame:
    """Response JSON lines; a malformed line fails the read (FAILFAST)."""
    return _read(spark, path, schema, mode="FAILFAST")


def read_prompts(spark, path) -> DataFrame:
    """Prompt JSON lines ``user_id, scenario, text``."""
    return _read(spark, path, schemas.PROMPTS, mode="FAILFAST")


def read_splits(spark, path) -> DataFrame:
    """Split rows written by ``write_splits`` (``split`` comes back as a partition column)."""
    schema = T.StructType(schemas.SPLIT_ROWS.fields + [T.StructField("split", T.StringType())])
    return _read(spark, path, schema)


def read_kg_entities(spark, path) -> DataFrame:
    """KG entity CSV with header ``id,name``; ``ent`` = copy of ``name``."""
    return _read(spark, path, schemas.KG_ENTITIES, "csv", header="true").withColumn("ent", F.col("name"))


def read_kg_triples(spark, path) -> DataFrame:
    """KG triple CSV with header ``head_id,relation_id,tail_id``."""
    return _read(spark, path, schemas.KG_TRIPLES, "csv", header="true")


def read_relations(spark, path) -> DataFrame:
    """Relation dictionary CSV ``relation_id,relation_name``."""
    return _read(spark, path, schemas.RELATIONS, "csv", header="true")


def read_snapshot(spark, path) -> DataFrame:
    """User-group / catalogue snapshots written by ``write_snapshot``."""
    return spark.read.parquet(path)
