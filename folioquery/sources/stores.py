"""Parent and child stores, vectors, golden sets, question lists, eval files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from folioquery.functions import fixed_values as fv
from folioquery.functions.text import strip
from folioquery.operators.joins import fits_broadcast
from folioquery.session import materialize
from folioquery.sources.json_array import read_array

CHILD_SCHEMA = ("id STRING, page_content STRING, "
                "metadata STRUCT<parent_link STRING, source STRING, content_type STRING>")
PARENT_SCHEMA = (
    "id STRING, text STRING, refs ARRAY<STRING>, metadata STRUCT<source STRING, chapter STRING, "
    "section STRING, content_type STRING, list_size INT, list_items ARRAY<STRING>, table_id STRING, "
    "table_title STRING, table_row INT, table_total INT, sibling_ids ARRAY<STRING>>")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are left out, text is not escaped. Files are gzipped, readers unpack them."""
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def _jsonl_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines with their place; a broken line keeps its text in ``_bad``."""
    parsed = F.from_json("value", f"{schema}, _bad STRING",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return _placed_lines(spark, path).where(strip(F.col("value")) != "").withColumn("r", parsed)


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                     F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", place.alias("place"))


def _numbered(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """``lines`` of the files with their number in the file, from 1.

    Lines are counted per split of a file first, so no file is numbered in one task;
    there is one count per split, which goes to every task.
    """
    split = [F.col("place.file_path").alias("_file"), F.col("place.file_block_start").alias("_start")]
    sizes = _placed_lines(spark, path).groupBy(*split).agg(F.count("*").alias("_n"), F.min("place.row").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("place.row") - F.col("_first") + F.col("_base") + 1
    return lines.select("*", *split).join(F.broadcast(starts), ["_file", "_start"]).select(*lines.columns, number.alias("number"))


def read_children(spark: SparkSession, path: str) -> DataFrame:
    """Child store: broken lines and empty contents are skipped, gaps get defaults."""
    good = _numbered(spark, path, _jsonl_lines(spark, path, CHILD_SCHEMA)).where(F.col("r._bad").isNull()).select("number", "r.*")
    cid = F.coalesce("id", F.concat(F.lit("unknown_"), F.col("number").cast("string")))
    return good.where(F.coalesce("page_content", F.lit("")) != "").select(
        cid.alias("id"), "page_content",
        F.struct(F.coalesce("metadata.parent_link", cid).alias("parent_link"),
                 F.coalesce("metadata.source", F.lit("Unknown")).alias("source"),
                 F.coalesce("metadata.content_type", F.lit("prose")).alias("content_type")).alias("metadata"))


def rejected_lines(spark: SparkSession, path: str, schema: str = CHILD_SCHEMA) -> DataFrame:
    return _jsonl_lines(spark, path, schema).where(F.col("r._bad").isNotNull()).select("value")


def read_parents(spark: SparkSession, path: str) -> DataFrame:
    """Parent store; of repeated ids the last line wins."""
    rows = _jsonl_lines(spark, path, PARENT_SCHEMA).where(F.col("r._bad").isNull())
    return last_per_id(rows.select("place", "r.id", "r.text", "r.refs", "r.metadata"), "place")


def last_per_id(rows: DataFrame, place: str) -> DataFrame:
    """Of each id the row with the greatest place. Only ids and places are shuffled, and rows of ids that repeat too often to ship."""
    repeated = materialize(rows.groupBy(F.col("id").alias("_id")).agg(F.max(place).alias("_last"), F.count("*").alias("_n"))
                           .where("_n > 1").drop("_n"), "repeated-ids")
    last = F.broadcast(repeated) if fits_broadcast(repeated) else repeated
    return rows.join(last, F.col("id").eqNullSafe(F.col("_id")), "left") \
               .where(F.col("_last").isNull() | (F.col(place) == F.col("_last"))).drop("_id", "_last", place)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("chunk_id", "vec").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def require_paths(spark: SparkSession, **paths: str) -> None:
    """Fail early, naming the missing store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in paths.items():
        where = hadoop.Path(path)
        if not where.getFileSystem(conf).exists(where):
            raise FileNotFoundError(f"{name} not found at: {path}")


# --- golden set and question list ------------------------------------------

GOLDEN_SCHEMA = ("question_category STRING, question STRING, expected_answer STRING, sources ARRAY<STRUCT<"
                 "document_title STRING, section_title STRING, raw_text STRING>>")


def read_golden_items(spark: SparkSession, path: str) -> DataFrame:
    """(index, item): each element of the JSON array as text, numbered from 1.

    A file that is not a JSON array is an error, found when this is called. Large files are read by many tasks.
    """
    return read_array(spark, path).select("index", "item")


def golden_rows(items: DataFrame) -> DataFrame:
    return items.select("index", F.from_json("item", GOLDEN_SCHEMA).alias("g")).select("index", "g.*")


def read_question_list(spark: SparkSession, path: str) -> DataFrame:
    """(category, emoji, intro, pos, entry) with ``entry`` a variant.

    Entries may be plain text or objects. A file without a list of categories,
    and a category without a list of questions, is an error.
    """
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    groups = F.coalesce(F.try_variant_get("v", "$.categories", "array<variant>"),
                        F.raise_error(F.lit("missing categories list in question file")).cast("array<variant>"))
    cats = doc.select(F.explode(groups).alias("cat"))
    text = lambda f: F.try_variant_get("cat", f"$.{f}", "string")
    listed = F.try_variant_get("cat", "$.questions", "array<variant>")
    missing = F.concat(F.lit("missing questions list in category "), F.coalesce(text("name"), F.lit("?")))
    checked = F.coalesce(listed, F.raise_error(missing).cast("array<variant>"))
    return cats.select(text("name").alias("category"), text("emoji").alias("emoji"),
                       text("intro").alias("intro"), F.posexplode(checked).alias("pos", "entry"))


def resolve_questions(entries: DataFrame, entry: str = "entry") -> DataFrame:
    """Variant entry -> (label, prompt, answer).

    Text stands for both label and prompt. An object with an answer is served
    as is; else its prompt, else its label, is asked.
    """
    e = F.col(entry)
    plain = F.schema_of_variant(e) == "STRING"
    field = lambda f: F.coalesce(F.try_variant_get(e, f"$.{f}", "string"), F.lit(""))
    text = F.try_variant_get(e, "$", "string")
    direct = ~plain & (field("answer") != "")
    asked = F.coalesce(F.nullif(field("prompt"), F.lit("")), field("label"))
    return entries.select(
        *[c for c in entries.columns if c != entry],
        F.when(plain, text).otherwise(field("label")).alias("label"),
        F.when(plain, text).when(direct, "").otherwise(asked).alias("prompt"),
        F.when(direct, field("answer")).otherwise("").alias("answer"))


def backend_query(message, prompt):
    """The hidden prompt when there is one, else what the user typed."""
    return F.when(strip(prompt) != "", strip(prompt)).otherwise(message)


# --- evaluation files -------------------------------------------------------

def write_eval(records: DataFrame, trace_path: str, metrics_path: str) -> None:
    """Full trace as JSON lines; metrics as CSV without the long text columns."""
    records.write.mode("overwrite").json(trace_path)
    records.drop(*fv.TRACE_ONLY_COLUMNS).write.mode("overwrite").csv(
        metrics_path, header=True, quote='"', escape='"')


def read_eval(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True)
