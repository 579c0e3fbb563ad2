"""Key tables and the ledger of issued ids."""

from __future__ import annotations

import re
from itertools import count

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions.text import is_valid_id, utc_stamp

SCHEMA = (
    "session_id string, original_filename string, created_at string, id_format string, llm_endpoint string, llm_api_style string, model_used string, "
    "pii_types_scrubbed array<string>, entity_registry map<string, struct<types:array<string>,values:map<string,string>,linked_to:string>>, "
    "replacement_map map<string,string>, sheet_titles map<string,string>, identity_registry map<string, struct<kind:string,display:string,family:string>>, "
    "identity_cells array<struct<sheet:int,row:int,col:int,written:string,original:string>>, "
    "identity_columns array<struct<sheet:int,col:int,header_row:int,header:string>>, "
    "identity_source struct<host:string,import_runs:array<string>,category:string,committed_at:string>"
)
KEY_SUFFIX = ".key.json"
REQUIRED = ("session_id", "original_filename", "replacement_map")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """The valid keys below ``path`` with name, modified and key_no, their order by age.

    A file has a key a line, as ``write_keys`` leaves them, or one key over many lines.
    """
    about = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified")]
    read = lambda whole: spark.read.schema(SCHEMA).option("multiLine", whole).json(path).select("*", *about).filter(" and ".join(f"{c} is not null" for c in REQUIRED))
    lines = read("false")
    # of a file of lines this reading has the first one only
    whole = read("true").join(lines.select("_file").distinct(), "_file", "left_anti").select(lines.columns)
    return numbered(lines.unionByName(whole).drop("_file"))


def numbered(keys: DataFrame) -> DataFrame:
    """Keys with key_no by (created_at, session_id): their number is that of the chosen files.

    Only these two columns are sorted, by ranges; keys that are equal in both have a copy number, by a hash of the rest.
    """
    same = Window.partitionBy("created_at", "session_id").orderBy(F.xxhash64(F.to_json(F.struct(*keys.columns))))
    copies = keys.withColumn("_copy", F.row_number().over(same))
    order = copies.select("created_at", "session_id", "_copy").orderBy("created_at", "session_id", "_copy")
    schema = "_created string, _session string, _no int, key_no int"
    places = keys.sparkSession.createDataFrame(order.rdd.zipWithIndex().map(lambda r: (*r[0], r[1] + 1)), schema)
    there = F.col("created_at").eqNullSafe(F.col("_created")) & F.col("session_id").eqNullSafe(F.col("_session")) & (F.col("_copy") == F.col("_no"))
    return copies.join(places, there).select(*keys.columns, "key_no")


def recent_keys(keys: DataFrame, most: int = 1000) -> DataFrame:
    """The newest keys by modification time."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    hexes = F.exists(F.map_values("replacement_map"), lambda v: v.rlike(r"_[0-9A-F]{12}\]"))
    return keys.select("name", "session_id", "original_filename", "modified", size("replacement_map").alias("values"), F.when(hexes, "hex12").otherwise("legacy").alias("format")).orderBy(F.desc("modified"), "name").limit(most)


def build_keys(registry: DataFrame, sessions: DataFrame, identities: DataFrame | None = None, cells: DataFrame | None = None, columns: DataFrame | None = None, titles: DataFrame | None = None, commits: DataFrame | None = None) -> DataFrame:
    """One key per document from its registry; ``sessions`` has doc_id, session_id, original_filename, created_at.

    A roster's key also has its ``identities`` (community_id, kind, display, family),
    and, with them, the ``cells`` that were rewritten (sheet, row, col, written,
    original; see ``cells.written_cells``) and the ``columns`` that were appended
    (sheet, col, header_row, header), and where they come from: ``commits`` (url, import_runs,
    category, committed_at) gives the host, the runs, the category and the time in UTC.
    ``titles`` (written, original) are sheet titles.
    Each has a doc_id; documents without any have nulls there.
    """
    maps = registry.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("original", "placeholder"))).alias("replacement_map"),
        F.array_sort(F.collect_set("tag")).alias("pii_types_scrubbed"),
        F.map_from_entries(F.collect_list(F.struct("hex_id", F.struct("types", F.create_map("tag", "original").alias("values"), "linked_to")))).alias("entity_registry"),
    )
    keys = sessions.join(maps, "doc_id").withColumn("id_format", F.lit("hex12"))
    if titles is not None:
        named = titles.dropDuplicates(["doc_id", "written"]).groupBy("doc_id")
        keys = keys.join(named.agg(F.map_from_entries(F.collect_list(F.struct("written", "original"))).alias("sheet_titles")), "doc_id", "left")
    if identities is not None:
        people = identities.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("community_id", F.struct("kind", "display", "family")))).alias("identity_registry"))
        keys = keys.join(people, "doc_id", "left")
        parts = [(cells, "identity_cells", ["sheet", "row", "col", "written", "original"]), (columns, "identity_columns", ["sheet", "col", "header_row", "header"])]
        for rows, name, fields in parts:
            if rows is not None:
                listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
                keys = keys.join(listed, "doc_id", "left").withColumn(name, F.when(F.col("identity_registry").isNotNull(), F.col(name)))
        if commits is not None:
            host = F.lower(F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")))
            about = F.struct(host.alias("host"), F.coalesce("import_runs", F.array().cast("array<string>")).alias("import_runs"), F.coalesce("category", F.lit("other")).alias("category"), utc_stamp(F.col("committed_at")).alias("committed_at"))
            last = commits.groupBy("doc_id").agg(F.max_by(about, F.col("committed_at")).alias("identity_source"))
            keys = keys.join(last, "doc_id", "left").withColumn("identity_source", F.when(F.col("identity_registry").isNotNull(), F.col("identity_source")))
    return keys.drop("doc_id")


def import_key(spark: SparkSession, source: str, folder: str, name: str | None = None) -> str:
    """Copies a key file into a folder of keys under a name that nothing else has; returns the new path.

    The file must hold one valid key.  Its name, or ``name``, keeps its last part in safe
    characters and gets a number if it is taken.  The name is claimed by creating the
    file only where there is none, which the file system does in one step, so two imports
    at once keep both keys and none is ever overwritten.
    """
    rows = read_keys(spark, source).drop("name", "modified", "key_no").limit(2).toJSON().take(2)
    if len(rows) != 1:
        raise ValueError("not a file of one valid key")
    last = re.sub(r"[^A-Za-z0-9._-]", "_", (name or source).replace("\\", "/").rstrip("/").rpartition("/")[2])
    stem = last.removesuffix(KEY_SUFFIX) if last.endswith(KEY_SUFFIX) else last.rpartition(".")[0] or last or "imported"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(folder)
    store = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for k in count():
        path = jvm.org.apache.hadoop.fs.Path(parent, stem + (f"_{k}" if k else "") + KEY_SUFFIX)
        try:
            out = store.create(path, False)
        except Py4JJavaError as e:
            if not store.exists(path):
                raise e
            continue
        out.write(bytearray(rows[0].encode()))
        out.close()
        return path.toString()
    raise AssertionError


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """hex_id of each valid line."""
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("hex_id")).filter(is_valid_id(F.col("hex_id"))).distinct()
