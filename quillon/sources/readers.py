"""Typed readers. Every reader declares its schema; malformed input fails or is reported, never guessed."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Columns of the verse, passage and translation files.
VERSE_SCHEMA = (
    "source_id string, source_type string, language string, translation_name string, surah_no int, ayah_no int, surah_name_ar string, text_display string, text_normalized_light string, "
    "text_normalized_aggressive string, bismillah string, canonical_source_id string, citation_string string"
)
PASSAGE_SCHEMA = (
    "source_id string, source_type string, language string, translation_name string, window_size int, surah_no int, start_ayah int, end_ayah int, surah_name_ar string, text_display string, "
    "text_normalized_light string, text_normalized_aggressive string, canonical_source_id string, citation_string string, component_citations_json string, component_source_ids_json string"
)
TRANSLATION_SCHEMA = "surah_no int, ayah_no int, ayah_key string, translation_name string, language string, source_id string, text_display string, text_raw_html string"
NEIGHBOUR_SCHEMA = (
    "matching_corpus string, source_canonical_id string, window_size int, neighbors array<struct<canonical_source_id:string,surah_no:int,start_ayah:int,end_ayah:int,window_size:int,"
    "precomputed_rank:int,token_overlap_count:int,token_coverage_vs_source:double,missing_source_tokens:int>>"
)
UNIT_SCHEMA = (
    "guidance_unit_id string, parent_hadith_ref string, collection_source_id string, span_text string, summary_text string, guidance_role string, topic_family string, central_concept_ids array<string>, "
    "secondary_concept_ids array<string>, directness_score double, answerability_score double, narrative_penalty double, span_start int, span_end int, numbering_quality string, metadata string"
)


def read_csv(spark: SparkSession, path: str, schema: str, key: list[str] | None = None) -> DataFrame:
    """CSV with a header in the order of the schema; a byte-order mark is dropped, a malformed row fails the read. With ``key`` the last row of a key wins."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST", multiLine=True, escape='"', enforceSchema=True)
    if not key:
        return df
    order = Window.partitionBy(*key).orderBy(F.monotonically_increasing_id().desc())
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def read_optional_csv(spark: SparkSession, path: str, schema: str, text_columns: list[str]) -> DataFrame:
    """S3: like :func:`read_csv`, an empty table if the file is missing on its file system; ``text`` is the first non-blank of the text columns. Any other fault of the read is raised."""
    try:
        df = read_csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        df = spark.createDataFrame([], schema)
    return df.withColumn("text", F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in text_columns]))


def json_lists(df: DataFrame, *columns: str) -> DataFrame:
    """JSON list texts as arrays."""
    return df.withColumns({c: F.from_json(c, "array<string>") for c in columns})


def read_jsonl(spark: SparkSession, path: str, schema: str, required: list[str] = (), tolerate: bool = False) -> DataFrame:
    """JSON lines; rows that lack a required field are skipped, blank lines too. An unreadable line fails the read; only with ``tolerate`` it is left to :func:`unreadable_lines`."""
    df = spark.read.json(path, schema=schema, mode="DROPMALFORMED" if tolerate else "FAILFAST")
    for c in required:
        df = df.where(F.col(c).isNotNull())
    return df


def unreadable_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that :func:`read_jsonl` with ``tolerate`` leaves out, as ``line``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _unreadable string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unreadable"})
    return lines.where(parsed["_unreadable"].isNotNull()).select(F.col("value").alias("line"))


def read_verse_xml(spark: SparkSession, path: str) -> DataFrame:
    """Chapters and verses from the attributes of ``sura/aya`` elements."""
    schema = T.StructType(
        [
            T.StructField("_index", T.IntegerType()), T.StructField("_name", T.StringType()),
            T.StructField("aya", T.ArrayType(T.StructType([T.StructField("_index", T.IntegerType()), T.StructField("_text", T.StringType()), T.StructField("_bismillah", T.StringType())]))),
        ]
    )
    rows = spark.read.format("xml").options(rowTag="sura").schema(schema).load(path).select(F.col("_index").alias("surah_no"), F.col("_name").alias("surah_name_ar"), F.explode("aya").alias("a"))
    return rows.select("surah_no", F.col("a._index").alias("ayah_no"), "surah_name_ar", F.col("a._text").alias("text_display"), F.col("a._bismillah").alias("bismillah"))


CHAPTER_FILE = "resource_id int, chapter_number int, count int, tafsirs array<struct<id:int,resource_id:int,verse_key:string,language_id:int,slug:string,text:string>>"


def read_chapter_files(spark: SparkSession, folder: str, pattern: str = "chapter_*.json") -> DataFrame:
    """Commentary rows of chapter files with the issues of each file.

    ``issues`` names what is wrong with the file: file name and content disagree, the count is wrong, verses are missing, repeated or of another chapter, fields are missing.
    """
    files = spark.read.schema(CHAPTER_FILE).json(folder, pathGlobFilter=pattern, multiLine=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    verses = F.transform("tafsirs", lambda x: F.split_part(x["verse_key"], F.lit(":"), F.lit(2)).try_cast("int"))
    n = F.size("tafsirs")
    checks = {
        "file_name": F.regexp_extract("file", r"(\d+)\.json", 1).try_cast("int") == F.col("chapter_number"),
        "count": F.col("count") == n,
        "resource": ~F.exists("tafsirs", lambda x: ~x["resource_id"].eqNullSafe(F.col("resource_id"))),
        "chapter": ~F.exists("tafsirs", lambda x: ~F.split_part(x["verse_key"], F.lit(":"), F.lit(1)).try_cast("int").eqNullSafe(F.col("chapter_number"))),
        "fields": ~F.exists("tafsirs", lambda x: x["id"].isNull() | x["verse_key"].isNull() | x["text"].isNull()),
        "duplicates": F.size(F.array_distinct(verses)) == n,
        "contiguous": F.array_sort(verses) == F.sequence(F.lit(1), F.greatest(F.lit(1), n)),
        "not_empty": n > 0,
    }
    issues = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    rows = files.withColumn("issues", issues).select("file", F.col("resource_id").alias("file_resource_id"), "chapter_number", "issues", F.explode_outer("tafsirs").alias("t"))
    return rows.select("file", "chapter_number", "issues", "t.*", F.split_part("t.verse_key", F.lit(":"), F.lit(2)).try_cast("int").alias("ayah_no"))


def read_keyed_json(spark: SparkSession, path: str) -> DataFrame:
    """An object keyed by ``S:A`` as rows ``(surah_no, ayah_no, text)``; empty texts are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<t:string>>")).alias("key", "v"))
    return rows.select(F.split_part("key", F.lit(":"), F.lit(1)).cast("int").alias("surah_no"), F.split_part("key", F.lit(":"), F.lit(2)).cast("int").alias("ayah_no"), F.col("v.t").alias("text")).where(F.trim("text") != "")


BOOK_FILE = (
    "id int, metadata struct<english:struct<title:string>,arabic:struct<title:string>>, chapters array<struct<id:int,bookId:int,arabic:string,english:string>>, "
    "hadiths array<struct<id:int,idInBook:int,bookId:int,chapterId:int,arabic:string,english:struct<narrator:string,text:string>>>"
)


def read_book_file(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A nested book file as ``books``, ``chapters`` (numbered by position) and ``entries`` with their chapter and whether it is known."""
    raw = spark.read.schema(BOOK_FILE).json(path, multiLine=True)
    books = raw.select(F.col("id").alias("book_id"), F.col("metadata.english.title").alias("title_en"), F.col("metadata.arabic.title").alias("title_ar"))
    chapters = raw.select(F.posexplode("chapters").alias("p", "c")).select(F.col("c.bookId").alias("book_id"), F.col("c.id").alias("upstream_chapter_id"), (F.col("p") + 1).alias("chapter_number"), F.col("c.english").alias("title_en"), F.col("c.arabic").alias("title_ar"))
    entries = raw.select(F.explode("hadiths").alias("h")).select(
        F.col("h.id").alias("upstream_entry_id"), F.col("h.idInBook").alias("number"), F.col("h.bookId").alias("book_id"), F.col("h.chapterId").alias("upstream_chapter_id"),
        F.col("h.english.narrator").alias("english_narrator"), F.col("h.english.text").alias("english_text"), F.col("h.arabic").alias("arabic_text"),
    )
    known = chapters.select("book_id", "upstream_chapter_id", "chapter_number")
    return {"books": books, "chapters": chapters, "entries": entries.join(known, ["book_id", "upstream_chapter_id"], "left").withColumn("has_chapter", F.col("chapter_number").isNotNull())}


FLAT_FILE = "Book string, Reference string, `In-book reference` string, Chapter_Title_English string, Chapter_Title_Arabic string, English_Text string, Arabic_Text string, Grade string"


def read_flat_entries(spark: SparkSession, path: str) -> DataFrame:
    """A flat list of entries parsed into numbers, narrator, body and grade; ``issue`` names what cannot be parsed."""
    from quillon.functions import text as tx

    raw = spark.read.schema(FLAT_FILE).json(path, multiLine=True)
    split, place = tx.narrator_and_body(F.col("English_Text")), tx.book_and_number(F.col("In-book reference"))
    number = tx.collection_number(F.col("Reference"))
    issue = F.when(number.isNull(), "no_number").when(place.isNull(), "no_place").when(F.coalesce(F.trim("English_Text"), F.lit("")) == "", "no_text")
    return raw.select(
        number.alias("number"), place["book"].alias("book_number"), place["number"].alias("number_in_book"), split["narrator"].alias("english_narrator"), split["body"].alias("matn_text"),
        F.col("Arabic_Text").alias("arabic_text"), tx.grade_label(F.col("Grade")).alias("grade_label"), F.col("Chapter_Title_English").alias("chapter_title_en"), issue.alias("issue"),
    )


def read_delimited(spark: SparkSession, path: str, pattern: str = r"^\s*(\d+)\|(\d+)\|(.*)$") -> DataFrame:
    """Lines by a pattern of chapter, verse and text; blank lines and comments (``#``) are skipped, any other line fails the read."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    part = lambda i: F.regexp_extract("value", pattern, i)
    bad = F.raise_error(F.concat(F.lit("malformed line: "), F.col("value"))).cast("int")
    return lines.select(F.when(F.col("value").rlike(pattern), part(1).cast("int")).otherwise(bad).alias("surah_no"), part(2).cast("int").alias("ayah_no"), F.trim(part(3)).alias("text"))


def read_catalog(spark: SparkSession, path: str, item: str, schema: str) -> DataFrame:
    """The array ``item`` of a versioned JSON catalog as rows."""
    raw = spark.read.schema(f"version string, {item} array<struct<{schema}>>").json(path, multiLine=True)
    return raw.select("version", F.explode(item).alias("x")).select("version", "x.*")


def read_keyed_catalog(spark: SparkSession, path: str, item: str, value: str) -> DataFrame:
    """An object of objects as rows with their key as ``slug``."""
    raw = spark.read.schema(f"{item} map<string,struct<{value}>>").json(path, multiLine=True)
    return raw.select(F.explode(item).alias("slug", "x")).select("slug", "x.*")


def todo(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def _exists(path: str) -> bool:
    """Whether a path or URI is there, asked of its own file system."""
    where, at = filesystem(path)
    return where.get_file_info(at).type != fs.FileType.NotFound


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path there; ``s3a`` is read as ``s3``."""
    if "://" in path:
        return fs.FileSystem.from_uri(quote(path.replace("s3a://", "s3://", 1), safe=":/@%"))
    return fs.LocalFileSystem(), path.removeprefix("file:")


def read_bundle(root: str, version: str, names: list[str], require: bool = False, legacy: str | None = None) -> dict[str, str]:
    """Paths of the assets of a bundle version; the legacy folder where an asset or the bundle is missing, unless the bundle is required."""
    out = {}
    for n in names:
        path = os.path.join(root, version, n)
        if not _exists(path):
            if require or legacy is None:
                raise FileNotFoundError(path)
            path = os.path.join(legacy, n)
        out[n] = path
    return out


def _file_facts(uri: str, chunk: int = 1 << 22) -> tuple[int, str, int | None]:
    """Size, digest and number of rows of one file, read in pieces."""
    at = urlsplit(uri)
    where, path = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(quote(uri, safe=":/@%"))
    digest, size, lines, last = hashlib.sha256(), 0, 0, b""
    kind = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    text = kind in ("jsonl", "ndjson", "csv", "tsv", "txt")
    with where.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(chunk):
            digest.update(piece)
            size += len(piece)
            if text:
                lines += piece.count(b"\n") + piece.count(b"\r") - piece.count(b"\r\n") - (last == b"\r" and piece[:1] == b"\n")
                last = piece[-1:]
    count = None
    if text:
        lines += last not in (b"", b"\n", b"\r")
        count = lines if kind in ("jsonl", "ndjson") else max(0, lines - 1)
    elif kind == "parquet":
        try:
            with where.open_input_file(path) as f:
                count = pq.ParquetFile(f).metadata.num_rows
        except pa.ArrowInvalid:  # a damaged file has a digest, so that a manifest shows it as changed
            pass
    return size, digest.hexdigest(), count


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path within the folder, size, SHA-256 and number of rows of every file, subfolders included, computed where the file is read.

    Files are read in pieces, so their size is not bounded by a row's. Rows are those of the footer (Parquet), lines (JSON lines) or lines after a header (CSV, TSV, text), else and for a damaged footer NULL. Empty files
    count (a scan would leave them out, so the listing is used); hidden files (``_`` or ``.`` first) are no assets.
    """
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup="true").load(folder).inputFiles()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = urlsplit(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()).path.rstrip("/") + "/"
    names = [(uri, unquote(p[len(root) :] if p.startswith(root) else p.rsplit("/", 1)[-1])) for uri, p in ((f, urlsplit(f).path) for f in files)]

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                size, sha, count = _file_facts(uri)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([sha]), pa.array([count], pa.int64())], ["file", "n_bytes", "sha256", "row_count"])

    listed = spark.createDataFrame(names, "uri string, file string").repartition(max(1, min(len(names), 8 * spark.sparkContext.defaultParallelism)))
    return listed.mapInArrow(facts, "file string, n_bytes long, sha256 string, row_count long")


def check_manifest(spark: SparkSession, folder: str, manifest: str) -> DataFrame:
    """Per asset of the manifest (``{"assets": [{"file", "sha256", "n_bytes", "row_count"}]}``) its state: ok, missing or changed; a ``row_count`` that is not given is not compared."""
    with open(manifest, encoding="utf-8") as f:
        wanted = spark.createDataFrame([(a["file"], a["sha256"], a["n_bytes"], a.get("row_count")) for a in json.load(f)["assets"]], "file string, want_sha string, want_bytes long, want_rows long")
    have = file_digests(spark, folder)
    other_rows = F.col("want_rows").isNotNull() & ~F.col("want_rows").eqNullSafe(F.col("row_count"))
    state = F.when(F.col("sha256").isNull(), "missing").when((F.col("sha256") != F.col("want_sha")) | other_rows, "changed").otherwise("ok")
    return wanted.join(have, "file", "left").select("file", state.alias("state"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ranges of a number column."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts), **options).load()


def safe_table(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or an empty one if there is none of that name."""
    return spark.table(name) if spark.catalog.tableExists(name) else spark.createDataFrame([], schema)


class PagedSource(DataSource):
    """A paged service as a data source; one partition per chapter, pages until there is no next one.

    The class attribute ``fetch(chapter, page, per_page)`` returns ``(rows, next_page)`` and is set by a subclass, so that tests and other transports plug in.
    """

    fetch: Callable[[int, int, int], tuple[list[tuple], int | None]]
    columns = "chapter int, key string, text string"

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(type(self).fetch, [int(c) for c in self.options["chapters"].split(",")], int(self.options.get("per_page", "50")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch: Callable, chapters: list[int], per_page: int) -> None:
        self.fetch, self.chapters, self.per_page = fetch, chapters, per_page

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in self.chapters]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page: int | None = 1
        while page:
            rows, page = self.fetch(partition.value, page, self.per_page)
            yield from rows
