"""Raw folders, pages and label files as tables, and the artefacts of a corpus build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions import corpus as C
from lodestrand.functions.text import short_id
from lodestrand.operators import chunking
from lodestrand.session import staged
from lodestrand.sources.html import pages_to_text

CHUNK_SCHEMA = "dataset_version string, chunk_id string, source_type string, source_path string, title string, text string, metadata map<string,string>"
_LABEL = "case_id string, query string, category string, split string, expected_sources array<string>, relevant_chunk_ids array<string>, answerable boolean, expected_points array<string>"
#: Fields of the four kinds of label files.
LABELS = {
    "retrieval": f"{_LABEL}, expected_intent string, notes string, human_reviewed boolean",
    "knowledge": f"{_LABEL}, expected_entities array<string>, expected_relations array<string>, graph_edge_ids array<string>, review_method string, human_reviewed boolean",
    "graph": f"{_LABEL}, expected_strategy string, expected_entities array<string>, expected_relations array<string>, label_reviewed boolean, review_method string",
    "context": "case_id string, category string, split string, user_id string, session_id string, messages array<map<string,string>>, expected_point string, answerable boolean, profile_facts array<map<string,string>>, summary string, memories array<map<string,string>>, evidence array<map<string,string>>, review_method string, human_reviewed boolean",
}


def documents(files: DataFrame, root: str) -> DataFrame:
    """``(source_path, source_type, title, text, metadata)`` of ``files(source_path, text)`` below ``root``: the path is
    relative, the type its first folder, the title the file's name without suffix, the metadata the front matter. Files
    outside a source type's folder raise."""
    relative = F.regexp_replace(F.regexp_replace("source_path", "^file:/+", "/"), f"^{root.rstrip('/')}/", "")
    rows = files.withColumn("path", relative)
    kind = C.source_type(F.col("path"))
    checked = F.when(kind.isNull(), F.raise_error(F.concat(F.lit("no source type: "), "path"))).otherwise(kind)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    meta = F.map_from_entries(F.array_distinct(C.front_matter(F.col("text"))))
    return rows.select(F.col("path").alias("source_path"), checked.cast("string").alias("source_type"), name.alias("title"), F.trim(C.body(F.col("text")), F.lit(" \n\r\t")).alias("text"), meta.alias("metadata"))


def document_chunks(docs: DataFrame, limit: int = 800, strategy: str = "paragraphs") -> DataFrame:
    """``(chunk_id, source_type, source_path, title, text, metadata)``: the chunks of each document by "paragraphs",
    "windows" or "sentences". The id is made of type, name, place and a hash of the text; the metadata are the
    document's with place, file name and length. Empty texts have no chunk."""
    rows = docs.where(F.length("text") > 0)
    if strategy == "paragraphs":
        cut = chunking.packed_paragraphs(rows, "source_path", "text", limit).withColumnsRenamed({"place": "chunk_index", "part": "chunk"})
    elif strategy == "windows":
        cut = rows.select("source_path", F.posexplode(chunking.fixed_windows(F.col("text"), limit)).alias("chunk_index", "chunk"))
    elif strategy == "sentences":
        cut = chunking.sentence_chunks(rows, "source_path", "text", limit)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    own = cut.join(docs.drop("text"), "source_path")
    place = F.col("chunk_index").cast("string")
    more = F.create_map(F.lit("chunk_index"), place, F.lit("source_file_name"), F.element_at(F.split("source_path", "/"), -1), F.lit("char_count"), F.length("chunk").cast("string"))
    key = F.concat_ws("-", "source_type", "title", place, short_id(F.col("chunk")))
    kept = F.map_filter("metadata", lambda k, _: ~k.isin("chunk_index", "source_file_name", "char_count"))
    return own.select(key.alias("chunk_id"), "source_type", "source_path", "title", F.col("chunk").alias("text"), F.map_concat(kept, more).alias("metadata"))


def private_records(docs: DataFrame, collected_at: str) -> DataFrame:
    """Local documents as records of their owner: keys and addresses from the path, private throughout."""
    fixed = {"source_domain": "local-private", "source_method": "user_owned", "owner_scope": "private", "public_status": "private", "license_status": "user-owned-private", "review_status": "user_owned"}
    return docs.select("source_type", "title", "text", F.concat(F.lit("local:"), "source_path").alias("source_key"), F.concat(F.lit("private://"), "source_path").alias("source_url"), F.lit(collected_at).cast("timestamp").alias("collected_at"), F.lit(True).alias("anonymized"), *(F.lit(v).alias(k) for k, v in fixed.items()))


def public_documents(pages: DataFrame) -> DataFrame:
    """``(source_id, source_type, title, source_url, text)`` of fetched ``pages(source_id, source_type, title, url,
    content_type, content, start_marker, end_marker, max_chars)``: HTML becomes its visible text, then the part from the
    first start marker to the next end marker is kept, at most ``max_chars`` of it. Markers may be null; a start marker
    that a page lacks raises."""
    shown = pages_to_text(pages.where("content_type = 'html'"), "source_id", "content").withColumnRenamed("text", "shown")
    rows = pages.join(shown, "source_id", "left").withColumn("t", F.coalesce("shown", F.trim("content", F.lit(" \n\r\t"))))
    begin = F.when(F.col("start_marker").isNull(), 1).otherwise(F.instr(F.col("t"), F.col("start_marker")))
    rows = rows.withColumn("b", F.when(begin < 1, F.raise_error(F.concat(F.lit("no start marker: "), "source_id"))).otherwise(begin).cast("int"))
    rows = rows.withColumn("rest", F.expr("substring(t, b)"))
    end = F.instr(F.col("rest"), F.coalesce("end_marker", F.lit("")))
    kept = F.when(F.col("end_marker").isNotNull() & (end > 0), F.expr("substring(rest, 1, instr(rest, end_marker) - 1)")).otherwise(F.col("rest"))
    cut = F.when(F.col("max_chars").isNull(), kept).otherwise(F.substring(kept, F.lit(1), F.col("max_chars")))
    return rows.select("source_id", "source_type", "title", F.col("url").alias("source_url"), F.trim(cut, F.lit(" \n\r\t")).alias("text"))


def write_chunks(chunks: DataFrame, folder: str, version: str) -> None:
    """Chunks as JSON lines that carry the version of their data set."""
    chunks.withColumn("dataset_version", F.lit(version)).select("dataset_version", "chunk_id", "source_type", "source_path", "title", "text", "metadata").write.mode("errorifexists").json(folder)


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks from JSON lines; malformed lines raise, blank ones are passed over."""
    return spark.read.schema(CHUNK_SCHEMA).json(folder, mode="FAILFAST")


def write_artefacts(docs: DataFrame, chunks: DataFrame, rejected: DataFrame, stats: DataFrame, folder: str, version: str) -> None:
    """The five artefacts of a build: documents, their manifest (without texts and metadata), chunks, rejections, and
    statistics. Documents are computed once."""
    kept = staged(docs, "documents")
    kept.write.mode("errorifexists").json(f"{folder}/documents")
    kept.drop("text", "metadata").write.mode("errorifexists").json(f"{folder}/manifest")
    write_chunks(chunks, f"{folder}/chunks", version)
    rejected.write.mode("errorifexists").json(f"{folder}/rejected")
    stats.write.mode("errorifexists").json(f"{folder}/stats")


def labels(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Labels of one of the ``LABELS`` kinds from JSON lines; malformed lines raise, and so do predictions among them."""
    if kind not in LABELS:
        raise ValueError(f"no such kind of labels: {kind}")
    if predicted := [c for c in spark.read.json(path).columns if c.startswith("predicted")]:
        raise ValueError(f"labels hold predictions: {', '.join(predicted)}")
    return spark.read.schema(LABELS[kind]).json(path, mode="FAILFAST")


def entity_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``(name, node_type, aliases)`` from a JSON list; entries without a name or type raise."""
    rows = spark.read.schema("name string, node_type string, aliases array<string>").json(path, multiLine=True, mode="FAILFAST")
    bad = rows.where("coalesce(trim(name), '') = '' or coalesce(trim(node_type), '') = ''")
    if not bad.isEmpty():
        raise ValueError("an entity lacks its name or type")
    return rows.select("name", "node_type", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def frozen_inputs(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(name, expected, found, same)``: the files of a folder against ``manifest(name, expected)``, hashes of whole files;
    files that are missing or not listed are not the same."""
    files = spark.read.format("binaryFile").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    rows = manifest.select("name", "expected").join(found, "name", "full_outer")
    return rows.select("name", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("same"))
