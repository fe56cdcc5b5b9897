"""Sources: JSON lines and documents with given schemas, files by content, chunk scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVIDENCE = "struct<source_doc_code:string,evidence_quote:string,fact_key:string,relevance_grade:int,mapped_doc_id:bigint,mapped_chunk_id:bigint,mapping_status:string,mapping_reason:string>"
CASES = f"case_code string, question string, normalized_question string, reference_answer string, case_type string, target_doc_types array<string>, expected_action string, difficulty string, dataset_split string, business_domain string, required_fact_count int, generation_metadata map<string,string>, evidences array<{EVIDENCE}>, review_status string, review_score double, review_reason string, status string"
SECTIONS = "array<struct<section_code:string,heading:string,content:string,aliases:array<string>,facts:array<struct<fact_key:string,fact_text:string>>>>"
CORPUS = f"source_doc_code string, title string, doc_type string, topic string, version string, effective_from date, effective_to date, sections {SECTIONS}"


def read_cases(spark: SparkSession, path: str, schema: str = CASES) -> DataFrame:
    """Cases of JSON lines; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(sections, facts) of source documents, one JSON document a file."""
    docs = spark.read.schema(CORPUS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    sections = docs.select("source_doc_code", "title", "doc_type", "topic", "version", F.posexplode("sections").alias("section_ord", "s")).select("source_doc_code", "title", "doc_type", "topic", "version", "section_ord", "s.*")
    facts = sections.select("source_doc_code", "section_code", F.posexplode("facts").alias("fact_ord", "f")).select("source_doc_code", "section_code", "fact_ord", "f.*")
    return sections.drop("facts"), facts


def scan_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256, ext) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256"), F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).alias("ext"))


def scan_chunks(chunks: DataFrame, doc_id=None, limit: int | None = None) -> DataFrame:
    out = chunks.where("status = 'ACTIVE'")
    out = out.where(F.col("doc_id") == doc_id) if doc_id is not None else out
    return out.orderBy("chunk_id").limit(limit) if limit else out


def lookup_chunks(ids: DataFrame, chunks: DataFrame, active_only: bool = True) -> DataFrame:
    """The chunks of the ids (chunk_id), only active ones or all."""
    return chunks.where("status = 'ACTIVE'").join(ids, "chunk_id", "left_semi") if active_only else chunks.join(ids, "chunk_id", "left_semi")


def latest_parse(documents: DataFrame, parses: DataFrame) -> DataFrame:
    """Each document with its last cleaned parse."""
    last = parses.where("status = 'CLEANED'").groupBy("doc_id").agg(F.max_by(F.struct("parse_id", "clean_content"), "parse_id").alias("p"))
    return documents.join(last, "doc_id").select("*", "p.*").drop("p")
