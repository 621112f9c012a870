"""Fixed values that results depend on, and the registry of codebases."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
MIN_CHUNK_TOKENS, MAX_CHUNK_TOKENS = 64, 768
DEFAULT_TOP_K = 10
EMBEDDING_DIM, EMBEDDING_BATCH = 1536, 128
IDENTIFIER_WEIGHTS, SEMANTIC_WEIGHTS = (0.4, 0.6), (0.7, 0.3)  # dense, sparse
HIGH_FROM, MEDIUM_FROM = 0.75, 0.45
NAME_BOOST, DIVISION_BOOST, PATH_BOOST, DEPENDENCY_BOOST = 0.20, 0.10, 0.05, 0.05
FEATURE_DEPENDENCY_BOOST, CODEBASE_BOOST, LANGUAGE_BOOST, MAX_BOOST = 0.05, 0.03, 0.02, 0.30
METADATA_SHARE, CROSS_ENCODER_SHARE = 0.40, 0.60
EQUAL_FUSION, EQUAL_RERANK = 1.0, 0.5
BM25_K1, BM25_B = 1.2, 0.75
POINT_NAMESPACE = "a1b2c3d4-e5f6-7890-abcd-ef1234567890"
FEATURES = (
    "code_explanation",
    "dependency_mapping",
    "pattern_detection",
    "impact_analysis",
    "documentation_gen",
    "translation_hints",
    "bug_pattern_search",
    "business_logic",
)
DIVISION_HINTS = {
    "PROCEDURE": ("procedure", "perform", "paragraph", "logic", "flow", "execution"),
    "DATA": ("data", "working-storage", "field", "record", "copybook"),
    "IDENTIFICATION": ("identification", "program-id"),
    "ENVIRONMENT": ("environment", "configuration", "file-control"),
}
#: name, language, extensions, preprocessor, chunker, description; the first that has an extension owns it.
CODEBASES = (
    ("gnucobol", "cobol", (".cob", ".cbl", ".cpy"), "cobol", "cobol_paragraph", "Open source COBOL compiler"),
    ("gfortran", "fortran", (".f", ".f90", ".f77", ".f95"), "fortran", "fortran_subroutine", "Fortran compiler in GCC"),
    ("lapack", "fortran", (".f", ".f90"), "fortran", "fortran_subroutine", "Linear algebra library"),
    ("blas", "fortran", (".f",), "fortran", "fortran_subroutine", "Basic linear algebra subprograms"),
    ("opencobol-contrib", "cobol", (".cob", ".cbl", ".cpy"), "cobol", "cobol_paragraph", "Sample COBOL programs and utilities"),
)
#: Names of codebases as people know them; others are shown as they are.
LABELS = {"gnucobol": "GnuCOBOL", "gfortran": "GFortran", "lapack": "LAPACK", "blas": "BLAS", "opencobol-contrib": "OpenCOBOL Contrib"}
CODEBASE_SCHEMA = "name string, language string, extensions array<string>, preprocessor string, chunker string, description string, ord int"


def codebases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row[:2], list(row[2]), *row[3:], i) for i, row in enumerate(CODEBASES)], CODEBASE_SCHEMA)


def codebase_options(spark: SparkSession) -> DataFrame:
    """value, label, ord of a codebase selector: all of them (null), then each of the registry."""
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in LABELS.items()))
    each = codebases(spark).select(F.col("name").alias("value"), F.coalesce(F.try_element_at(known, F.col("name")), "name").alias("label"), (F.col("ord") + 1).alias("ord"))
    return spark.createDataFrame([(None, "All codebases", 0)], "value string, label string, ord int").unionByName(each)


def example_queries(chosen: DataFrame, examples: DataFrame, defaults: DataFrame) -> DataFrame:
    """chosen (codebase, feature) with examples: those of both (examples: codebase, feature, queries) if there are any, else the feature's (defaults: feature, queries)."""
    own = examples.select("codebase", "feature", F.col("queries").alias("__own"))
    of_feature = defaults.select("feature", F.col("queries").alias("__default"))
    found = chosen.join(F.broadcast(own), ["codebase", "feature"], "left").join(F.broadcast(of_feature), "feature", "left")  # tables of a user interface: a few dozen rows
    return found.withColumn("examples", F.when(F.size("__own") > 0, F.col("__own")).otherwise(F.col("__default"))).drop("__own", "__default")
