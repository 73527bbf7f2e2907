"""Readers of record files and of the engine's configuration."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "name", "current_title", "current_company", "location", "graduation_year", "degree", "major")])
_STINT = T.StructType([T.StructField(n, T.StringType()) for n in ("company", "title", "location", "start_date", "end_date", "description")] + [T.StructField("is_current", T.BooleanType())])
NESTED = T.StructType([*RECORD.fields, T.StructField("experience", T.ArrayType(_STINT)), T.StructField("education", T.ArrayType(T.MapType(T.StringType(), T.StringType()))), T.StructField("skills", T.ArrayType(T.StringType()))])


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """CSV (with header), JSON lines, Parquet or Excel (through pandas, where installed); other suffixes give None.

    CSV needs a schema (RECORD by default); broken lines keep their readable fields (PERMISSIVE).
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema or RECORD).csv(path)
    if kind in (".json", ".jsonl"):
        return spark.read.schema(schema or NESTED).json(path)
    if kind in (".parquet", ".pq"):
        return spark.read.parquet(path)
    if kind in (".xlsx", ".xls"):
        import pandas as pd

        return spark.createDataFrame(pd.read_excel(path, dtype=str).astype(object).where(lambda x: x.notna(), None))
    return None


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database; with a numeric `column` and its `bounds` it is read in `parts` ranges at once. The driver
    class must be on the class path."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def read_mappings(path: str | None, fallback: dict[str, list[str]]) -> dict[str, list[str]]:
    """Names and their variants from a JSON file; the built-in ones where there is none or it cannot be read."""
    try:
        with open(path or "") as f:
            held = json.load(f)
    except (OSError, ValueError):
        return fallback
    return {k: [str(x) for x in v] for k, v in held.items() if isinstance(v, list)} if isinstance(held, dict) else fallback


def read_expansions(spark: SparkSession, path: str) -> DataFrame:
    """(term, expansion, weight, rank) from JSON lines of {term, expansions: [[term, weight], ...]} as `sinks.export_terms` writes."""
    one = "term string, expansions array<struct<expansion:string,weight:double>>"
    return spark.read.schema(one).json(path).select("term", F.posexplode("expansions").alias("p", "x")).select("term", "x.expansion", "x.weight", (F.col("p") + 1).alias("rank"))


#: Columns of the engine's own tables.
TABLES = {
    "alumni": "person_id string, name string, current_title string, current_company string, normalized_company string, normalized_title string, location string, normalized_location string, graduation_year int, degree string, major string, record_hash string, created_at timestamp, updated_at timestamp",
    "experience": "person_id string, company string, title string, location string, start_date date, end_date date, description string, is_current boolean",
    "education": "person_id string, school string, degree string, field string, graduation_year int",
    "skills": "person_id string, skill string",
}


def read_files(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame | None:
    """All readable files as one table; missing columns are null, unsupported files are passed over."""
    frames = [f for f in (read_any(spark, p, schema) for p in paths) if f is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


@dataclass
class EngineConfig:
    """Switches and weights of the engine."""

    use_normalized_scoring: bool = True
    use_enhanced_cooccurrence: bool = True
    use_graph_expansion: bool = True
    use_semantic: bool = True
    use_multi_aspect: bool = True
    use_relationships: bool = True
    use_ai_extraction: bool = False
    use_cache: bool = True
    ai_threshold: float = 0.7
    max_results: int = 50
    semantic_weight: float = 0.3
    keyword_weight: float = 0.4
    cooccurrence_weight: float = 0.3
    cache_ttl: int = 3600
    tables: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str) -> EngineConfig:
        """Known keys of a JSON file over the defaults; a missing file is written with them."""
        config = cls()
        if not os.path.exists(path):
            with open(path, "w") as f:
                json.dump(config.__dict__, f, indent=2)
            return config
        with open(path) as f:
            given = json.load(f)
        for k, v in given.items():
            if hasattr(config, k):
                setattr(config, k, v)
        return config
