"""The catalogue: its tables as DataFrames, their columns, and what a table must look like."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Column types by table. Tables may have more columns.
COLUMNS = {
    "records": "id long, mms_id string, source_file string, created_at timestamp, jsonl_line_number long",
    "imprints": "id long, record_id long, occurrence int, date_raw string, place_raw string, publisher_raw string, manufacturer_raw string, source_tags array<string>, date_start int, date_end int, date_label string, date_confidence double, date_method string, place_norm string, place_display string, place_confidence double, place_method string, publisher_norm string, publisher_display string, publisher_confidence double, publisher_method string, country_code string, country_name string",
    "titles": "id long, record_id long, title_type string, value string, source array<string>",
    "subjects": "id long, record_id long, value string, source_tag string, scheme string, heading_lang string, authority_uri string, parts map<string,array<string>>, source array<string>, value_he string",
    "agents": "id long, record_id long, agent_index int, agent_raw string, agent_type string, role_raw string, role_source string, authority_uri string, agent_norm string, agent_confidence double, agent_method string, agent_notes string, role_norm string, role_confidence double, role_method string, provenance array<string>",
    "languages": "id long, record_id long, code string, source array<string>",
    "notes": "id long, record_id long, tag string, value string, source array<string>",
    "physical_descriptions": "id long, record_id long, value string, source array<string>",
    "agent_authorities": "id long, canonical_name string, canonical_name_lower string, agent_type string, confidence double, authority_uri string, wikidata_id string",
    "agent_aliases": "id long, authority_id long, alias_form string, alias_form_lower string, alias_type string, script string",
    "publisher_authorities": "id long, canonical_name string, canonical_name_lower string, type string, location string, dates_active string, date_start int, date_end int, is_missing_marker boolean",
    "publisher_variants": "id long, authority_id long, variant_form string, variant_form_lower string, script string",
    "authority_enrichment": "authority_uri string, wikidata_id string, label string, description string, person_info string, image_url string, wikipedia_url string, confidence double, fetched_at timestamp, expires_at timestamp",
    "wikipedia_cache": "wikidata_id string, wikipedia_title string, summary string, categories array<string>, see_also_titles array<string>, article_wikilinks array<string>",
    "wikipedia_connections": "source string, target string, type string",
    "record_scope_flags": "record_id long, flag string",
    "network_nodes": "agent_norm string, display_name string, place string, birth_year int, record_count long, connection_count long, has_wikipedia boolean, community string, node_type string",
    "network_edges": "source string, target string, type string, confidence double, relationship string, bidirectional boolean, evidence string",
}
#: Columns that a row may not lack.
REQUIRED = {"records": ("id", "mms_id"), "imprints": ("record_id",), "titles": ("record_id",), "subjects": ("record_id",), "agents": ("record_id",), "languages": ("record_id",), "notes": ("record_id",), "physical_descriptions": ("record_id",)}
PERSON = "birth_year int, death_year int, birth_place string, occupations array<string>, teachers array<string>, students array<string>, notable_works array<string>, hebrew_label string"


def schema(table: str) -> T.StructType:
    return T._parse_datatype_string(COLUMNS[table])


@dataclass
class Catalog:
    """The tables of one catalogue; the authority and enrichment tables are optional."""

    records: DataFrame
    imprints: DataFrame
    titles: DataFrame
    subjects: DataFrame
    agents: DataFrame
    languages: DataFrame
    notes: DataFrame
    physical_descriptions: DataFrame
    agent_authorities: DataFrame | None = None
    agent_aliases: DataFrame | None = None
    publisher_authorities: DataFrame | None = None
    publisher_variants: DataFrame | None = None
    authority_enrichment: DataFrame | None = None
    wikipedia_cache: DataFrame | None = None
    wikipedia_connections: DataFrame | None = None
    record_scope_flags: DataFrame | None = None
    network_nodes: DataFrame | None = None
    network_edges: DataFrame | None = None
    config: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: t for f in fields(self) if f.name != "config" and (t := getattr(self, f.name)) is not None}

    @property
    def has_aliases(self) -> bool:
        return self.agent_aliases is not None and self.agent_authorities is not None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        """The tables written under ``path``, at once or by batches; those that are not there are left out where optional."""
        jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = {s.getPath().getName().removesuffix(".parquet") for s in jvm.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(jvm)}
        return cls(**{t: spark.read.parquet(f"{path}/{t}.parquet").drop("batch") for t in COLUMNS if t in there})

    def save(self, path: str, mode: str = "error") -> None:
        for name, t in self.tables().items():
            t.write.mode(mode).parquet(f"{path}/{name}.parquet")


def export(df: DataFrame, path: str, kind: str, mode: str = "error") -> None:
    """Write a result as ``csv`` with a header (arrays and structs as JSON), ``jsonl`` or ``parquet``, in parts."""
    from pyspark.sql import functions as F

    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType)]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif kind == "jsonl":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
    elif kind == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"no such format: {kind}")


def load_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """(key, value) of files that hold one JSON object each, as alias, country, geocode and concept maps do.

    ``value`` is the type of the object's values, such as ``array<string>`` or ``struct<lat:double,lon:double>``.
    """
    from pyspark.sql import functions as F

    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def differences(table: str, df: DataFrame) -> list[str]:
    """What a table's schema lacks or has of another type; a report, never an error."""
    have, out = dict(df.dtypes), []
    for f in schema(table).fields:
        kind = f.dataType.simpleString()
        if f.name not in have:
            out.append(f"{table}.{f.name} is missing")
        elif have[f.name] != kind:
            out.append(f"{table}.{f.name} is {have[f.name]}, expected {kind}")
    return out


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: what INSERT OR IGNORE leaves."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``: what INSERT OR REPLACE leaves."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
