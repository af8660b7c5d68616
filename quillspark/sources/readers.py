"""Reading and writing annotation, rollout and prediction tables.

Schemas are always given, never inferred.  Missing inputs are told apart by Hadoop's file
system, so that paths may lie in any store.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or pattern) has files."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: Schema, strict: bool = False) -> DataFrame:
    """JSON lines.  Lenient: bad lines are skipped; strict: they fail the job.  A missing file is an empty table; blank lines don't count; NaN and infinities may be bare."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("allowNonNumericNumbers", True).json(path)


def read_json_array(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("allowNonNumericNumbers", True).json(path)


def read_annotations(spark: SparkSession, folder: str, schema: Schema) -> DataFrame:
    """All *.jsonl, then all *.json arrays of a folder, each row with the file it comes from."""
    parts = []
    for pattern, read in (("*.jsonl", read_jsonl), ("*.json", read_json_array)):
        if exists(spark, f"{folder}/{pattern}"):
            parts.append(read(spark, f"{folder}/{pattern}", schema).withColumn("source_annotation", F.col("_metadata.file_path")))
    if not parts:
        return spark.createDataFrame([], schema).withColumn("source_annotation", F.lit("").cast("string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_table(spark: SparkSession, path: str, schema: Schema | None = None) -> DataFrame:
    """A table by its file's ending: csv, tsv, txt, json, jsonl, parquet, orc.

    Csv and tsv without a schema are all strings; an empty field is an empty string, and so is a
    missing one of a short row.  Json needs a schema.
    """
    kind = re.sub(r".*\.", "", path.rstrip("/*")).lower()
    reader = spark.read.schema(schema) if schema is not None and kind not in ("txt", "text") else spark.read
    if kind in ("csv", "tsv"):
        return reader.options(header=True, sep="\t" if kind == "tsv" else ",", nullValue="\x00", emptyValue="", multiLine=True, escape='"').csv(path).fillna("")  # text has no other null: an empty field is not told from an empty string
    if kind in ("txt", "text"):
        return reader.text(path)
    if kind in ("json", "jsonl", "ndjson"):
        if schema is None:
            raise ValueError("json is read with a schema")
        return reader.option("multiLine", kind == "json").json(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    raise ValueError(f"no reader for {path}")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path and data_url of image files; the type is guessed from the name, png by default."""
    kind = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]+)$", 1)
    mime = F.when(kind.isin("jpg", "jpeg"), "jpeg").when(kind.isin("gif", "webp", "bmp"), kind).otherwise("png")
    return spark.read.format("binaryFile").load(path).select("path", F.concat(F.lit("data:image/"), mime, F.lit(";base64,"), F.base64("content")).alias("data_url"))


def without_control_characters(text: Column) -> Column:
    """Without characters that spreadsheets refuse."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A csv table with a fixed header; blanks at the ends of texts stay."""
    df.select(*columns).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    """Add rows to a table."""
    df.write.mode("append").format(kind).save(path)


def markdown(df: DataFrame, most: int = 10_000) -> str:
    """A report table; one of more than `most` rows is no report and an error."""
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


@dataclass(frozen=True)
class Spec:
    """A dataset by name: hub, id or path, subsets, number of rows."""

    hub: str | None
    name: str
    subsets: tuple[str, ...]
    rows: int | None


def parse_spec(text: str, hubs: tuple[str, ...] = ("hf", "ms")) -> Spec:
    """`hub::name:subset1/subset2#rows`; the number is what follows the last #, and parts may be missing."""
    hub, name = (text.split("::", 1) if "::" in text and text.split("::", 1)[0].lower() in hubs else (None, text))
    name, mark, rows = name.rpartition("#")
    if not mark:
        name, rows = rows, ""
    name, _, subsets = name.partition(":") if not re.match(r"^[a-z][a-z0-9+.-]*:/", name) else (name, "", "")
    return Spec(hub.lower() if hub else None, name.strip(), tuple(s.strip() for s in subsets.split("/") if s.strip()), int(rows) if rows else None)


class Catalog:
    """Named tables: register a reader, load it by name with a number of rows in a hash order of its key."""

    def __init__(self) -> None:
        self.readers: dict[str, tuple[object, str]] = {}

    def register(self, name: str, read: object, key: str, exist_ok: bool = False) -> None:
        """read: (spark) -> DataFrame."""
        if name in self.readers and not exist_ok:
            raise ValueError(f"dataset {name} is registered twice")
        self.readers[name] = (read, key)

    def load(self, spark: SparkSession, spec: str) -> DataFrame:
        """The table that a spec names; with more rows asked for than there are, rows recur."""
        from quillspark.operators.sampling import repeat_to
        from quillspark.operators.supervision import hash_order

        s = parse_spec(spec)
        read, key = self.readers[s.name]
        out = read(spark)
        if s.subsets:
            out = out.where(F.col("subset").isin(*s.subsets))
        return out if s.rows is None else repeat_to(out, out.count(), s.rows, [hash_order("0", key), F.col(key)]).drop("copy")


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Standard column names, whatever the case; where two columns claim one name neither is renamed, and a column that has the name keeps it."""
    lower = {k.lower(): v for k, v in mapping.items()}
    claims: dict[str, list[str]] = {}
    for c in df.columns:
        if c.lower() in lower:
            claims.setdefault(lower[c.lower()], []).append(c)
    plan = {c[0]: target for target, c in claims.items() if len(c) == 1 and target not in df.columns}
    return df.withColumnsRenamed(plan)
