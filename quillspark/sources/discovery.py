"""Files as tables: image paths put right by a listing, summaries of three shapes, and parts of a dataset by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How annotations name their images, and where one set of them lies.
RAW_MARK = "VisualPRM400K-v1.1-Raw/"
IMAGES, NESTED = "images/", "nlvr2/images/"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root) and length of all files in a folder and below; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:/+"
    plain = lambda c: F.regexp_replace(c, scheme, "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root.split("/", 1)[0] else root.rstrip("/") + "/"
    return files.select(F.substring(plain(F.col("path")), F.lit(len(base) + 1), F.length("path")).alias("path"), "length")


def candidates(path: Column, image_root: str, data_root: str, must_exist: bool = False) -> Column:
    """Where an image may lie, as (path, probe) in order: the first that needs no probe or is there counts.

    An absolute path counts if it is there; behind the mark of raw annotations, or behind `images/`
    (also in the nested set), a path lies below the image root; any other below the data root, else the image root.  With
    must_exist the last resort is probed too, so that what is nowhere is null.
    """
    raw = F.replace(path, F.lit("\\"), F.lit("/"))
    behind = F.regexp_replace(F.substring(raw, F.locate(RAW_MARK, raw) + len(RAW_MARK), F.length(raw)), f"^{IMAGES}", "")
    below = F.substring(raw, F.lit(len(IMAGES) + 1), F.length(raw))
    one = lambda probe, *parts: F.struct(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("path"), F.lit(probe).alias("probe"))
    root, data = image_root.rstrip("/") + "/", data_root.rstrip("/") + "/"
    # a path joined to a root is itself if it is absolute
    under = lambda probe, base, p: F.when(p.startswith("/"), one(probe, p)).otherwise(one(probe, base, p))
    relative = (
        F.when(raw.contains(RAW_MARK), F.array(under(must_exist, root, behind)))
        .when(raw.startswith(IMAGES), F.array(under(True, root, below), one(True, root + NESTED, below), under(must_exist, root, below)))
        .otherwise(F.array(under(True, data, raw), under(must_exist, root, raw)))
    )
    return F.when(F.coalesce(path, F.lit("")) == "", F.array().cast("array<struct<path: string, probe: boolean>>")).when(path.startswith("/"), F.concat(F.array(one(True, path)), relative)).otherwise(relative)


def resolve_images(rows: DataFrame, path: str, files: DataFrame, image_root: str, data_root: str, must_exist: bool = False) -> DataFrame:
    """Rows with `resolved`: where the image of each path lies, by a listing of whole paths (`path`).

    Each distinct path is looked up once, however many rows have it; candidates meet the
    listing in one semi join, and nothing probes a file system.
    """
    paths = rows.select(F.col(path).alias("_p")).where("_p is not null").distinct()
    each = paths.select("_p", F.posexplode(candidates(F.col("_p"), image_root, data_root, must_exist)).alias("_k", "_c")).select("_p", "_k", "_c.path", "_c.probe")
    there = each.where("probe").join(files.select("path").distinct(), "path", "left_semi").select("_p", "_k", "path")
    found = there.unionByName(each.where("not probe").select("_p", "_k", "path")).groupBy("_p").agg(F.min_by("path", "_k").alias("resolved"))
    return rows.join(found, rows[path] == found["_p"], "left").drop("_p")


def image_lists(rows: DataFrame, key: str, images: str, files: DataFrame, image_root: str, data_root: str, must_exist: bool = False) -> DataFrame:
    """key and `resolved`: the images of each row in order, those that are nowhere left out; rows: key and a list of paths."""
    each = rows.select(key, F.posexplode_outer(images).alias("_i", "_path"))
    met = resolve_images(each, "_path", files, image_root, data_root, must_exist)
    order = F.array_sort(F.collect_list(F.when(F.col("resolved").isNotNull(), F.struct("_i", "resolved"))))  # a row's own images
    return met.groupBy(key).agg(F.transform(order, lambda x: x["resolved"]).alias("resolved"))


def read_summaries(spark: SparkSession, root: str, strict: bool = True) -> DataFrame:
    """summary (variant) and summary_path of all files named summary.json or ending in _summary.json, at any depth.

    Three shapes: a list under `summaries` (its objects are rows each), an object under `summary`, and an object with
    `backend` and `mode`; others give no row.  A file that is no JSON stops the job, or, if not
    strict, gives no row.
    """
    texts = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "{summary.json,*_summary.json}").text(root, wholetext=True).select("value", F.col("_metadata.file_path").alias("summary_path"))
    return summaries(texts, strict)


def summaries(texts: DataFrame, strict: bool = True) -> DataFrame:
    """The summaries in texts of JSON; rows: value, summary_path."""
    parsed = texts.select((F.parse_json if strict else F.try_parse_json)("value").alias("v"), "summary_path")
    is_object = lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    field = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    listed = F.coalesce(F.schema_of_variant(field("summaries")).startswith("ARRAY"), F.lit(False))
    items = (
        F.when(listed, F.filter(F.try_variant_get("v", "$.summaries", "array<variant>"), is_object))
        .when(is_object(field("summary")), F.array(field("summary")))
        .when(is_object(F.col("v")) & field("backend").isNotNull() & field("mode").isNotNull(), F.array(F.col("v")))
    )
    return parsed.select(F.explode(items).alias("summary"), "summary_path")


def number(summary: Column, *names: str) -> Column:
    """A number at a path of a variant; 0 where there is none."""
    return F.coalesce(F.try_variant_get(summary, "$." + ".".join(names), "double"), F.lit(0.0))


def cost_rows(found: DataFrame, labels: dict[tuple[str, str], str] | None = None, soft: str = "visualprm", least: int = 0) -> DataFrame:
    """What a run of each summary cost: times and tokens per sample, with their sources, F1 and errors.

    Tokens that the interface counted come first, then estimates; a backend that gives soft scores makes no text.
    Runs of fewer samples than `least` are left out.
    """
    s = F.col("summary")
    text = lambda name: F.coalesce(F.try_variant_get(s, f"$.{name}", "string"), F.lit(""))
    per = lambda x: F.coalesce(F.try_divide(x, number(s, "num_samples")), F.lit(0.0))
    prompt, completion = number(s, "usage", "prompt_tokens"), number(s, "usage", "completion_tokens")
    kind = F.concat(text("backend"), F.lit(":"), text("mode"))
    method = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for (b, m), name in labels.items() for x in (f"{b}:{m}", name))), kind), kind) if labels else kind
    named = F.nullif(text("generated_tokens_source"), F.lit(""))
    out = found.select(
        method.alias("method"), text("backend").alias("backend"), text("mode").alias("mode"), number(s, "num_samples").cast("bigint").alias("num_samples"), number(s, "num_steps").cast("bigint").alias("num_steps"),
        per(number(s, "wall_time_sec")).alias("avg_time_per_sample_s"), number(s, "latency_sec", "mean").alias("avg_latency_per_sample_s"),
        per(F.when(prompt > 0, prompt).otherwise(number(s, "text_input_tokens"))).alias("avg_input_tokens_per_sample"), F.when(prompt > 0, "api_prompt_tokens").otherwise("text_tokenizer_estimate").alias("input_token_source"),
        F.when(completion > 0, per(completion)).when(text("backend") == soft, 0.0).otherwise(per(number(s, "generated_tokens"))).alias("avg_output_tokens_per_sample"),
        F.when(completion > 0, "api_completion_tokens").when(text("backend") == soft, "not_applicable_visualprm_soft_score").otherwise(F.coalesce(named, F.lit("generated_tokens"))).alias("output_token_source"),
        number(s, "quality_metrics", "overall_step_macro_f1", "macro_f1").alias("macro_f1"), number(s, "num_errors").cast("bigint").alias("num_errors"), number(s, "num_parse_errors").cast("bigint").alias("num_parse_errors"), "summary_path",
    )
    return out.where(F.col("num_samples") >= least)


@dataclass(frozen=True)
class Subset:
    """A part of a dataset: its name, the splits that are read, and whether `all` leaves it out."""

    name: str
    splits: tuple[str, ...] = ("train",)
    weak: bool = False


def select_subsets(known: list[Subset], asked: list[str]) -> list[Subset]:
    """The subsets asked for.  None asked: the only one, or the one called default, else an error; `all`: those that are not weak; an unknown name is a subset of its own."""
    by_name = {s.name: s for s in known}
    if not asked:
        if len(known) > 1 and "default" not in by_name:
            raise ValueError(f"name subsets; there are {', '.join(by_name)}")
        return [by_name["default"]] if len(known) > 1 else [*known]
    if asked == ["all"] and "all" not in by_name:
        return [s for s in known if not s.weak]
    return [by_name.get(a, Subset(a)) for a in asked]


def split_spec(path: str, default: str = "train") -> tuple[str, str]:
    """Path and split of `path@split`."""
    head, at, tail = path.rpartition("@")
    return (head, tail) if at else (path, default)


#: Formats by the ending of file names (fixed values).
FORMATS = {"json": "json", "jsonl": "json", "parquet": "parquet", "csv": "csv", "tsv": "csv", "txt": "text"}


def read_path(spark: SparkSession, spec: str) -> DataFrame:
    """The table of `path@split`: a file or a folder, in the format that its first file's name ends in; rows of a `split` column of another split are left out."""
    path, split = split_spec(spec)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/[_.][^/]*$")).select("path")
    first = files.agg(F.min("path")).first()[0]
    if first is None:
        raise FileNotFoundError(f"no files in {path}")
    ending = first.rpartition("/")[2].rpartition(".")[2].lower()
    if ending not in FORMATS:
        raise ValueError(f"no reader for .{ending}")
    reader = spark.read.option("recursiveFileLookup", True)
    if ending == "json":
        reader = reader.option("multiLine", True)
    if FORMATS[ending] == "csv":
        reader = reader.option("header", True).option("inferSchema", True).option("sep", "\t" if ending == "tsv" else ",")
    out = reader.format(FORMATS[ending]).load(path)
    return out.where(F.col("split") == split) if "split" in out.columns else out
