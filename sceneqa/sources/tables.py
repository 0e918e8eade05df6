"""Readers: explicit schemas, file names as columns, versions unified, tolerant logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Integer microseconds of a timestamp without zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


QA_SCHEMA = """sample_idx bigint, qa_pairs array<struct<question string, answer string, category string, template_idx int>>,
 qa_results array<struct<category string, template_idx int, answer_type string, pairs array<struct<pair_id int,
 positive struct<instantiated_question string, answer string, reasoning string>,
 contrastive struct<instantiated_question string, answer string, reasoning string>, contrastive_skip_reason string>>>>"""


def qa_files(spark: SparkSession, path: str, pattern: str = "*_qa_results*.json") -> DataFrame:
    """One document per file, with its name and version (v1 has qa_pairs, v2 qa_results; v1 wins)."""
    df = spark.read.schema(QA_SCHEMA).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    version = F.when(F.col("qa_pairs").isNotNull(), "v1").when(F.col("qa_results").isNotNull(), "v2")
    return df.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("version", version)


def unify_qa(files: DataFrame) -> DataFrame:
    """Flat rows of both versions: file, sample_idx, category, template_idx, pair_id, role, question, answer, skip."""
    v1 = files.where("version = 'v1'").select("file", "sample_idx", F.explode("qa_pairs").alias("p"))
    v1 = v1.select("file", "sample_idx", "p.category", "p.template_idx", F.lit(None).cast("int").alias("pair_id"), F.lit("positive").alias("role"), F.col("p.question").alias("question"), "p.answer", F.lit(None).cast("string").alias("skip"))
    v2 = files.where("version = 'v2'").select("file", "sample_idx", F.explode("qa_results").alias("r")).select("file", "sample_idx", "r.category", "r.template_idx", F.explode("r.pairs").alias("p"))
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"p.{r}").alias("b")) for r in ("positive", "contrastive")])).alias("x")
    v2 = v2.select("file", "sample_idx", "category", "template_idx", "p.pair_id", F.col("p.contrastive_skip_reason").alias("skip"), roles).where("x.b is not null")
    return v1.unionByName(v2.select("file", "sample_idx", "category", "template_idx", "pair_id", "x.role", F.col("x.b.instantiated_question").alias("question"), "x.b.answer", "skip"))


def tolerant_log(spark: SparkSession, path: str, schema: str | StructType, keys: list[str]) -> DataFrame:
    """A JSON-lines log: broken and blank lines go, the last line of a key within a file wins, later files win over earlier."""
    from sceneqa.operators.windows import last_write

    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_line"))
    parsed = raw.where(F.trim("value") != "").select(F.from_json("value", schema if isinstance(schema, str) else schema.simpleString(), {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("_ok"), "_file", "_line")
    rows = parsed.where("_ok is not null and r is not null").select("r.*", "_file", "_line")
    return last_write(rows, keys, [F.col("_file"), F.col("_line")]).drop("_file", "_line")


def strict_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines manifest; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exactly eight fields t x y z qx qy qz qw: ts_us, position, quaternion [w, x, y, z]."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 8).select(F.transform("f", lambda x: x.try_cast("double")).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    at = lambda i: F.get("v", i)
    return rows.select(F.rint(at(0) * 1e6).cast("bigint").alias("ts_us"), F.array(at(1), at(2), at(3)).alias("position"), F.array(at(7), at(4), at(5), at(6)).alias("quaternion"))


def late_header_csv(spark: SparkSession, path: str, first_column: str, value: str, scale: float = 1 / 3.6) -> DataFrame:
    """CSV files whose header is the first line of each that begins with first_column: time, value * scale; bad rows go.

    A first pass finds the place of each file's header (its split and line) and the column named; then lines behind it are parsed where they
    are read. Neither pass holds a file, so a large one is read by many tasks; places are a row for each file, whose list the driver has.
    A file without such a line gives no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = lines.withColumn("at", F.struct("split", "line"))  # lines of a split are numbered in their order
    cells = F.split("value", ",")
    heads = lines.where(F.trim(F.get(cells, 0)) == first_column).groupBy("file").agg(F.min("at").alias("head"), F.min_by("value", "at").alias("names"))
    place = heads.select("file", "head", (F.array_position(F.transform(F.split("names", ","), lambda x: F.trim(x)), F.lit(value)) - 1).cast("int").alias("column"))
    rows = lines.join(F.broadcast(place), "file").where(F.col("at") > F.col("head"))
    out = rows.select(F.get(cells, 0).try_cast("double").alias("time"), (F.get(cells, F.col("column")).try_cast("double") * scale).alias("value"))
    return out.where("time is not null and value is not null")


def benchmark_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark table whose short image cells name another row: that row's image stands in."""
    df = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    own = df.withColumn("index", F.col("index").cast("string"))
    other = own.select(F.col("index").alias("_i"), F.col("image").alias("_image")).where(F.length("_image") > 64)
    joined = own.join(other, (F.length(own.image) <= 64) & (own.image == other["_i"]), "left")
    return joined.withColumn("image", F.coalesce("_image", "image")).drop("_i", "_image")


def inference_jsonl(spark: SparkSession, path: str, annotation: str) -> DataFrame:
    """annotation.* and the generated text as prediction."""
    df = spark.read.schema(f"question_id string, annotation struct<{annotation}>, result struct<gen string>").json(path)
    return df.select("question_id", "annotation.*", F.col("result.gen").alias("prediction"))


def sampled_name(name: str) -> tuple[str, float]:
    """`name%NN` as the name and the share."""
    base, _, pct = name.partition("%")
    return base, int(pct) / 100 if pct else 1.0


def run_reports(spark: SparkSession, root: str, pattern: str = r"/([^/]+)__seed(\d+)/summary\.json$") -> DataFrame:
    """Run summaries below a root: experiment, seed, summary (JSON text)."""
    df = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").text(root)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_extract(path, pattern, 1).alias("experiment"), F.regexp_extract(path, pattern, 2).try_cast("int").alias("seed"), F.col("value").alias("summary")).where("experiment <> ''")


def prior_results(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """sample_idx, response: from `NNNN_*_suffix.json`, the first file of a sample by name; blank ones are null."""
    df = spark.read.schema("response string").option("multiLine", True).option("pathGlobFilter", f"*_{suffix}.json").json(root)
    name = F.col("_metadata.file_name")
    rows = df.select(F.regexp_extract(name, r"^(\d+)_", 1).try_cast("bigint").alias("sample_idx"), name.alias("file"), F.nullif(F.trim("response"), F.lit("")).alias("response"))
    return rows.where("sample_idx is not null").groupBy("sample_idx").agg(F.min_by("response", "file").alias("response"))
