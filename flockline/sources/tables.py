"""Scans, sinks and alignment checks of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The columns that metadata must have.
METADATA = ("image_id", "identity", "path", "date", "orientation", "species", "split", "dataset")
METADATA_SCHEMA = StructType([StructField(c, StringType()) for c in METADATA])
JUDGMENT = StructType([StructField(c, StringType()) for c in ("judgment_id", "dataset", "candidate_type", "candidate_key", "pair_key", "image_id", "neighbor_image_id", "label", "note")])
JUDGMENTS = StructType([StructField("session_name", StringType()), StructField("pair_judgments", ArrayType(JUDGMENT))])
OPERATION = StructType(
    [
        *[StructField(c, StringType()) for c in ("operation_id", "dataset", "action", "anchor_image_id")],
        StructField("source_cluster_ids", ArrayType(IntegerType())),
        *[StructField(c, ArrayType(StringType())) for c in ("member_image_ids", "exclude_image_ids")],
        StructField("note", StringType()),
    ]
)
OVERLAY = StructType([StructField("rule_name", StringType()), StructField("operations", ArrayType(OPERATION))])
#: What a reviewer may answer.
VERDICTS = ("yes", "no", "uncertain")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata from CSV, all strings; a missing identity is ''."""
    found = spark.read.option("header", True).csv(path)
    return require(found, METADATA).withColumns({"image_id": F.col("image_id").cast("string"), "identity": F.coalesce("identity", F.lit(""))})


def labeled(df: DataFrame) -> DataFrame:
    """Rows with an identity and a path."""
    return df.where((F.coalesce(F.trim("identity"), F.lit("")) != "") & (F.coalesce(F.trim("path"), F.lit("")) != ""))


def optional(spark: SparkSession, path: str, schema: StructType, reader: str = "csv") -> DataFrame:
    """A table that may not exist yet: empty, with the schema, where it does not."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).format(reader).load(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of a JSON session file; rows without a known answer go."""
    rows = spark.read.schema(JUDGMENTS).option("multiLine", True).json(path).select("session_name", F.explode("pair_judgments").alias("j")).select("session_name", "j.*")
    return rows.withColumn("label", F.lower(F.trim("label"))).where(F.col("label").isin(*VERDICTS)).orderBy("dataset", "pair_key", "judgment_id")


def overlay(spark: SparkSession, path: str) -> DataFrame:
    """Operations of a JSON overlay file, in the order in which they stand."""
    return spark.read.schema(OVERLAY).option("multiLine", True).json(path).select("rule_name", F.posexplode("operations").alias("position", "o")).select("rule_name", "position", "o.*")


def wide_ranks(df: DataFrame, id_column: str, n: int, id_name: str = "rank_{}_id", score_name: str = "rank_{}_score") -> DataFrame:
    """A wide rank table in long form: ``id_column``, rank, neighbor, score."""
    ranks = F.array(*[F.struct(F.lit(k).cast("bigint").alias("rank"), F.col(id_name.format(k)).alias("neighbor"), F.col(score_name.format(k)).alias("score")) for k in range(1, n + 1)])
    return df.select(id_column, F.explode(ranks).alias("r")).select(id_column, "r.*").where("neighbor is not null")


def write_one(df: DataFrame, path: str, format: str = "csv") -> None:
    df.write.mode("overwrite").option("header", True).format(format).save(path)


def write_json_document(df: DataFrame, path: str, name: str, items: str, **fields: str) -> None:
    """One JSON document: fields, and all rows under ``items``, ordered by their text. For files that people review."""
    rows = F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns))))
    body = F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]"))
    head = ",".join(f'"{k}":"{v}"' for k, v in ({"session_name": name} | fields).items())
    df.agg(F.concat(F.lit("{" + head + f',"{items}":'), body, F.lit("}")).alias("value")).write.mode("overwrite").text(path)


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a Markdown table, for reports."""
    rows = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r] for r in df.limit(limit).collect()]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def mismatches(reference: DataFrame, candidate: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ in the columns that both tables have, or that one lacks: keys, reason."""
    shared = [c for c in reference.columns if c in candidate.columns and c not in keys]
    a = reference.select(*keys, F.struct(F.lit(1), *shared).alias("a"))
    b = candidate.select(*keys, F.struct(F.lit(1), *shared).alias("b"))
    reason = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unexpected").otherwise("different")
    return a.join(b, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, reason.alias("reason"))


def aligned(reference: DataFrame, candidate: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """The candidate's rows for the reference's keys; a missing or repeated key raises if ``check``."""
    if check:
        if not candidate.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"the candidate repeats a key of {keys}")
        if not reference.join(candidate, keys, "left_anti").isEmpty():
            raise ValueError(f"the candidate lacks a key of {keys}")
    return reference.select(*keys).join(candidate, keys, "left")


def submission(sample: DataFrame, predictions: DataFrame, key: str, label: str, name: str, check: bool = True) -> DataFrame:
    """The sample's rows with their predicted label under ``name``; a missing label raises if ``check``."""
    if check and not sample.join(predictions.where(F.col(label).isNotNull()), key, "left_anti").isEmpty():
        raise ValueError("a row of the sample has no prediction")
    return sample.select(key).join(predictions.select(key, F.col(label).alias(name)), key, "left")


