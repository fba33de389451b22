"""Unions, upserts, overrides and expansions of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockline.operators.joins import best_rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, the new one where both have a key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def last_wins(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each key. The maximum is found map-side, so a key with many rows is no single group."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("__t"), F.col(tie).alias("__i"), *[F.col(c) for c in rest if c not in (time, tie)])).alias("m")).select(*keys, F.col("m.__t").alias(time), F.col("m.__i").alias(tie), *[f"m.{c}" for c in rest if c not in (time, tie)])


def replaced_slice(base: DataFrame, override: DataFrame, column: str, value: str) -> DataFrame:
    """The base without one value's rows, and the override's rows of that value."""
    return base.where(~F.col(column).eqNullSafe(F.lit(value))).unionByName(override.where(F.col(column) == value), allowMissingColumns=True)


def with_precedence(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """The first table, and the second's rows for keys that the first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def variants(df: DataFrame, names: dict[str, str], key: str) -> DataFrame:
    """A row for each variant whose path column is not null: variant, its rank and an id with the variant's name."""
    options = F.filter(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(c).alias("path")) for n, c in names.items()]), lambda x: x["path"].isNotNull())
    out = df.drop("path", "variant").select("*", F.posexplode(options).alias("variant_rank", "__o"))
    return out.withColumns({"variant": F.col("__o.variant"), "path": F.col("__o.path"), "variant_id": F.concat_ws("__", F.col(key).cast("string"), F.col("__o.variant"))}).drop("__o")


def with_recipes(df: DataFrame, recipes: list[tuple[str, float]], gate: str) -> DataFrame:
    """Each row with each recipe (a short literal list): enabled where the gate holds; the payload as JSON."""
    options = F.array(*[F.struct(F.lit(n).alias("recipe"), F.lit(s).alias("strength")) for n, s in recipes])
    out = df.select("*", F.explode(options).alias("__r")).select(*df.columns, "__r.recipe", "__r.strength")
    return out.withColumns({"enabled": F.col(gate), "payload": F.to_json(F.struct("recipe", "strength"))})


def with_group_size(df: DataFrame, keys: list[str], group: str) -> DataFrame:
    """One row a key (that of least group), and the size of its group."""
    rows = best_rows(df, keys, [F.col(group)])
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, group)


def mixed_frame(labeled: DataFrame, pseudo: DataFrame) -> DataFrame:
    return labeled.withColumn("is_pseudo", F.lit(False)).unionByName(pseudo.withColumn("is_pseudo", F.lit(True)), allowMissingColumns=True)


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Numbers rows in an order; for small tables, since one task numbers them all. See ``positions`` for others."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))


def positions(df: DataFrame, key: str, name: str, ranges: int | None = None) -> DataFrame:
    """Numbers rows by a key of distinct numbers, range by range: no task sees all rows."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    dealt = df.withColumn("__range", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col(key))))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return dealt.join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + place).cast("long")).drop("__range", "__start")
