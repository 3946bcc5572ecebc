"""Tables that cut lineage, in the folder that the cluster shares, and helpers for column names and hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources import shared
from sluice.sources.shared import fresh_path

#: At most so many keys can have more than one part in HOT_KEYS of all rows.
HOT_KEYS = 5_000
#: A table of at most FEW * HOT_KEYS rows has few keys in any case.
FEW = 4


def n_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """df dealt by column as a bucketed table needs it."""
    return df.repartition(n_buckets(df.sparkSession), column)


def written(df: DataFrame, name: str, bucketed_by: str | None = None) -> DataFrame:
    """The rows of df, written once to the shared folder and read back. With bucketed_by (df dealt by bucketed() first),
    later joins on that column don't move this table."""
    if bucketed_by is None:
        return shared.written(df, name)
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shared.shuffles_dropped(spark):
        df.write.bucketBy(n_buckets(spark), bucketed_by).option("path", path).format("parquet").saveAsTable(table_name(path))
    return spark.table(table_name(path))


def table_name(path: str) -> str:
    return path.rsplit("/", 1)[1].replace("-", "_")


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing will read again, and their catalogue entries where they are bucketed."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if spark.catalog.tableExists(table_name(path)):
                spark.sql(f"DROP TABLE `{table_name(path)}`")
            shared.delete(spark, path)


def joined_by_key(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows with the columns of facts (one row a key; ``count`` says how many rows have the key), as a left join. Keys of
    more than one part in HOT_KEYS of total rows are at most HOT_KEYS, so their facts are broadcast and such a key's rows
    stay where they are, as do rows without a key; all other rows meet their facts in a shuffle. Where total itself is
    small, so are the facts: all are broadcast, in a plan of a third of the size (the driver's memory on small tables
    follows its plans)."""
    if total <= FEW * HOT_KEYS:
        return rows.join(F.broadcast(facts.drop(count)), key, "left")
    is_hot = F.col(count) > total / HOT_KEYS
    hot = F.broadcast(facts.where(is_hot).drop(count))
    keyed = rows.where(F.col(key).isNotNull())
    cold = keyed.join(hot.select(key), key, "left_anti").join(facts.where(~is_hot).drop(count), key, "left")
    return keyed.join(hot, key).unionByName(cold).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
