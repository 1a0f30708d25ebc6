"""Panels of prices and returns: readers, builders from the star schema, validation.

Long layout throughout: prices(date, asset, price), returns(row_idx, date, asset, asset_idx, ret). Missing values are NULL.
The dates of a panel are few (one row per period, whatever the number of trades), so numbering them takes one small sort;
everything else is partitioned by asset or joined to the broadcast date table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of dates and assets below this many rows are broadcast; beyond it Spark chooses the join.
SMALL = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_prices_csv(spark: SparkSession, path: str, assets: list[str]) -> DataFrame:
    """A wide CSV (date, then one column per asset) as long prices; the schema is declared, not inferred."""
    schema = "date DATE, " + ", ".join(f"`{a}` DOUBLE" for a in assets)
    wide = spark.read.csv(path, header=True, schema=schema)
    return wide.unpivot(["date"], assets, "asset", "price").withColumn("price", missing_to_null(F.col("price")))


def read_bars(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One Parquet file per day, unreadable files skipped, only the columns asked for."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path).select(*columns)


def write_panel(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write a result; JSON and CSV refuse NaN and infinity, which have no spelling there."""
    if kind != "parquet":
        bad = F.lit(False)
        for c, t in df.dtypes:
            if t == "double":
                bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(False))
        if not df.filter(bad).isEmpty():
            raise ValueError("non-finite values can't be written")
    getattr(df.write.mode("overwrite"), kind)(path)


def write_by_year(df: DataFrame, path: str) -> None:
    """A dated panel as Parquet, a folder for each year, so that a span of years reads its folders only."""
    df.withColumn("year", F.year("date")).write.mode("overwrite").partitionBy("year").parquet(path)


def read_returns_csv(spark: SparkSession, path: str, assets: list[str]) -> DataFrame:
    """A wide CSV of returns as long rows (date, asset, ret); impossible returns are missing."""
    schema = "date DATE, " + ", ".join(f"`{a}` DOUBLE" for a in assets)
    wide = spark.read.csv(path, header=True, schema=schema).unpivot(["date"], assets, "asset", "ret")
    return wide.withColumn("ret", F.when(valid_return(F.col("ret")), F.col("ret")))


def missing_to_null(x: F.Column) -> F.Column:
    """NaN and infinity are missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def valid_return(x: F.Column) -> F.Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")) & (x >= -1), F.lit(False))


@dataclass(frozen=True)
class PanelSpec:
    """How a panel is made: the table, its period and asset, and the price."""

    name: str

    def prices(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        line = table(spark, sf_dir, "lineitem")
        week = F.date_trunc("week", F.col("l_shipdate")).cast("date").alias("date")
        price = (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")
        if self.name == "flag":
            return line.groupBy(week, F.concat("l_returnflag", "l_linestatus").alias("asset")).agg(price)
        if self.name == "brand":
            part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
            return line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(week, F.col("p_brand").alias("asset")).agg(price)
        if self.name in ("nation", "region"):
            supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
            nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
            rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
            key = F.col("n_name")
            if self.name == "region":
                rows = rows.join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
                key = F.col("r_name")
            return rows.groupBy(week, key.alias("asset")).agg(price)
        if self.name == "priority":
            day = F.date_trunc("week", F.col("o_orderdate")).cast("date").alias("date")
            return table(spark, sf_dir, "orders").groupBy(day, F.col("o_orderpriority").alias("asset")).agg(F.avg("o_totalprice").alias("price"))
        raise ValueError(f"unknown panel {self.name}")


def date_index(prices: DataFrame) -> DataFrame:
    """Rows (date, di): dates numbered from 0. One row per period is sorted, not one per trade."""
    return prices.select("date").distinct().withColumn("di", F.row_number().over(Window.orderBy("date")) - 1)


def asset_index(prices: DataFrame) -> DataFrame:
    """Rows (asset, asset_idx): assets numbered by name."""
    return prices.select("asset").distinct().withColumn("asset_idx", F.row_number().over(Window.orderBy("asset")) - 1)


def simple_returns(prices: DataFrame) -> DataFrame:
    """Rows (date, di, asset, price, ret): the price over the previous date's, NULL if that date has none. No filling."""
    indexed = prices.join(F.broadcast(date_index(prices)), "date")
    by = Window.partitionBy("asset").orderBy("di")
    before, at = F.lag("price").over(by), F.lag("di").over(by)
    return indexed.select("date", "di", "asset", "price", F.when(at == F.col("di") - 1, F.try_divide(F.col("price"), before) - 1).alias("ret"))


def complete_returns(prices: DataFrame) -> DataFrame:
    """Rows (row_idx, date, asset, asset_idx, ret) of dates on which every asset has a return."""
    moved = simple_returns(prices)
    assets = asset_index(prices)
    full = moved.groupBy("date").agg(F.count("ret").alias("n")).join(assets.agg(F.count(F.lit(1)).alias("n")), "n").select("date")
    rows = full.withColumn("row_idx", F.row_number().over(Window.orderBy("date")) - 1)
    return moved.join(F.broadcast(rows), "date").join(F.broadcast(assets), "asset").select("row_idx", "date", "asset", "asset_idx", "ret")


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The complete returns of a named panel."""
    return complete_returns(PanelSpec(name).prices(spark, sf_dir))


def live_mask(prices: DataFrame) -> DataFrame:
    """Rows (date, asset, live) for every date and asset: whether there is a price above zero."""
    grid = prices.select("date").distinct().crossJoin(F.broadcast(prices.select("asset").distinct()))  # the panel's own size
    return grid.join(prices, ["date", "asset"], "left").select("date", "asset", F.coalesce(F.col("price") > 0, F.lit(False)).alias("live"))


def members(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Membership (index_name, date, asset): nations that shipped lines of an order priority in a week."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin(*names)).select("o_orderkey", F.col("o_orderpriority").alias("index_name"))
    supplier = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("asset"))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.date_trunc("week", "l_shipdate").cast("date").alias("date"))
    return line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select("index_name", "date", "asset").distinct()


#: A key is a family's name, a mark and a number.
KEY = r"^(\w+)#(\d+)$"


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (key, family, number) of the keys that are well formed."""
    return rows.filter(F.rlike("key", F.lit(KEY))).select("key", F.regexp_extract("key", KEY, 1).alias("family"), F.regexp_extract("key", KEY, 2).cast("long").alias("number"))


def first_assets(returns: DataFrame, cap: int) -> DataFrame:
    """Only the first assets by name."""
    return returns.filter(F.col("asset_idx") < cap)


def parse_spec(spec: str) -> tuple[str, int | None]:
    """"name", "name:size" or "name(size)"."""
    name, _, size = spec.replace("(", ":").rstrip(")").partition(":")
    return name, int(size) if size else None


def violations(prices: DataFrame) -> DataFrame:
    """One row per broken rule of a long panel (rule, n): repeated cells, empty keys, impossible values, too few assets."""
    cells = prices.groupBy("date", "asset").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.lit("repeated cell").alias("rule"), F.count(F.lit(1)).alias("n"))
    keys = prices.agg(F.lit("missing key").alias("rule"), F.count_if(F.col("date").isNull() | F.col("asset").isNull()).alias("n"))
    values = prices.agg(F.lit("impossible price").alias("rule"), F.count_if(F.isnan("price") | (F.abs("price") == float("inf")) | (F.col("price") < 0)).alias("n"))
    assets = prices.agg(F.lit("fewer than two assets").alias("rule"), F.when(F.count_distinct("asset") < 2, 1).otherwise(0).cast("long").alias("n"))
    return cells.unionByName(keys).unionByName(values).unionByName(assets).filter("n > 0")


def require_valid(prices: DataFrame) -> DataFrame:
    """prices, or ValueError naming what is wrong (at most four rows come to the driver)."""
    bad = violations(prices).collect()
    if bad:
        raise ValueError("; ".join(f"{r.rule}: {r.n}" for r in bad))
    return prices


def until(prices: DataFrame, end: str) -> DataFrame:
    """Only dates up to end: to be called before returns are taken, so nothing later can leak."""
    return prices.filter(F.col("date") <= F.lit(end).cast("date"))
