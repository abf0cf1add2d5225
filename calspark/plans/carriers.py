"""Views on the driver's tables that have the shape of recordings, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calspark.operators.movie import exploded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, frame, f, fneu, event_type: a trace a user; fneu is the mean of the others on that day (summed in whole hundredths)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.col("value").alias("f"), F.to_date("ts").alias("day"))
    mine = e.groupBy("day", "user_id").agg(F.sum(F.round(F.col("f") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    day = Window.partitionBy("day")
    others = mine.withColumn("fneu", F.coalesce(F.try_divide((F.sum("s").over(day) - F.col("s")).cast("double"), 100.0 * (F.sum("n").over(day) - F.col("n"))), F.lit(0.0))).select("day", "user_id", "fneu")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.join(others, ["day", "user_id"]).select(
        F.col("user_id").alias("roi"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "f", "fneu", "event_type"
    )


TRACES = """
e as (select user_id, event_id, ts, event_type, value f, cast(ts as date) dday from events),
m as (select dday, user_id, cast(sum(cast(round(f * 100) as bigint)) as bigint) s, count(*) n from e group by all),
o as (select dday, user_id, coalesce(cast(sum(s) over (partition by dday) - s as double) / (cast(100 as double) * nullif(sum(n) over (partition by dday) - n, 0)), 0) fneu from m),
traces as (select user_id roi, row_number() over (partition by user_id order by ts, event_id) - 1 frame, f, fneu, event_type from e join o using (dday, user_id)),
c as (select *, f - cast(0.7 as double) * fneu df from traces)"""


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, y, x, lam: a region a supplier, a pixel a part (64 to a row)."""
    l = table(spark, sf_dir, "lineitem")
    x = l.groupBy(F.col("l_suppkey").alias("roi"), F.col("l_partkey").alias("pixel")).agg(F.sum("l_quantity").alias("lam"))
    return x.select("roi", F.expr("cast(pixel div 64 as int)").alias("y"), F.expr("cast(pixel % 64 as int)").alias("x"), "lam")


MASKS = "masks as (select l_suppkey roi, cast(l_partkey // 64 as int) y, cast(l_partkey % 64 as int) x, sum(l_quantity) lam from lineitem group by all)"

#: Side of the field that the boxes lie on, and of the one that frames of 8 x 8 share.
SIDE, SMALL_SIDE = 128, 8


def tile_masks(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """roi, y, x, lam, ord: a box a supplier, 3 to 5 pixels a side, with weights that grow to the lower right."""
    s = table(spark, sf_dir, "supplier")
    cents = F.round(F.col("s_acctbal") * 100).cast("long")
    boxes = s.select(
        F.col("s_suppkey").alias("roi"), F.pmod(cents, F.lit(side - 4)).cast("int").alias("y0"), ((F.col("s_suppkey") * 31 + F.col("s_nationkey") * 7) % (side - 4)).cast("int").alias("x0"),
        (3 + F.col("s_nationkey") % 3).cast("int").alias("h"), (3 + F.expr("s_nationkey div 3") % 3).cast("int").alias("w"),
    )
    y, x = F.explode(F.expr("sequence(y0, y0 + h - 1)")), F.explode(F.expr("sequence(x0, x0 + w - 1)"))
    p = boxes.select("*", y.alias("y")).select("*", x.alias("x"))
    return p.select("roi", "y", "x", (1.0 + 0.5 * (F.col("y") - F.col("y0")) + 0.25 * (F.col("x") - F.col("x0"))).alias("lam"), ((F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")).alias("ord"))


def tiles_sql(side: int) -> str:
    return f"""
boxes as (select s_suppkey roi, cast((cast(round(s_acctbal * 100) as bigint) % {side - 4} + {side - 4}) % {side - 4} as int) y0, cast((s_suppkey * 31 + s_nationkey * 7) % {side - 4} as int) x0, cast(3 + s_nationkey % 3 as int) h, cast(3 + s_nationkey // 3 % 3 as int) w from supplier),
ty as (select *, unnest(range(y0, y0 + h)) y from boxes), tx as (select *, unnest(range(x0, x0 + w)) x from ty),
tiles as (select roi, cast(y as int) y, cast(x as int) x, cast(1 + 0.5 * (y - y0) + 0.25 * (x - x0) as double) lam, cast((y - y0) * w + x - x0 as int) ord from tx)"""


TILES, SMALL_TILES = tiles_sql(SIDE), tiles_sql(SMALL_SIDE)


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane, frame, arr: 8 x 8 frames as arrays of 64 doubles; a vector a frame."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("plane"), F.col("vec_id").alias("frame"), F.transform("embedding", lambda v: v.cast("double")).alias("arr"))


#: Side of the frames of wide_movie.
WIDE = 40


def wide_movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane, frame, arr: frames of 40 x 40, each component as a square of 5 x 5 with a little of the others in it."""
    i = lambda n: F.col("arr")[(n.cast("int"))]
    square = lambda k: F.floor(F.floor(k / WIDE) / 5) * 8 + F.floor((k % WIDE) / 5)
    return movie(spark, sf_dir).withColumn("arr", F.transform(F.sequence(F.lit(0), F.lit(WIDE * WIDE - 1)), lambda k: i(square(k)) + 0.3 * i((k * 13 + F.floor(k / WIDE)) % 64)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plane, frame, y, x, v."""
    return exploded(movie(spark, sf_dir))


PIXELS = """
arr as (select label plane, vec_id frame, unnest(range(64)) i, embedding from embeddings),
pixels as (select plane, frame, cast(i // 8 as int) y, cast(i % 8 as int) x, cast(embedding[i + 1] as double) v from arr)"""


def behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t (days), v: the day's total order price."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.datediff("o_orderdate", F.lit("1992-01-01")).cast("double").alias("t")).agg(F.sum("o_totalprice").alias("v"))


BEHAVIOUR = "behaviour as (select cast(date_diff('day', date '1992-01-01', cast(o_orderdate as date)) as double) t, sum(o_totalprice) v from orders group by 1)"


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """roi, skew, npix_norm, compact, iscell: three features of labelled documents, quality as the class."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    text = F.col("text")
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("roi"), F.ln(F.length(text) + 1.0).alias("skew"),
        ((F.length(text) - F.length(F.translate(text, "!%#*$&|", ""))) / (F.length(text) + 1.0)).alias("npix_norm"),
        ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / (F.length(text) + 1.0)).alias("compact"),
        F.col("quality").alias("iscell"),
    )


TRAIN = """
train as (select doc_id roi, ln(length(text) + 1.0) skew, (length(text) - length(translate(text, '!%#*$&|', ''))) / (length(text) + 1.0) npix_norm,
  (length(text) - length(replace(text, ' ', ''))) / (length(text) + 1.0) compact, quality iscell from documents join labels using (doc_id))"""
