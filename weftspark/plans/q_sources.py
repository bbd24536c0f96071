"""Queries of sources, sinks and streams: tables go out in a format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftspark.plans.registry import Catalog
from weftspark.session import scratch_path, table
from weftspark.sources import readers
from weftspark.streaming import rolling

CATALOG = Catalog()
query = CATALOG.query


def _lines(df, path):
    df.write.text(path)
    return path


@query("select n_nationkey, n_name, n_regionkey from nation")
def source_csv_dir(spark, sf_dir):
    """Types inferred from a folder of CSV tables."""
    folder = scratch_path(spark, "csv")
    readers.write_csv(table(spark, sf_dir, "nation"), f"{folder}/nation.csv", single=True)
    return readers.read_csv_dir(spark, folder, ["nation"])["nation"]


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def sink_csv_parts(spark, sf_dir):
    """A sink of many part files, read with the table's own schema."""
    customer = table(spark, sf_dir, "customer")
    folder = scratch_path(spark, "csv")
    readers.write_csv(customer.repartition(5), f"{folder}/customer.csv")
    return readers.read_csv_dir(spark, folder, ["customer"], {"customer": customer.schema})["customer"]


@query("select s_suppkey, s_name, s_nationkey, s_acctbal, cast(null as varchar) as s_comment from supplier")
def source_tbl(spark, sf_dir):
    """Lines with a closing pipe that lack a column of the schema."""
    supplier = table(spark, sf_dir, "supplier")
    line = F.concat(F.concat_ws("|", *[F.col(c).cast("string") for c in supplier.columns]), F.lit("|"))
    path = _lines(supplier.select(line), scratch_path(spark, "tbl"))
    return readers.read_tbl(spark, path, supplier.withColumn("s_comment", F.lit(None).cast("string")).schema)


@query("select p_partkey, case when p_size % 7 = 0 then null else p_name end as p_name, p_size from part")
def source_tsv(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("p_partkey", "case when p_size % 7 = 0 then null else p_name end as p_name", "p_size")
    line = F.concat_ws("\t", "p_partkey", F.coalesce("p_name", F.lit("\\N")), "p_size")
    head = spark.range(1).select(F.lit("p_partkey\tp_name\tp_size"))
    # One file, so that its first line is the header.
    path = _lines(head.union(part.select(line)).coalesce(1), scratch_path(spark, "tsv"))
    return readers.read_tsv(spark, path, part.schema)


@query("""select o_orderkey, case when o_orderkey % 5 = 0 then null else 'it''s, (' || o_orderstatus || ')' end as note, o_totalprice from orders""")
def source_insert_dump(spark, sf_dir):
    """INSERT statements of a dump, with quotes, commas and parentheses inside texts."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", """case when o_orderkey % 5 = 0 then null else concat('it\\'s, (', o_orderstatus, ')') end as note""", "o_totalprice"
    )
    note = F.coalesce(F.concat(F.lit("'"), F.replace("note", F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    value = F.concat(F.lit("("), F.concat_ws(",", F.col("o_orderkey").cast("string"), note, F.col("o_totalprice").cast("string")), F.lit(")"))
    line = F.concat(F.lit("INSERT INTO `orders_x` VALUES "), value, F.lit(";"))
    path = _lines(orders.select(line), scratch_path(spark, "dump"))
    return readers.read_insert_dump(spark, path, "orders_x", orders.schema)


@query("""select r_name as name, cast(r_regionkey as varchar) as code, null::varchar as region, 'regions' as origin from region
          union all select n_name, cast(n_nationkey as varchar), cast(n_regionkey as varchar), 'nations' from nation""")
def source_union_files(spark, sf_dir):
    """Files with unlike columns in one table, each row with its file's name."""
    folder = scratch_path(spark, "union")
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("code"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("code"), F.col("n_regionkey").alias("region"))
    for name, df in (("regions", regions), ("nations", nations)):
        readers.write_csv(df, f"{folder}/{name}.csv", single=True)
    both = readers.union_files(spark, [f"{folder}/regions.csv", f"{folder}/nations.csv"])
    return both.select("name", "code", "region", F.col("indicator_code").alias("origin"))


@query("select o_orderkey, case when o_orderstatus = 'F' then null else o_orderstatus end as status, nullif(case when o_orderkey % 3 = 0 then '' else o_orderpriority end, '') as priority from orders")
def source_missing_markers(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderstatus = 'F' then '?' else o_orderstatus end as status", "case when o_orderkey % 3 = 0 then ' ' else o_orderpriority end as priority"
    )
    return readers.missing_as_null(orders)


@query("select p_brand, count(*) as n, case when max(p_size) > 40 then null else max(p_size)::double end as top from part group by 1")
def sink_statistics(spark, sf_dir):
    """JSON lines in which infinities are null."""
    stats = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").cast("double").alias("top"))
    stats = stats.withColumn("top", F.when(F.col("top") > 40, float("inf")).otherwise(F.col("top")))
    path = scratch_path(spark, "statistics")
    readers.write_statistics(stats, path)
    return spark.read.schema(stats.schema).json(path)


def _stream(spark, sf_dir, make, mode):
    """The rows that a stream over the events' files writes until it has read them all."""
    path = f"{sf_dir}/events.parquet"
    folder = path if spark.read.parquet(path).inputFiles()[0].rstrip("/").endswith("/events.parquet") is False else sf_dir
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet")
    source = source.option("pathGlobFilter", "events.parquet") if folder == sf_dir else source
    out = scratch_path(spark, "stream")
    run = make(source.parquet(folder)).writeStream.outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").start().awaitTermination()
        return spark.read.parquet(out)
    run.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{out}-state").start().awaitTermination()
    return spark.read.parquet(out)


@query("""select strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total, round(max(value), 4) as top
          from events group by 1, 2""")
def stream_tumbling(spark, sf_dir):
    """Tumbling event-time windows over the events as a stream, with a watermark."""
    made = {"n": ("count", "event_id"), "total": ("sum", "value"), "top": ("max", "value")}
    rows = _stream(spark, sf_dir, lambda s: rolling.windowed(s, "ts", ["event_type"], made, "1 day"), "complete")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"), F.round("top", 4).alias("top"))


@query("""with w as (select unnest([time_bucket(interval '6 hours', ts), time_bucket(interval '6 hours', ts) - interval '6 hours']) as start, value from events)
          select strftime(start, '%Y-%m-%d %H') as start, count(*) as n, round(avg(value), 6) as mean from w group by 1""")
def stream_sliding(spark, sf_dir):
    """Windows of twelve hours, one every six."""
    rows = _stream(spark, sf_dir, lambda s: rolling.windowed(s, "ts", [], {"n": ("count", "value"), "mean": ("mean", "value")}, "12 hours", "6 hours"), "complete")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("start"), "n", F.round("mean", 6).alias("mean"))


def _arrivals(spark, sf_dir, make):
    """What a stream in append mode writes over the events, which arrive decade by decade of the month,
    each twice; at last the first decade's arrive once more, when the watermark has long passed them.
    """
    folder, out = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    decade = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    for part in (0, 1, 2, 0):
        rows = events.where(decade == part)
        rows.union(rows).write.mode("append").parquet(folder)
        stream = make(spark.readStream.schema(events.schema).parquet(folder))
        run = stream.writeStream.outputMode("append").trigger(availableNow=True).format("parquet")
        run.option("path", out).option("checkpointLocation", f"{out}-state").start().awaitTermination()
    return spark.read.parquet(out)


@query("""with g as (select user_id, ts, case when ts - lag(ts) over w < interval '2 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
  s as (select *, sum(new) over (partition by user_id order by ts) as s from g)
  select user_id, min(ts) as session_start, max(ts) + interval '2 hours' as session_end, 2 * count(*) as n from s group by user_id, s
  having max(ts) + interval '2 hours' <= (select max(ts) from events) - interval '10 minutes'""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed; rows that come after it change none."""
    rows = _arrivals(spark, sf_dir, lambda s: rolling.sessions(s, "ts", ["user_id"], "2 hours"))
    return rows.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("select event_id, user_id, value from events")
def stream_first_seen(spark, sf_dir):
    """Each event once, though all come twice and some once more too late."""
    return _arrivals(spark, sf_dir, lambda s: rolling.first_seen(s, "ts", ["event_id"])).select("event_id", "user_id", "value")


@query("select time_bucket(interval '1 day', ts) as day, 2 * count(*) as n from events group by 1 having time_bucket(interval '1 day', ts) + interval '1 day' <= (select max(ts) from events) - interval '10 minutes'")
def stream_closed_days(spark, sf_dir):
    """Days that the watermark has closed, each written once."""
    rows = _arrivals(spark, sf_dir, lambda s: rolling.windowed(s, "ts", [], {"n": ("count", "event_id")}, "1 day"))
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "n")
