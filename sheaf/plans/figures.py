"""Numbers, units, colours and chart series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.functions import numbers
from sheaf.plans.registry import query
from sheaf.session import table


@query(
    "roman_letters",
    """SELECT p_partkey, CASE WHEN p_partkey BETWEEN 1 AND 3999 THEN ['','M','MM','MMM'][p_partkey // 1000 % 10 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][p_partkey // 100 % 10 + 1]
|| ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][p_partkey // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][p_partkey % 10 + 1] ELSE p_partkey::VARCHAR END AS roman,
CASE WHEN p_partkey = 0 THEN '0' WHEN p_partkey <= 26 THEN chr((64 + p_partkey)::INTEGER) WHEN p_partkey <= 702 THEN chr((64 + (p_partkey - 1) // 26)::INTEGER) || chr((65 + (p_partkey - 1) % 26)::INTEGER)
ELSE chr((64 + ((p_partkey - 1) // 26 - 1) // 26)::INTEGER) || chr((65 + ((p_partkey - 1) // 26 - 1) % 26)::INTEGER) || chr((65 + (p_partkey - 1) % 26)::INTEGER) END AS letters FROM part""",
)
def roman_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(n, numbers.roman(n).alias("roman"), numbers.letters(n).alias("letters"))


@query("number_formats", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN (CASE WHEN p_size < 10 THEN '0' || p_size ELSE p_size::VARCHAR END) WHEN 1 THEN p_size::VARCHAR ELSE '•' END AS shown FROM part")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "decimalZero").when(F.col("p_size") % 3 == 1, "decimal").otherwise("bullet")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.number_format(F.col("p_size"), kind).alias("shown"))


_STEP_SQL = "(CASE WHEN raw <= 0 THEN 1 WHEN raw / pow(10, floor(log10(raw))) <= 1 THEN 1 WHEN raw / pow(10, floor(log10(raw))) <= 2 THEN 2 WHEN raw / pow(10, floor(log10(raw))) <= 5 THEN 5 ELSE 10 END * CASE WHEN raw <= 0 THEN 1 ELSE pow(10, floor(log10(raw))) END)"


@query(
    "nice_scale",
    f"""SELECT l_returnflag, year, round(floor(a / step) * step, 6)::DOUBLE AS lo, round(greatest(ceil(z / step) * step, floor(a / step) * step + step), 6)::DOUBLE AS hi, round(step, 6)::DOUBLE AS step FROM (
SELECT *, {_STEP_SQL} AS step FROM (SELECT *, (z - a) / 5 AS raw FROM (
SELECT l_returnflag, year(l_shipdate)::INTEGER AS year, min(l_extendedprice) AS a, max(l_extendedprice) AS z FROM lineitem GROUP BY ALL) WHERE a < z))""",
)
def nice_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("z")).filter("a < z")
    scale = spread.select("l_returnflag", "year", numbers.nice_scale(F.col("a"), F.col("z")).alias("s"))
    return scale.select("l_returnflag", "year", *[F.round(f"s.{c}", 6).alias(c) for c in ("lo", "hi", "step")])


@query(
    "axis_ticks",
    f"""SELECT k AS at, round(k * step, 6)::DOUBLE AS tick FROM (SELECT *, {_STEP_SQL} AS step FROM (SELECT max(o_totalprice) AS z, max(o_totalprice) / 5 AS raw FROM orders)),
(SELECT unnest(range(0, 12)) AS k) WHERE k * step <= ceil(z / step) * step + step / 2""",
)
def axis_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the order totals' axis, zero included."""
    top = table(spark, sf_dir, "orders").agg(F.max("o_totalprice").alias("z"))
    ticks = top.select(F.posexplode(numbers.ticks(numbers.nice_scale(F.lit(0.0), F.col("z")))).alias("at", "tick"))
    return ticks.select(F.col("at").cast("long").alias("at"), F.round("tick", 6).alias("tick"))


@query("axis_fraction", "SELECT o_orderkey, round(greatest(0, least(1, (o_totalprice - 100000) / 200000)), 9)::DOUBLE AS f FROM orders")
def axis_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = numbers.axis_fraction(F.col("o_totalprice"), F.lit(100000.0), F.lit(300000.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(f, 9).alias("f"))


@query(
    "unit_convert",
    """SELECT p_partkey, round(p_retailprice * 20)::BIGINT AS twips, greatest(2, least(1638, round(p_retailprice * 2)))::BIGINT AS half_points,
(p_size * 5 // 100) || CASE WHEN p_size * 5 % 100 = 0 THEN '' ELSE '.' || rtrim(lpad((p_size * 5 % 100)::VARCHAR, 2, '0'), '0') END || 'pt' AS measure, p_size || '%' AS percent FROM part""",
)
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    price = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.twips(price).alias("twips"), numbers.half_points(price).alias("half_points"), numbers.twips_measure(size).alias("measure"), numbers.percent_text(size).alias("percent"))


@query(
    "css_lengths",
    """SELECT p_partkey, round(CASE p_size % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size * 0.75 WHEN 2 THEN p_size * (72.0 / 2.54) END, 9)::DOUBLE AS points FROM part""",
)
def css_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("pt", "px", "cm", "em"))), F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.css_points(F.concat(F.col("p_size").cast("string"), unit)), 9).alias("points"))


_HEX_SQL = "lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0')"


@query(
    "css_color",
    f"""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN {_HEX_SQL} WHEN 1 THEN '112233' WHEN 2 THEN '0A0B' || lpad(upper(to_hex(p_size::BIGINT)), 2, '0') WHEN 3 THEN '008000' END AS colour FROM part""",
)
def css_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex6 = F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    kind = F.col("p_size") % 4
    raw = F.when(kind == 0, F.concat(F.lit("#"), hex6)).when(kind == 1, "#123").when(kind == 2, F.format_string("rgb(10, 11, %d)", F.col("p_size"))).otherwise(" green ")
    return table(spark, sf_dir, "part").select("p_partkey", numbers.css_colour(raw).alias("colour"))


_CHANNEL = "('0x' || substr(h, {at}, 2))::INTEGER"
_C = [_CHANNEL.format(at=a) for a in (1, 3, 5)]
_MIX = " || ".join(f"lpad(lower(to_hex((({c} * (1000 - p_size * 20) + {t} * (p_size * 20) + 500) // 1000)::BIGINT)), 2, '0')" for c, t in zip(_C, (255, 128, 0), strict=True))


@query(
    "blend_dark",
    f"SELECT p_partkey, '#' || {_MIX} AS blended, 0.299 * {_C[0]} + 0.587 * {_C[1]} + 0.114 * {_C[2]} < 128 AS dark FROM (SELECT p_partkey, p_size, {_HEX_SQL} AS h FROM part)",
)
def blend_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.lpad(F.lower(F.hex(F.col("p_partkey") * 7919 % 16777216)), 6, "0")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", h.alias("h")).select("p_partkey", numbers.blended(F.col("h"), F.lit("ff8000"), F.col("p_size") * 20).alias("blended"), numbers.is_dark(F.col("h")).alias("dark"))


@query("civil_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def civil_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", numbers.civil_stamp(shown).alias("stamp"))


@query(
    "context_fit",
    """SELECT p_partkey, CASE WHEN fit >= 1024 THEN fit - fit % 1024 WHEN fit > 0 THEN fit ELSE 512 END::BIGINT AS tokens FROM (
SELECT p_partkey, least(floor((p_retailprice * 1000 - 900000 - 1000) / p_size)::BIGINT, 8192) AS fit FROM part WHERE p_size > 0)""",
)
def context_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = numbers.context_fit(F.col("p_retailprice") * 1000, F.lit(900000), F.lit(1000), F.col("p_size"), F.lit(8192))
    return table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", fit.alias("tokens"))


@query("checksums", "SELECT source, count(DISTINCT sha256(text))::BIGINT AS digests FROM documents GROUP BY source")
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_distinct(F.sha2("text", 256)).alias("digests"))


@query(
    "percent_stacked",
    """WITH s AS (SELECT year(l_shipdate)::INTEGER AS year, l_returnflag, sum((l_quantity - 25)::BIGINT)::BIGINT AS v FROM lineitem GROUP BY ALL)
SELECT year, l_returnflag, round(v * 100.0 / nullif(sum(abs(v)) OVER (PARTITION BY year), 0), 6)::DOUBLE AS share,
round(sum(CASE WHEN v > 0 THEN v ELSE 0 END) OVER (PARTITION BY year ORDER BY l_returnflag) * 100.0 / nullif(sum(abs(v)) OVER (PARTITION BY year), 0), 6)::DOUBLE AS positive_to FROM s""",
)
def percent_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), "l_returnflag").agg(F.sum((F.col("l_quantity") - 25).cast("long")).alias("v"))
    whole, upto = Window.partitionBy("year"), Window.partitionBy("year").orderBy("l_returnflag")
    share = lambda x: F.round(F.try_divide(x * 100.0, F.sum(F.abs("v")).over(whole)), 6)
    return s.select("year", "l_returnflag", share(F.col("v")).alias("share"), share(F.sum(F.when(F.col("v") > 0, F.col("v")).otherwise(0)).over(upto)).alias("positive_to"))


@query("chart_points", "SELECT y.year, m.month, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders) y CROSS JOIN (SELECT unnest(range(1, 13))::INTEGER AS month) m LEFT JOIN (SELECT year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, count(*) AS n FROM orders GROUP BY ALL) o ON o.year = y.year AND o.month = m.month")
def chart_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of every year with its number of orders; holes are zero."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    full = orders.select("year").distinct().select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return full.join(orders.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n")), ["year", "month"], "left").fillna(0, ["n"])


@query("price_correlation", "SELECT l_returnflag, CASE WHEN stddev_pop(l_quantity) = 0 AND stddev_pop(l_extendedprice) = 0 THEN 1.0 WHEN stddev_pop(l_quantity) = 0 OR stddev_pop(l_extendedprice) = 0 THEN 0.0 ELSE round(corr(l_quantity, l_extendedprice), 6) END::DOUBLE AS r FROM lineitem GROUP BY 1")
def price_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation; 1 where both sides are flat, 0 where one is."""
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.stddev_pop("l_quantity").alias("a"), F.stddev_pop("l_extendedprice").alias("b"), F.corr("l_quantity", "l_extendedprice").alias("c"))
    r = F.when((F.col("a") == 0) & (F.col("b") == 0), 1.0).when((F.col("a") == 0) | (F.col("b") == 0), 0.0).otherwise(F.round("c", 6))
    return grouped.select("l_returnflag", r.alias("r"))
