"""Raw product listings derived from lineitem and part: names drift, IDs start in mid-1998."""
from __future__ import annotations

from pyspark.sql import functions as F

from .datasets import table

ID_START = "1998-07-01"
RENAME_DAY = "2000-01-01"


def price_text(price, style):
    """A number written the way shelf labels write it; ``style`` picks one of three spellings."""
    english = F.format_number(price, 2)
    local = F.translate(english, ",.", ".,")
    return (F.when(style == 0, F.concat(F.lit("₺"), local)).when(style == 1, F.concat(local, F.lit(" TL")))
            .otherwise(F.replace(english, F.lit(","), F.lit(""))))


def part_names(part):
    """The names of a part, made once per part and not once per row: ``full``, and ``early`` where that differs."""
    size = F.concat(F.col("p_size").cast("string"), F.lit(" Gr"))
    full = F.concat_ws(" ", "p_name", "p_brand", "p_type", size)
    k = F.col("p_partkey") % 10
    early = (F.when(k == 0, F.upper(full)).when(k == 1, F.concat_ws(" ", "p_brand", "p_name", "p_type", size))
             .when(k == 2, F.concat(F.concat_ws(" ", "p_name", "p_brand"), F.lit(" ..."))).when(k == 3, F.replace(full, F.lit(" Gr"), F.lit(" gram")))
             .when(k == 4, F.concat_ws(" ", "p_name", "p_brand", F.concat("p_type", F.lit("X")), size)))
    return part.select("p_partkey", "p_type", "p_retailprice", full.alias("full"), early.alias("early"))


def listings(spark, sf_dir):
    d = F.to_date("l_shipdate")
    full = F.col("full")
    early = F.coalesce("early", "full")
    late = F.when((F.col("l_partkey") % 7 == 0) & (d >= F.lit(RENAME_DAY).cast("date")),
                  F.concat(F.lit("Yeni "), full)).otherwise(full)
    per_kg = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)
    name = F.when(d < F.lit(ID_START).cast("date"), early).otherwise(late)
    pid = F.when(d >= F.lit(ID_START).cast("date"), F.when(
        F.col("l_partkey") % 3 == 0, F.concat(F.col("l_partkey").cast("string"), F.lit(".0"))
    ).otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"))))
    text = price_text(F.col("l_extendedprice"), F.col("l_orderkey") % 3)
    line = (table(spark, sf_dir, "lineitem").where("l_extendedprice > 0").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_linestatus"))
    return line.join(part_names(table(spark, sf_dir, "part")), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("row_a"), F.col("l_linenumber").alias("row_b"), d.alias("date"),
        F.when(per_kg & (F.col("l_quantity") > 48), F.concat(name, F.lit("_1kg"))).otherwise(name).alias("name"),
        F.when(per_kg, F.concat(F.lit("("), text, F.lit(" / Kg)"))).otherwise(text).alias("price_text"),
        pid.alias("product_id"),
        F.when(F.col("l_discount") >= 0.09, price_text(F.col("l_extendedprice") + 10, F.lit(0))).alias("old_price"),
        F.when(F.col("l_linestatus") == "F", F.col("p_type")).alias("category"),
        F.when(F.col("l_quantity") < 5, F.concat(
            F.lit("urun-"), (F.col("l_partkey") + F.col("l_linenumber") % 2).cast("string"), F.lit("-p/"))).alias("url"),
        (F.col("p_retailprice") * (1 + (F.col("l_linenumber") - 4) * 0.05)).alias("list_price"))


_TEXT = """CASE {style} WHEN 0 THEN '₺' || translate(format('{{:,.2f}}', {p}), ',.', '.,')
 WHEN 1 THEN translate(format('{{:,.2f}}', {p}), ',.', '.,') || ' TL' ELSE replace(format('{{:,.2f}}', {p}), ',', '') END"""

LISTINGS = f"""
named AS (SELECT *, CAST(l_shipdate AS DATE) AS date,
   p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size || ' Gr' AS fullname,
   {_TEXT.format(style='l_orderkey % 3', p='l_extendedprice')} AS label,
   l_linenumber = 7 AND l_quantity > 45 AS per_kg
   FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_extendedprice > 0),
eras AS (SELECT *, CASE WHEN date < DATE '{ID_START}' THEN CASE l_partkey % 10
      WHEN 0 THEN upper(fullname) WHEN 1 THEN p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_size || ' Gr'
      WHEN 2 THEN p_name || ' ' || p_brand || ' ...' WHEN 3 THEN replace(fullname, ' Gr', ' gram')
      WHEN 4 THEN p_name || ' ' || p_brand || ' ' || p_type || 'X ' || p_size || ' Gr' ELSE fullname END
   WHEN l_partkey % 7 = 0 AND date >= DATE '{RENAME_DAY}' THEN 'Yeni ' || fullname ELSE fullname END AS shown FROM named),
listings AS (SELECT l_orderkey AS row_a, l_linenumber AS row_b, date,
   CASE WHEN per_kg AND l_quantity > 48 THEN shown || '_1kg' ELSE shown END AS name,
   CASE WHEN per_kg THEN '(' || label || ' / Kg)' ELSE label END AS price_text,
   CASE WHEN date >= DATE '{ID_START}' THEN CASE WHEN l_partkey % 3 = 0 THEN l_partkey || '.0' ELSE ' ' || l_partkey END END AS product_id,
   CASE WHEN l_discount >= 0.09 THEN {_TEXT.format(style='0', p='(l_extendedprice + 10)')} END AS old_price,
   CASE WHEN l_linestatus = 'F' THEN p_type END AS category,
   CASE WHEN l_quantity < 5 THEN 'urun-' || (l_partkey + l_linenumber % 2) || '-p/' END AS url,
   p_retailprice * (1 + (l_linenumber - 4) * 0.05) AS list_price FROM eras),
parsed AS (SELECT row_a, row_b, date, trim(name) AS name, price_text, regexp_replace(trim(product_id), '\\.0$', '') AS product_id,
   old_price, category, url, list_price,
   TRY_CAST(CASE WHEN contains(t, ',') THEN replace(replace(t, '.', ''), ',', '.') ELSE t END AS DOUBLE) AS price,
   contains(price_text, '/') OR regexp_matches(name, '_1kg$') AS is_unit_price,
   ends_with(name, '...') AS is_truncated
   FROM (SELECT *, regexp_replace(split_part(price_text, '/', 1), '[^0-9,.]', '', 'g') AS t FROM listings))"""
