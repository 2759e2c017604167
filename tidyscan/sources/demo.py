"""A generated retail table for trying things out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the generated table.
CATEGORIES = [
    "Electronics", "Home", "Beauty", "Grocery", "Sports", "Toys", "Books", "Fashion", "Automotive", "Office",
    "Pets", "Outdoors",
]
CHANNELS = ["web", "app", "store", "email", "affiliate", "social"]
REGIONS = ["North", "South", "East", "West"]
SKUS = 300
CAMPAIGNS = 80
DAYS = 730
DUPLICATES_FROM = 500
DUPLICATE_SHARE = 0.01


def demo_data(spark: SparkSession, n_rows: int = 2000, seed: int = 42) -> DataFrame:
    """Orders with skewed prices, promotions, missing discounts and, from 500 rows on, 1 % copies.

    Every value is a function of the order number and the seed, so a lost task repeats its rows.
    """

    def uniform(tag: int) -> Column:
        return (F.pmod(F.xxhash64("order_id", F.lit(seed), F.lit(tag)), F.lit(2**53)) + 0.5) / float(2**53)

    def whole(tag: int, count: int) -> Column:
        return F.floor(uniform(tag) * count).cast("bigint")

    def normal(tag: int, mean: float, deviation: float) -> Column:
        radius = F.sqrt(-2.0 * F.log(uniform(tag)))
        return mean + deviation * radius * F.cos(2.0 * F.pi() * uniform(tag + 1000))

    def pick(tag: int, words: list[str]) -> Column:
        return F.element_at(F.lit(words), (whole(tag, len(words)) + 1).cast("int"))

    device = F.when(F.col("u") < 0.55, "desktop").when(F.col("u") < 0.93, "mobile").otherwise("tablet")
    df = spark.range(1, n_rows + 1).withColumnRenamed("id", "order_id").withColumn("u", uniform(1))
    df = df.select(
        "order_id",
        (whole(2, n_rows // 2 + 1) + 1).alias("customer_id"),
        F.format_string("SKU-%04d", whole(3, SKUS) + 1).alias("sku"),
        pick(4, CATEGORIES).alias("category"),
        pick(5, CHANNELS).alias("channel"),
        pick(6, REGIONS).alias("region"),
        device.alias("device"),
        F.format_string("cmp_%03d", whole(7, CAMPAIGNS) + 1).alias("utm_campaign"),
        (F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=whole(8, DAYS * 86400))).alias("order_ts"),
        (whole(9, 5) + 1).alias("quantity"),
        F.round(F.exp(normal(10, 3.5, 0.6)), 2).alias("base_price"),
        (uniform(11) < 0.35).cast("bigint").alias("promo_used"),
        F.greatest(F.least(normal(12, 0.22, 0.12), F.lit(0.6)), F.lit(0.0)).alias("discount"),
        F.round(F.greatest(normal(13, 6.0, 3.0), F.lit(0.0)), 2).alias("shipping_fee"),
        F.when(uniform(14) < 0.2, "great fast").otherwise("ok").alias("user_note"),
        uniform(15).alias("draw"),
        normal(16, 180.0, 40.0).alias("spend"),
    )
    promo, mobile = F.col("promo_used"), (F.col("device") == "mobile").cast("int")
    price = F.when(promo == 1, F.col("base_price") * (1 - F.col("discount"))).otherwise(F.col("base_price"))
    chance = 1 / (1 + F.exp(-(-1.5 + 0.6 * mobile + 0.4 * promo - 0.002 * F.col("base_price"))))
    df = df.withColumns(
        {
            "event_time_str": F.date_format("order_ts", "yyyy-MM-dd HH:mm:ss"),
            "discount_rate": F.when(promo == 1, F.col("discount")),
            "amount": F.round(price * F.col("quantity") + F.col("shipping_fee"), 2),
            "promo_price": F.round(price, 2),
            "repeat_purchase_30d": (F.col("draw") < chance).cast("bigint"),
            "spend_next_30d": F.round(F.greatest(chance * F.col("spend") + 15 * mobile, F.lit(0.0)), 2),
        }
    )
    df = df.withColumn("tax_amount", F.round(F.col("amount") * 0.07, 2))
    df = df.withColumn("amount_plus_tax", F.round(F.col("amount") + F.col("tax_amount"), 2))
    df = df.select(
        "order_id", "customer_id", "sku", "category", "channel", "region", "device", "utm_campaign", "order_ts",
        "event_time_str", "quantity", "base_price", "promo_used", "discount_rate", "promo_price", "shipping_fee",
        "amount", "tax_amount", "amount_plus_tax", "user_note", "repeat_purchase_30d", "spend_next_30d",
    )
    copies = int(n_rows * DUPLICATE_SHARE)
    if n_rows < DUPLICATES_FROM or not copies:
        return df
    # an even stride picks exactly that many distinct orders without gathering them
    stride = n_rows // copies
    again = df.filter((F.col("order_id") % stride == 0) & (F.col("order_id") <= stride * copies))
    return df.unionByName(again)
