"""Schemas of the listing data model."""

from pyspark.sql import types as T

# The 9 listing columns, in file order (header-less CSV input).
LISTING_COLUMNS = [
    "country", "sku_id", "title", "category_lvl_1", "category_lvl_2",
    "category_lvl_3", "short_description", "price", "product_type",
]

LISTING = T.StructType([
    T.StructField("country", T.StringType(), True,
                  {"comment": "marketplace: my / ph / sg"}),
    T.StructField("sku_id", T.StringType(), False, {"comment": "unique listing key"}),
    T.StructField("title", T.StringType(), True),
    T.StructField("category_lvl_1", T.StringType(), True),
    T.StructField("category_lvl_2", T.StringType(), True),
    T.StructField("category_lvl_3", T.StringType(), True),
    T.StructField("short_description", T.StringType(), True, {"comment": "may be HTML"}),
    T.StructField("price", T.DoubleType(), True, {"comment": "local currency"}),
    T.StructField("product_type", T.StringType(), True,
                  {"comment": "local / international / NA"}),
])

CATEGORY_COLUMNS = ["category_lvl_1", "category_lvl_2", "category_lvl_3"]

PREDICTION = T.StructType([
    T.StructField("sku_id", T.StringType(), False),
    T.StructField("pred", T.DoubleType(), True),
])
