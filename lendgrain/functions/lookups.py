"""Vocabulary tables as DataFrames: mapped with a broadcast join (each has well under 200 rows)."""

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V


def small_frame(spark: SparkSession, columns) -> DataFrame:
    """A constant table from {name: (values, arrow type)}: part of the plan, with a known size."""
    return spark.createDataFrame(pa.table({n: pa.array(v, t) for n, (v, t) in columns.items()}))


def lookup_frame(spark: SparkSession, products, secured=(), revolving=(), key="code") -> DataFrame:
    """One row per known code: product, secured, revolving."""
    codes = {}
    for product, members in products.items():
        for m in members:
            codes.setdefault(str(m), product)
    for m in list(secured) + list(revolving):
        codes.setdefault(str(m), None)
    sec, rev = {str(x) for x in secured}, {str(x) for x in revolving}
    return small_frame(spark, {key: (list(codes), pa.string()), "product": (list(codes.values()), pa.string()),
                               "secured": ([int(c in sec) for c in codes], pa.int32()),
                               "revolving": ([int(c in rev) for c in codes], pa.int32())})


def vocabulary(spark, name):
    return lookup_frame(spark, *{
        "a_enquiry": (V.ENQUIRY_PRODUCT, V.ENQUIRY_SECURED, ()),
        "a_account": (V.ACCOUNT_PRODUCT, V.ACCOUNT_SECURED, V.ACCOUNT_REVOLVING),
        "a_prep": (V.PREP_PRODUCT, V.PREP_SECURED, ()),
        "b_account": (V.B_PRODUCT, V.B_SECURED, V.B_REVOLVING),
        "c_enquiry": (V.C_ENQUIRY_PRODUCT, V.C_ENQUIRY_SECURED, V.C_ENQUIRY_REVOLVING),
        "c_account": (V.C_PRODUCT, V.C_SECURED, V.C_REVOLVING),
    }[name])


def map_category(df: DataFrame, code_col, table: DataFrame, default="Other") -> DataFrame:
    """Adds `product`; unknown codes become `default`, an unknown flag is 0."""
    t = F.broadcast(table.withColumnRenamed("code", "_code"))
    out = df.join(t, df[code_col].cast("string") == t["_code"], "left").drop("_code")
    return (out.withColumn("product", F.coalesce("product", F.lit(default)))
            .withColumn("secured", F.coalesce("secured", F.lit(0)))
            .withColumn("revolving", F.coalesce("revolving", F.lit(0))))


def map_flags(df: DataFrame, code_col, table: DataFrame) -> DataFrame:
    """map_category plus the complements: unsecured, installment."""
    return (map_category(df, code_col, table)
            .withColumn("unsecured", 1 - F.col("secured"))
            .withColumn("installment", 1 - F.col("revolving")))


def map_prep_product(df, code_col, spark):
    """Coarse product and Secured/Unsecured text of the data preparation; a null type stays null
    in the product but counts as Secured."""
    m = map_category(df, code_col, vocabulary(spark, "a_prep"), default="OTHERS")
    t = F.col(code_col)
    return (m.withColumn("product_type", F.when(t.isNotNull(), F.col("product")))
            .withColumn("secured_type", F.when(t.isNull() | (F.col("secured") == 1), "Secured").otherwise("Unsecured"))
            .drop("product", "secured", "revolving"))
