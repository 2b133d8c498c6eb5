"""Readers, writers and the names of columns."""

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendgrain.session import cut_lineage

ENQUIRY_SCHEMA = ("EnquiryControlNumber int, MemberReference string, EnquiringMemberShortName string, "
                  "DateofEnquiry string, EnquiryPurpose string, EnquiryAmount int")

# the account file of bureau A, in file order
ACCOUNT_SCHEMA = (
    "EnquiryControlNumber int, MemberReference string, Loan_account_Number string, Loan_Status string, "
    "Loan_Type string, Loan_Classification string, Sanction_Amount int, High_Credit_Amount int, "
    "Out_standing_Balance int, EMI int, CREDITLIMIT int, CASH_LIMIT int, actual_paymt_amt int, "
    "Interest_Rates double, tenor int, Income int, monthly_annual_indicator string, "
    "net_gross_indicator string, occupation_code int, COLLATERALType int, COLLATERALVALUE int, "
    "DATE_OPENED string, DATE_CLOSED string, DateReported_trades int, Last_payment_date int, "
    "Pay_Hist_Start_Date string, Pay_Hist_END_Date string, Ownership_Type string, Over_due_amount int, "
    "Tenor_Frequency int, suit_filed_status int, Credit_Facility_Status int, writeoff_amt_tot int, "
    "writeoff_amt_prin int, settlement_amt int, Dpd_string string, PL_Propensity_Score string, "
    "NTC_Score string, TU_Score string, "
    + ", ".join(f"ExclusionCode{i} string" for i in range(1, 8)) + ", "
    + ", ".join(f"ReasonCode{i} int" for i in range(1, 6)) + ", ErrorCode string, Sector string")


def read_csv(spark: SparkSession, path, schema=None, **options) -> DataFrame:
    """CSV with a header. Give a schema: inferring one reads the file twice."""
    reader = spark.read.option("header", True).options(**options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_parquet(spark, path, columns=None):
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_table(spark, name):
    return spark.table(name)


def write_parquet(df, path, mode="overwrite", compression=None, partition_by=None):
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df, path, mode="overwrite"):
    df.write.mode(mode).option("header", True).csv(path)


def stage(df: DataFrame, path=None) -> DataFrame:
    """Cuts the lineage once: written and read back when a path is given, else a reliable checkpoint.
    No repartitioning: the data keeps the partitions it already has."""
    if path is None:
        return cut_lineage(df)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- names -------------------------------------------------------------------------------------
def strip_names(df):
    return df.toDF(*[c.strip() for c in df.columns])


def plain_names(df):
    """Drops blanks and - / : from names."""
    return df.toDF(*[re.sub(r"[ \-/:]", "", c) for c in df.columns])


def prefix_names(df, prefix, keep_prefix="cv_var_", keys=("id",)):
    """Lower case with a prefix; keys and names with `keep_prefix` only become lower case."""
    def rule(c):
        low = c.lower()
        return low if low in keys or c.startswith(keep_prefix) else prefix + low
    return df.toDF(*[rule(c) for c in df.columns])


def rename_cols(df, rule):
    return {"strip": strip_names, "plain": plain_names,
            "lower": lambda d: d.toDF(*[c.lower() for c in d.columns])}[rule](df)


# ---- profile -----------------------------------------------------------------------------------
def profile(df: DataFrame, key) -> DataFrame:
    """Rows and distinct keys in one pass, with the number of columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("long"))


def count_prefixes(df, prefixes):
    return {p: sum(c.startswith(p) for c in df.columns) for p in prefixes}


def numeric_columns(df, exclude=()):
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def to_numeric(df, cols):
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def replace_values(df, old, new, cols):
    return df.replace(old, new, subset=list(cols))
