"""Logistic and boosted-tree models on MLlib."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from lendgrain.session import checkpoint_dir


def _assembler(cols):
    return VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep")


def fit_glm(df, cols, target, weight=None):
    glm = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="features", labelCol=target, predictionCol="_glm")
    if weight:
        glm.setWeightCol(weight)
    return Pipeline(stages=[_assembler(cols), glm]).fit(df)


def glm_table(model, cols):
    """(variable, coefficient, std_error, p_value); the intercept is the last row."""
    import pyarrow as pa
    from lendgrain.functions.lookups import small_frame
    m = model.stages[-1]
    s = m.summary
    spark = s.residuals().sparkSession
    names = list(cols) + ["(intercept)"]
    coef = list(m.coefficients.toArray()) + [m.intercept]
    return small_frame(spark, {"variable": (names, pa.string()), "coefficient": ([float(x) for x in coef], pa.float64()),
                               "std_error": ([float(x) for x in s.coefficientStandardErrors], pa.float64()),
                               "p_value": ([float(x) for x in s.pValues], pa.float64())})


def glm_numbers(model, cols):
    """{variable: (coefficient, p-value)}."""
    m = model.stages[-1]
    return dict(zip(cols, zip(m.coefficients.toArray().tolist(), list(m.summary.pValues))))


def acceptable(table, vifs, max_vif=2.0, max_p=0.001):
    """Variables with a coefficient of at least 0, a small p-value and little inflation."""
    return [r["variable"] for r in table.collect() if r["variable"] in vifs and r["coefficient"] >= 0
            and r["p_value"] < max_p and vifs[r["variable"]] < max_vif]


# the two settings used: many stumps to rank variables, slower deeper trees for the first cut
SELECTION = dict(maxDepth=1, maxIter=1500, stepSize=0.1)
FIRST_CUT = dict(maxDepth=2, maxIter=1000, stepSize=0.01, subsamplingRate=0.75)


def fit_gbt(df, cols, target, params=None, weight=None, seed=42, checkpoint_interval=10):
    """Boosted trees. Long boosting runs cut their lineage in the shared folder."""
    checkpoint_dir(df.sparkSession)
    gbt = GBTClassifier(featuresCol="features", labelCol=target, seed=seed, checkpointInterval=checkpoint_interval,
                        **(params or SELECTION))
    if weight:
        gbt.setWeightCol(weight)
    return Pipeline(stages=[_assembler(cols), gbt]).fit(df)


def gbt_importance(model, cols, spark, dictionary=None):
    """(variable, gain, frequency, cover): share of gain, share of splits over all trees, and share of the rows that
    pass the splits. Read off the nodes of the saved model (a few for each tree)."""
    import uuid

    import pyarrow as pa
    from lendgrain.functions.lookups import small_frame
    m = model.stages[-1]
    gain = m.featureImportances.toArray().tolist()
    path = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    m.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").filter("leftChild >= 0")
    met = {r["f"]: r for r in nodes.groupBy(F.col("split.featureIndex").alias("f")).agg(F.count("*").alias("n"), F.sum("rawCount").alias("rows")).collect()}
    share = lambda what: [met[i][what] / sum(r[what] for r in met.values()) if i in met else 0.0 for i in range(len(cols))]
    out = small_frame(spark, {"variable": (list(cols), pa.string()), "gain": (gain, pa.float64()),
                              "frequency": (share("n"), pa.float64()), "cover": (share("rows"), pa.float64())})
    return out.join(dictionary, "variable", "left") if dictionary is not None else out


def score(model, df, name="prob"):
    """Adds the probability of an event."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    else:
        out = out.withColumnRenamed("_glm", name)
    return out.drop("features")


def one_variable_logit(df, col, target):
    """Intercept and slope of a logit on a single (WOE) column; slope 1 and intercept ln(events/non-events)
    are expected of a good transformation."""
    m = fit_glm(df, [col], target).stages[-1]
    return float(m.intercept), float(m.coefficients[0])


def expected_intercept(df, target):
    r = df.agg(F.sum(target).alias("e"), F.count(F.lit(1)).alias("n")).first()
    import math
    return math.log(r["e"] / (r["n"] - r["e"]))
