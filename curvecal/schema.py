"""Row types shared by the readers and operators."""

from pyspark.sql import types as T

from curvecal.constants import FEATURES, FLAGGED

CURVE = T.StructType([
    T.StructField("sample_id", T.StringType(), False),
    T.StructField("concentration_ppb", T.DoubleType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("pot", T.ArrayType(T.DoubleType(), False)),
    T.StructField("cur", T.ArrayType(T.DoubleType(), False)),
])

TRACE_POINT = T.StructType([
    T.StructField("source_file", T.StringType()),
    T.StructField("replicate", T.IntegerType()),
    T.StructField("e", T.DoubleType()),
    T.StructField("i", T.DoubleType()),
])


def feature_table(meta=("sample_id", "concentration_ppb", "source_file")):
    """Schema of the feature table; only the meta columns present are carried."""
    kinds = {"concentration_ppb": T.DoubleType()}
    fields = [T.StructField(name, kinds.get(name, T.StringType())) for name in meta]
    fields += [T.StructField(name, T.DoubleType()) for name in FEATURES]
    fields += [T.StructField(f"{name}_valid", T.IntegerType()) for name in FLAGGED]
    return T.StructType(fields)


def reduced_feature_table():
    """Fourteen features without FWHM and without flags."""
    return [name for name in FEATURES if name != "FWHM"]
