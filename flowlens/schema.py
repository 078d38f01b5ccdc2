"""Declared schemas of the data model."""

from pyspark.sql import types as T

#: The numeric flow features, in the order of the feature vector.
NUMERIC = (
    "IN_BYTES", "OUT_BYTES", "IN_PKTS", "OUT_PKTS",
    "FLOW_DURATION_MILLISECONDS", "DURATION_IN", "DURATION_OUT",
    "SRC_TO_DST_IAT_AVG", "DST_TO_SRC_IAT_AVG", "SRC_TO_DST_IAT_STDDEV", "DST_TO_SRC_IAT_STDDEV",
    "MIN_IP_PKT_LEN", "MAX_IP_PKT_LEN", "RETRANSMITTED_IN_PKTS", "RETRANSMITTED_OUT_PKTS",
    "TCP_WIN_MAX_IN", "TCP_WIN_MAX_OUT", "TCP_FLAGS", "MIN_TTL", "MAX_TTL",
)
DOUBLES = {c for c in NUMERIC if "_IAT_" in c}


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

FLOW = struct(
    flow_ord=L,
    FLOW_START_MILLISECONDS=L,
    FLOW_START_TIME=T.TimestampType(),
    IPV4_SRC_ADDR=S,
    IPV4_DST_ADDR=S,
    PROTOCOL=I,
    L4_DST_PORT=I,
    **{c: D if c in DOUBLES else L for c in NUMERIC},
    Label=I,
    Attack=S,
)
#: State of the scaler: rows, mean and sum of squares about the mean, by chunk of the data.
MOMENTS = struct(feature=S, n=L, mean=D, m2=D, chunk=S)
HISTORY = struct(
    experiment_name=S,
    seed=I,
    run_ts=S,
    run_id=S,
    training=struct(train_loss=T.ArrayType(D), val_loss=T.ArrayType(D), val_aucpr=T.ArrayType(D)),
    early_stopping=struct(best_epoch=I, best_val_aucpr=D, stopped_epoch=I),
)
THRESHOLDS = struct(experiment=S, seed=I, optimal_threshold=D)
