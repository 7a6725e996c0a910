"""Schemas and fixed values of the worker-log data model."""

from pyspark.sql import types as T

# Log messages that carry meaning.
ARRIVAL = "Handling invocation request"
START = "Item starting to execute"
COMPLETE = "Invocation complete"
SWITCH = "Switching state"
COLD_START = "Container cold start completed"

# Queue states, the state of a queue nobody has mentioned yet, and the compute label.
QUEUE_STATES = ["Active", "Inactive", "Throttled"]
INITIAL_STATE = "Inactive"
GPU = "GPU"

# Dispatch policies with a model flag.
POLICIES = ["AlwaysGPU", "Greedy", "Landlord", "MICE", "NEW_MICE", "Speedup", "WeightedRandom"]

# Name of a session's log file and of the folder that holds start-up chatter only.
LOG_FILE = "worker1.log"
PRECLEANUP = "precleanup"

# The part of a function name before its first digit is its base function.
BASE_FUNCTION_PATTERN = "^([^0-9]+)"

# Lag offsets (default, and the wider set used for model training).
DEFAULT_LAGS = [1, 3, 5]
TRAINING_LAGS = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20]

# Model inputs without lags, in assembler order.
BASE_FEATURES = [
    "target_queue_len",
    "others_len_queue",
    "is_status_Active",
    "is_status_Inactive",
    "is_status_Throttled",
    "iat",
    "iat_fqdn",
    "num_running_funcs_filled",
    "gpu_warm_results_sec",
    "gpu_cold_results_sec",
    "is_cold_start",
]

# Hyper-parameter grid of the tuned forest, and the settings of the baseline forest.
FOREST_GRID = {
    "numTrees": [50, 100],
    "maxDepth": [10, 15, 20],
    "minInstancesPerNode": [5, 10, 20, 30, 50],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}
BASELINE_TREES = 5
BASELINE_MIN_LEAF = 20
SEED = 42
FOLDS = 3
TEST_SHARE = 0.2

# Fixed values (format keys): one JSON line of a worker log. The key sets of ``fields`` and ``span`` are open, so both are maps
# and no pass over the data is needed to learn them.
RAW_RECORD = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("span", T.MapType(T.StringType(), T.StringType())),
    ]
)

# Fixed values (format keys): known keys of ``fields`` and the types they are read as.
FIELD_TYPES = {
    "message": "string",
    "fqdn": "string",
    "queue": "string",
    "queue_len": "bigint",
    "new_state": "string",
    "num_running_funcs": "bigint",
    "gpu_est_total": "double",
    "e2etime": "double",
    "compute": "string",
}

# Fixed values (format keys): function profile document.
# Samples are read as text: a sample that is no number is part of the rules (see ``profile_means``).
_SAMPLES = T.ArrayType(T.StringType())
PROFILE_DOCUMENT = T.StructType(
    [
        T.StructField(
            "data",
            T.MapType(
                T.StringType(),
                T.StructType(
                    [
                        T.StructField(
                            "resource_data",
                            T.StructType(
                                [
                                    T.StructField(
                                        "gpu",
                                        T.StructType(
                                            [
                                                T.StructField("warm_results_sec", _SAMPLES),
                                                T.StructField("cold_results_sec", _SAMPLES),
                                            ]
                                        ),
                                    )
                                ]
                            ),
                        )
                    ]
                ),
            ),
        )
    ]
)
