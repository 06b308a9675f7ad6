"""Item types that the tests share."""

from telemill import Column, ItemDefinition

ALPHA = ItemDefinition(
    "alpha", (Column("alphaStr", "string"), Column("alphaInt", "int"), Column("alphaDate", "datetime")), "alpha-folder", 1
)
BETA = ItemDefinition(
    "beta", (Column("betaStr", "string"), Column("betaBool", "bool"), Column("betaReal", "real")), "beta-folder", 2
)
GAMMA = ItemDefinition(
    "gamma", (Column("gammaInt", "int"), Column("gammaStr", "string"), Column("gammaDynamic", "dynamic")), "gamma-folder", 3
)
ALL_SCALARS = ItemDefinition(
    "allscalars",
    (
        Column("_string", "string", "value", True),
        Column("_boolean", "bool"),
        Column("_datetime", "datetime", "2000-01-01 00:00:01.100"),
        Column("_dynamic", "dynamic", '{"key": "value"}'),
        Column("_int", "int", 10),
        Column("_real", "real", 55.55),
        Column("_timespan", "timespan", optional=True),
    ),
    "allscalars-folder",
    10,
)
VM_SHUTDOWN = ItemDefinition(
    "vm-shutdown",
    (Column("vmId", "string"), Column("shutdownStart", "datetime"), Column("shutdownReason", "string", "unknown")),
    "administration",
    10,
)
VM_START = ItemDefinition("vm-start", (Column("vmId", "string"), Column("startTime", "datetime")), "administration", 10)
VM_REBOOT = ItemDefinition(
    "vm-reboot",
    (
        Column("vmId", "string"),
        Column("eventTime", "datetime"),
        Column("rebootStart", "datetime"),
        Column("rebootDuration", "timespan", optional=True),
        Column("rebootReason", "string", "unknown"),
        Column("OS", "dynamic", '{"os": "Windows", "version": "11"}'),
    ),
    "administration",
    10,
)
QUERY_TEST = ItemDefinition(
    "querytest", (Column("label", "string"), Column("value", "int"), Column("note", "string", optional=True))
)
ALL = [ALPHA, BETA, GAMMA, ALL_SCALARS, VM_SHUTDOWN, VM_START, VM_REBOOT, QUERY_TEST]
STAMP = "2024-06-01 10:00:00.000"


def bodies(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "batch_id bigint, body string")
