"""Readers and writers of messages, states and reports; schemas are stated, never inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

#: A message row.
MESSAGE = "conv_id BIGINT, turn BIGINT, role STRING, content STRING, name STRING, tool_call_id STRING, reasoning_content STRING, refusal STRING, tool_calls ARRAY<STRUCT<id: STRING, type: STRING, function: STRUCT<name: STRING, arguments: STRING>>>"
#: A user record of the fixture file; those without a field are incomplete though they parse.
USER = "id BIGINT, name STRING, active BOOLEAN, _corrupt_record STRING"


def read_messages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.schema(MESSAGE).format(kind).load(path)


def read_users(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """JSON lines; strict fails on a line that doesn't parse, lenient marks it."""
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return spark.read.schema(USER.replace(", _corrupt_record STRING", "") if strict else USER).json(path, mode=mode).withColumn("incomplete", C("id").isNull() | C("name").isNull() | C("active").isNull())


def rejects(m: DataFrame) -> DataFrame:
    """Messages that aren't valid: other than assistants' without content."""
    return m.where((C("role") != "assistant") & C("content").isNull())


def filled(m: DataFrame) -> DataFrame:
    """Messages with what is missing filled, and whether it was."""
    missing = (C("role") != "assistant") & C("content").isNull()
    return m.select("conv_id", "turn", "role", F.when(missing, "").otherwise(C("content")).alias("content"), missing.alias("was_missing"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share; in local mode, a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file:///tmp/checkpoints/loomline"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def json_round_trip(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "report")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def parquet_round_trip(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A row of the vector index.
VECTOR = "turn_id BIGINT, embedding ARRAY<FLOAT>, metadata MAP<STRING, STRING>"


def index_vectors(rows: DataFrame, path: str) -> None:
    """Appends turn_id, embedding and metadata to the index, which begins where there is none. What is there stays."""
    rows.select("turn_id", "embedding", "metadata").write.mode("append").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTOR).parquet(path)


#: The scenario's kinds of turns.
KINDS = ["add", "refine", "wrap-up"]


def scenario(spark: SparkSession, turns: int = 30) -> DataFrame:
    """Messages of an agentic scenario: in each turn a request, a read, its result, a command, its result."""
    t = spark.range(turns).withColumnRenamed("id", "turn_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.when(C("turn_id") < turns * 2 // 3, 1).when(C("turn_id") < turns - 1, 2).otherwise(3))
    n = C("turn_id").cast("string")
    row = lambda role, name, text: F.struct(F.lit(role).alias("role"), F.lit(name).cast("string").alias("name"), text.alias("content"))
    steps = F.array(row("user", None, F.concat(kind, F.lit(": module_"), n)), row("assistant", "read_file", F.concat(F.lit("reading module_"), n)), row("tool", "read_file", F.concat(F.lit("def f_"), n, F.lit("(): pass"))), row("assistant", "run_command", F.lit("running tests")), row("tool", "run_command", F.concat(n, F.lit(" passed in 1s"))))
    return t.select("turn_id", F.posexplode(steps).alias("i", "s")).select((C("turn_id") * 5 + C("i")).alias("turn"), "turn_id", "s.*")
