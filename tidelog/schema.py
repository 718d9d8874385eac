"""Row types of the engine. Unsigned 64-bit numbers are DECIMAL(20, 0), unsigned bytes INT."""

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)

#: A log entry: the key is (source_id, acquisition_time); time 0 marks the onset entry of a source.
PACKAGE = T.StructType([T.StructField("source_id", T.IntegerType()), T.StructField("acquisition_time", U64), T.StructField("serialized_data", T.BinaryType())])
#: An entry as stored: its file stem or archive member, and the header with the payload.
WIRE = T.StructType([T.StructField("source_id", T.IntegerType()), T.StructField("acquisition_time", U64), T.StructField("entry_key", T.StringType()), T.StructField("data", T.BinaryType())])
#: A decoded message with its absolute time in microseconds.
MESSAGE = T.StructType([T.StructField("source_id", T.IntegerType()), T.StructField("timestamp_us", U64), T.StructField("payload", T.BinaryType())])
#: A job of a registry; ord keeps the order of registration.
JOB = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("job_id", T.StringType()),
        T.StructField("job_name", T.StringType()),
        T.StructField("specifier", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("executor_id", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.LongType()),
        T.StructField("completed_at", T.LongType()),
    ]
)
#: An entry of a directory tree.
TREE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("is_link", T.BooleanType()),
        T.StructField("length", T.LongType()),
    ]
)
