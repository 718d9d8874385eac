"""Python data sources and sinks: entry files, archives, directory listings."""

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats npylog, npzlog and treelist known to a session."""
    from tidelog.runtime import ship
    from tidelog.sources.npz import EntrySource, MemberSource
    from tidelog.sources.tree import TreeSource

    ship(spark)
    for source in (EntrySource, MemberSource, TreeSource):
        spark.dataSource.register(source)
