"""quillspark: a Spark-native engine for collections of marked-up documents."""

from quillspark.session import ship

__all__ = ["ship"]
