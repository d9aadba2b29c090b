"""Custom chunkers as table functions: ``SELECT * FROM name(TABLE(documents) PARTITION BY doc_id)``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class Chunker:
    """Base of custom chunkers: ``split`` gives a text's chunks in order."""

    def split(self, text: str) -> Iterable[str]:
        raise NotImplementedError


def register_chunker(spark: SparkSession, name: str, kind: type[Chunker], key_type: str = "bigint") -> None:
    """Makes ``kind`` callable from SQL. The table argument's rows are (key, text, ...); the result is (doc_id, num, content),
    without blank chunks. One chunker serves all rows of a partition; a null text has none."""

    class Handler:
        def __init__(self) -> None:
            self.chunker = kind()

        def eval(self, row: Row):
            num = 0
            for piece in self.chunker.split(row[1]) if row[1] else ():
                if piece.strip():
                    num += 1
                    yield row[0], num, piece

    spark.udtf.register(name, F.udtf(Handler, returnType=f"doc_id {key_type}, num int, content string"))


def chunk_table(spark: SparkSession, name: str, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The registered chunker over a DataFrame, partitioned by document."""
    view = f"_chunker_{name}"
    docs.select(key, text).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM {name}(TABLE({view}) PARTITION BY {key})")
