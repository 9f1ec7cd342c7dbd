"""Sessions: what an analysis found, as Parquet tables under one folder each."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UnknownSession(KeyError):
    pass


class SessionStore:
    """``put`` writes the tables and, last, a marker with the small values; a session without marker does not exist."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, session: str, name: str) -> str:
        return f"{self.folder}/session={session}/{name}"

    def put(self, tables: Mapping[str, DataFrame], values: Mapping, session: str | None = None) -> str:
        key = session or str(uuid.uuid4())
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._at(key, name))
        meta = json.dumps({"tables": [*tables], **values}, ensure_ascii=False)
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(self._at(key, "meta"))
        return key

    def values(self, session: str) -> dict:
        if not self._exists(session):
            raise UnknownSession(session)
        return json.loads(self.spark.read.text(self._at(session, "meta")).first()["value"])

    def _exists(self, session: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._at(session, "meta/_SUCCESS"))
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path)

    def get(self, session: str, name: str) -> DataFrame:
        if name not in self.values(session)["tables"]:
            raise UnknownSession(f"{session}/{name}")
        return self.spark.read.parquet(self._at(session, name))

    def drop(self, session: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/session={session}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of each key loaded last: re-sent rows count once."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(at)).alias("__row")).select(*keys, "__row.*")
