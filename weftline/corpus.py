"""Corpora and datasets: tables with roles (id, text, split, timestamp), metadata beside them, unions with provenance."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins, relational


@dataclass(frozen=True)
class Roles:
    """Which column plays which part."""

    id: str = "id"
    text: str = "text"
    timestamp: str | None = None
    split: str = "split"

    def renamed(self, df: DataFrame, **to: str) -> DataFrame:
        """Columns of roles under other names, for a model that expects them."""
        return df.withColumnsRenamed({getattr(self, r): n for r, n in to.items()})


@dataclass(frozen=True)
class Corpus:
    """A named table of texts with metadata that joins it by id."""

    name: str
    data: DataFrame
    roles: Roles = field(default_factory=Roles)
    metadata: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, name: str, path: str, roles: Roles = Roles(), metadata: str | None = None) -> Corpus:
        return cls(name, spark.read.parquet(path), roles, spark.read.parquet(metadata) if metadata else None)

    def merged(self, columns: Sequence[str] | None = None) -> Corpus:
        """Metadata joined on the id."""
        if self.metadata is None:
            return self
        return replace(self, data=joins.merge_metadata(self.data, self.metadata, self.roles.id, columns), metadata=None)

    def timestamped(self, column: str, format: str) -> Corpus:
        """A timestamp out of a text column of the data, or else of the metadata."""
        c = self if column in self.data.columns else self.merged([column])
        data = relational.to_datetime(c.data.withColumn("timestamp", F.col(column)), {"timestamp": format})
        return replace(c, data=data, roles=replace(self.roles, timestamp="timestamp"))

    def texts(self, columns: Sequence[str], separator: str = "\n\n") -> Corpus:
        """Several columns joined into the text."""
        return replace(self, data=relational.combine_columns(self.data, columns, self.roles.text, separator))

    def splits(self) -> list[str]:
        return sorted(r[0] for r in self.data.select(self.roles.split).distinct().collect()) if self.roles.split in self.data.columns else []

    def __getitem__(self, split: str) -> DataFrame:
        return self.data.where(F.col(self.roles.split) == split)

    def stats(self) -> DataFrame:
        by = self.roles.split if self.roles.split in self.data.columns else None
        return relational.summary_stats(self.data, self.roles.text, by=by)

    def save(self, path: str) -> None:
        """A folder for each split and a table of statistics beside them."""
        w = self.data.write.mode("overwrite")
        (w.partitionBy(self.roles.split) if self.roles.split in self.data.columns else w).parquet(f"{path}/data")
        self.stats().write.mode("overwrite").json(f"{path}/info-{self.name}")

    def describe(self) -> str:
        return json.dumps({"name": self.name, "columns": self.data.columns, "roles": vars(self.roles)})


def concatenated(corpora: Sequence[Corpus], key: str = "corpus") -> Corpus:
    """Corpora in one table; `key` names each row's corpus, columns that one lacks are null there."""
    frames = [c.data.withColumn(key, F.lit(c.name)) for c in corpora]
    return Corpus("+".join(c.name for c in corpora), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), corpora[0].roles)


def common(corpora: Sequence[Corpus], key: str = "dataset") -> DataFrame:
    """Datasets on the columns that all have, with provenance."""
    frames = [c.data.withColumn(key, F.lit(c.name)) for c in corpora]
    return relational.union_common(frames[0], frames[1:])
