"""The visibility rule that every read passes, and the ownership rule of writes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TENANT, VISIBILITY = "_tenant_id", "_visibility"


@dataclass(frozen=True)
class Policy:
    """A session of a tenant. A session that has not signed in sees public rows only."""

    tenant: str
    allowed: tuple[str, ...] = ("public", "private")

    def visible(self, within: str = "") -> Column:
        """Allowed visibility, and either public or the tenant's own; the ``in`` list reaches the Parquet scan.

        ``within``: the struct column that holds both fields.
        """
        visibility, tenant = (F.col(f"{within}.{c}" if within else c) for c in (VISIBILITY, TENANT))
        return visibility.isin(*self.allowed) & ((visibility == "public") | (tenant == self.tenant))

    def owned(self) -> Column:
        return F.col(TENANT) == self.tenant

    def read(self, df: DataFrame) -> DataFrame:
        return df.where(self.visible())

    def recheck(self, hits: DataFrame, key: str) -> DataFrame:
        """The safety net after ranking: the same rule again, on the keys of the hits, which can only remove some."""
        fields = hits.schema[key].dataType
        return hits.where(self.visible(key)) if isinstance(fields, T.StructType) and VISIBILITY in fields.names else hits


ANONYMOUS = Policy("", ("public",))
