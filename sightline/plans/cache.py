"""The registry kept at hand: cached names and templates with enrolment and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.operators.registry import first_templates
from sightline.sources.sinks import upsert


class RegistryCache:
    """Names and templates of a registry table, cached on the executors until refreshed.

    ``load`` returns the table (item, template_no, value); enrolment writes the upserted table through ``save`` and reads it again.
    """

    def __init__(self, load, save=None):
        self.load, self.save = load, save
        self.templates = load().cache()

    def names(self) -> DataFrame:
        """Distinct items that have a template."""
        return self.templates.filter("value is not null").select("item").distinct()

    def refresh(self) -> None:
        """Read the registry again."""
        self.templates.unpersist()
        self.templates = self.load().cache()

    def enrol(self, new: DataFrame, order: str, limit: int = 6) -> DataFrame:
        """Replace items by the first ``limit`` templates of ``new(item, value, ...)`` in order; the rest stays."""
        fresh = first_templates(new, "item", order, limit).select("item", "template_no", "value")
        stays = self.templates.join(fresh.select("item").distinct(), "item", "left_anti").select("item", "template_no", "value")
        out = stays.unionByName(fresh)
        if self.save:
            self.save(out)
            self.refresh()
        return out

    def enrol_by_key(self, new: DataFrame, version: str) -> DataFrame:
        """Upsert single templates, the last write of an (item, template_no) winning."""
        key = F.struct("item", "template_no").alias("key")
        base = self.templates.select(key, "value")
        merged = upsert(base, new.select(key, "value", version), "key", version)
        return merged.select("key.item", "key.template_no", "value")


def tables(spark: SparkSession) -> list[str]:
    return [t.name for t in spark.catalog.listTables()]


def databases(spark: SparkSession) -> list[str]:
    return [d.name for d in spark.catalog.listDatabases()]


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def truncate(spark: SparkSession, name: str) -> None:
    spark.sql(f"TRUNCATE TABLE {name}")
