from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession, types as T

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from stallkeeper.plans.session import tune  # noqa: E402
from stallkeeper.sources.ingest import SCHEMAS  # noqa: E402
from stallkeeper.sources.model import Commerce  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return tune(session)


def ts(text: str | None):
    return datetime.fromisoformat(text) if text else None


TABLES = {"customers": "customers", "geolocation": "geolocation", "products": "products", "sellers": "sellers",
          "translation": "product_category_name_translation", "orders": "orders", "items": "order_items",
          "payments": "order_payments", "reviews": "order_reviews"}


def _value(field: T.StructField, v):
    from decimal import Decimal
    if isinstance(field.dataType, T.DecimalType) and v is not None:
        return Decimal(str(v))
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(v, str):
        return ts(v)
    return v


@pytest.fixture(scope="session")
def commerce(spark):
    """Build a model from rows given per table as dicts; missing columns are NULL."""
    def build(**tables) -> Commerce:
        frames = {}
        for name, source in TABLES.items():
            schema = SCHEMAS[source]
            rows = [tuple(_value(f, r.get(f.name)) for f in schema.fields) for r in tables.get(name, [])]
            frames[name] = spark.createDataFrame(rows, schema)
        return Commerce(spark, **frames)
    return build
