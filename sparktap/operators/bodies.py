"""Body schemas by Arrow batches: of each row, and merged over the rows of a key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktap.functions import wire
from sparktap.session import ship


def infer(rows: DataFrame, body: str = "body", content_type: str | None = None) -> DataFrame:
    """The rows with a column `schema`, as JSON with sorted keys, in place of the body."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def one(bodies: pd.Series, kinds: pd.Series) -> pd.Series:
        found = (wire.body_schema(bytes(b), k or "") if b is not None else None for b, k in zip(bodies, kinds))
        return pd.Series([None if x is None else json.dumps(x, sort_keys=True) for x in found], dtype=object)

    return rows.withColumn("schema", one(F.col(body), F.col(content_type) if content_type else F.lit(""))).drop(body)


def merged_by(rows: DataFrame, key: str, body: str = "body") -> DataFrame:
    """One schema for each key. Each task merges what it reads into one tree a key, so only trees are shuffled."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict = {}
        for batch in batches:
            for k, b in zip(batch[key], batch[body]):
                found = wire.body_schema(bytes(b)) if b is not None else None
                if found and isinstance(found["schema"], dict):
                    trees[k] = wire.merged([trees[k], found["schema"]]) if k in trees else found["schema"]
        if trees:  # columns without rows have no type that Arrow takes for text
            yield pd.DataFrame({key: list(trees), "tree": [json.dumps(t) for t in trees.values()]})

    def whole(batch: pd.DataFrame) -> pd.DataFrame:
        tree = wire.merged([json.loads(t) for t in sorted(batch.tree)])
        return pd.DataFrame({key: [batch[key].iloc[0]], "schema": [json.dumps(tree, sort_keys=True)]})

    trees = rows.select(key, body).mapInPandas(part, f"`{key}` {kind}, tree string").distinct()
    return trees.groupBy(key).applyInPandas(whole, f"`{key}` {kind}, schema string")
