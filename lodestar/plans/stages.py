"""Stages of a run as written tables that know what they were made from.

A stage is computed when it is not there, or when the content of something it is made from is not what it was then: each stage keeps a key of
its settings and of the contents of its inputs. Contents are compared, not times: a stage that comes out as before leaves those after it alone. A run may
pause before a stage; a later run with the same folder goes on from there, with whatever inputs were changed meanwhile.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.sources.store import Store


class Paused(Exception):
    """The run waits before a stage."""


def fingerprint(df: DataFrame | None) -> str:
    """Equal for tables of equal columns and rows, whatever their order, but for a chance of about 2**-64."""
    if df is None:
        return "none"
    names = sorted(df.columns)
    as_text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]))  # any type, maps included
    n, total, mixed = df.agg(F.count("*"), F.sum(F.xxhash64(as_text).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(as_text, F.lit(1)))).first()
    return hashlib.sha256(json.dumps([[(c, df.schema[c].dataType.simpleString()) for c in names], n, str(total), mixed]).encode()).hexdigest()


@dataclass
class Stages:
    """Stage tables under a store's folder. ``done`` lists what this run computed; ``pause`` names stages to wait before."""

    store: Store
    settings: dict = field(default_factory=dict)
    pause: set[str] = field(default_factory=set)
    done: list[str] = field(default_factory=list)
    contents: dict[str, str] = field(default_factory=dict)

    def source(self, name: str, df: DataFrame | None) -> DataFrame | None:
        """An input of the run (None: not given), known to stages by its name."""
        self.contents[name] = fingerprint(df)
        return df

    def _note(self, name: str) -> dict:
        found = self.store.read(f"{name}__made")
        return {} if found is None else found.first().asDict()

    def run(self, name: str, make: Callable[[], DataFrame], after: Iterable[str] = ()) -> DataFrame:
        """The table of a stage made from the sources and stages named in ``after``."""
        if name in self.pause:
            raise Paused(name)
        spark = self.store.spark
        key = hashlib.sha256(json.dumps([name, self.settings, sorted((a, self.contents.get(a, "absent")) for a in after)], sort_keys=True).encode()).hexdigest()
        note = self._note(name)
        if note.get("key") != key:
            df = make()
            df.write.mode("overwrite").parquet(self.store.path(name))  # readers see a stage only when it is committed
            found = spark.read.schema(df.schema).parquet(self.store.path(name))
            note = {"key": key, "content": fingerprint(found), "schema": df.schema.json()}
            spark.createDataFrame([note], "key string, content string, schema string").coalesce(1).write.mode("overwrite").parquet(self.store.path(f"{name}__made"))
            self.done.append(name)
        from pyspark.sql import types as T

        self.contents[name] = note["content"]
        return spark.read.schema(T.StructType.fromJson(json.loads(note["schema"]))).parquet(self.store.path(name))
