"""Layers of stream tables: each reads the tables of earlier layers as streams and stores its own.

A layer is declared by the tables it reads, a transformation and rules; ``run_layers`` starts
one query per layer in the order of what reads what, each with its own checkpoint, and lets each
run until its input is used up. A repeated run continues where every layer stopped. These are
plain functions around Structured Streaming: nothing runs between two calls.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laketide.operators import quality as dq
from laketide.streaming import runners


@dataclass(frozen=True)
class Layer:
    """One stream table.

    ``reads`` names layers or sources; ``build`` gets their streams in this order. Rows that fail
    an error rule go to the table ``<name>_rejected`` with the names of the rules; warnings are
    counted but stay. With ``sink`` the rows go to a micro-batch sink instead of an appended
    table, in ``mode``; such a layer can only be the last of its branch."""

    name: str
    reads: Sequence[str]
    build: Callable[..., DataFrame]
    rules: Sequence[dq.Rule] = field(default=())
    sink: Callable[[DataFrame, int], None] | None = None
    mode: str = "append"
    partition_by: Sequence[str] = field(default=())


def order_of(layers: Sequence[Layer], sources: Sequence[str]) -> list[Layer]:
    """Layers so that each comes after those it reads; unknown names and circles are refused."""
    known = {x.name: x for x in layers}
    if len(known) != len(layers) or set(known) & set(sources):
        raise ValueError("a name stands for two tables")
    for layer in layers:
        for name in layer.reads:
            if name not in known and name not in sources:
                raise ValueError(f"{layer.name} reads {name}, which nothing writes")
            if name in known and known[name].sink is not None:
                raise ValueError(f"{layer.name} reads {name}, whose sink is not a stream table")
    try:
        order = list(TopologicalSorter({x.name: [n for n in x.reads if n in known] for x in layers}).static_order())
    except CycleError as circle:
        raise ValueError(f"layers read each other: {circle.args[1]}") from circle
    return [known[n] for n in order]


class StreamLayers:
    """Declared layers below one folder."""

    def __init__(self, spark: SparkSession, root: str, sources: Mapping[str, Callable[[SparkSession], DataFrame]], layers: Sequence[Layer]):
        self.spark, self.root, self.sources = spark, root.rstrip("/"), dict(sources)
        self.layers = order_of(layers, list(sources))
        self.schemas: dict[str, T.StructType] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/tables/{name}"

    def _stream(self, name: str) -> DataFrame:
        if name in self.sources:
            return self.sources[name](self.spark)
        return self.spark.readStream.schema(self.schemas[name]).parquet(self.path(name))

    def _start(self, layer: Layer) -> list:
        rows = layer.build(*[self._stream(n) for n in layer.reads])
        checkpoint = f"{self.root}/checkpoints/{layer.name}"
        queries = []
        if layer.rules:
            marked = dq.annotate(rows, layer.rules, "_failed_rules")
            good, bad = dq.split(marked, layer.rules)
            rows = good.drop("_failed_rules")
            # a table of its own: the input is read twice, and both tables stay plain stream tables
            queries.append(runners.append_to(bad, self.path(f"{layer.name}_rejected"), f"{checkpoint}_rejected"))
            self.schemas[f"{layer.name}_rejected"] = bad.schema
        if layer.sink is None:
            self.schemas[layer.name] = rows.schema
            queries.append(runners.append_to(rows, self.path(layer.name), checkpoint, layer.partition_by))
        else:
            queries.append(runners.run_batches(rows, layer.sink, checkpoint, mode=layer.mode))
        return queries

    def run(self) -> dict[str, int]:
        """Bring all layers up to date; returns the rows each query read in this run. A layer starts
        when those it reads have ended, so one run carries new rows to the last layer. The first
        failure is raised, and later layers are not started."""
        read = {}
        for layer in self.layers:
            queries = self._start(layer)
            runners.await_all(queries)
            read[layer.name] = sum(p["numInputRows"] for p in queries[-1].recentProgress)
        return read

    def table(self, name: str) -> DataFrame:
        """The stored rows of a layer that is an appended table."""
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name))

    def counts(self) -> DataFrame:
        """Rows of every appended table."""
        out = None
        for name in self.schemas:
            one = self.table(name).agg(F.count("*").alias("rows")).select(F.lit(name).alias("layer"), "rows")
            out = one if out is None else out.unionByName(one)
        return out
