"""An append-only ledger of states on two axes: when a state is valid, and when it was recorded.

A state is a JSON document, kept as its leaves: a path from the root (keys escaped as in JSON pointers, places in arrays as #0, #1, ...;
an empty object or array is a leaf) and the value as JSON text. A snapshot row has all leaves of a state, a delta row the leaves that
changed: add, replace or remove at any depth. A batch is a folder of its own that is written whole, so writing it again changes
nothing; a stream's batches are written by their numbers. The state as of both axes takes each leaf's last change since the last
snapshot: leaves combine before the shuffle, and no entity's history is brought together.

Defined results: null states are empty objects; rows that change nothing are kept as deltas without changes; a delta at its
snapshot's instant comes after it; equal instants go by seq; a batch without rows leaves an empty folder."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEYS = ("entity", "facet")
CHANGES = "array<struct<op:string,path:string,value:string>>"


def _escaped(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1").replace("#", "~2")


def _plain(token: str) -> str:
    return token.replace("~2", "#").replace("~1", "/").replace("~0", "~")


def leaves_of(document: str | None) -> dict[str, str]:
    out, rest = {}, [("", json.loads(document) if document else {})]
    while rest:
        path, x = rest.pop()
        inner = [(_escaped(k), v) for k, v in x.items()] if isinstance(x, dict) else [(f"#{i}", v) for i, v in enumerate(x)] if isinstance(x, list) else []
        rest += [(f"{path}/{k}", v) for k, v in inner]
        if not inner:
            out[path] = json.dumps(x, ensure_ascii=False, sort_keys=True)
    return out


def document_of(leaves: dict[str, str]) -> str:
    """The document of such leaves; places in arrays close up where some are missing."""
    root: dict = {}
    for path, value in sorted(leaves.items()):
        at, tokens = root, path.split("/")
        for t in tokens[:-1]:
            at = at.setdefault(t, {}) if isinstance(at.get(t), dict) or t not in at else at[t]
        at[tokens[-1]] = ("leaf", value)

    def made(node):
        if isinstance(node, tuple):
            return json.loads(node[1])
        if node and all(k.startswith("#") for k in node):
            return [made(node[k]) for k in sorted(node, key=lambda k: int(k[1:]))]
        return {_plain(k): made(v) for k, v in node.items()}

    return json.dumps(made(root[""]) if "" in root else {}, ensure_ascii=False, sort_keys=True)


def leaves(document: str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([leaves_of(x) for x in s]), "map<string,string>")(F.col(document))


def documents(leaf_map: str) -> Column:
    return F.pandas_udf(lambda s: pd.Series([document_of(dict(x)) for x in s]), "string")(F.col(leaf_map))


def changes(before: Column, after: Column) -> Column:
    """What turns one map of leaves into another: removals from the last path on, then additions and replacements in order of path."""
    gone = F.transform(F.reverse(F.array_sort(F.array_except(F.map_keys(before), F.map_keys(after)))), lambda p: F.struct(F.lit("remove").alias("op"), p.alias("path"), F.lit(None).cast("string").alias("value")))
    new = F.filter(F.array_sort(F.map_keys(after)), lambda p: ~F.try_element_at(before, p).eqNullSafe(F.try_element_at(after, p)))
    op = lambda p: F.when(F.try_element_at(before, p).isNull(), "add").otherwise("replace")
    return F.concat(gone, F.transform(new, lambda p: F.struct(op(p).alias("op"), p.alias("path"), F.try_element_at(after, p).alias("value"))))


def ledger_rows(states: DataFrame, snapshot: Column) -> DataFrame:
    """states (entity, facet, valid_from, recorded_at, seq, state) as rows of the ledger: snapshots where `snapshot` holds and at an
    entity's first state, deltas against the state before elsewhere."""
    own = Window.partitionBy(*KEYS).orderBy("valid_from", "recorded_at", "seq")
    x = states.withColumn("now", leaves("state")).withColumn("before", F.lag("now").over(own))
    whole = F.coalesce(snapshot, F.lit(False)) | F.col("before").isNull()
    kind = F.when(whole, "snapshot").otherwise("delta")
    patch = changes(F.when(whole, F.create_map().cast("map<string,string>")).otherwise(F.col("before")), F.col("now"))
    return x.select(*KEYS, kind.alias("kind"), "valid_from", "recorded_at", "seq", patch.cast(CHANGES).alias("changes"))


def append(rows: DataFrame, path: str, batch: str) -> None:
    """Write a batch of ledger rows; the same batch again replaces itself."""
    rows.select(*KEYS, "kind", "valid_from", "recorded_at", F.col("seq").cast("bigint").alias("seq"), "changes").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def append_stream(stream: DataFrame, path: str, checkpoint: str, name: str = "stream"):
    """A stream of ledger rows: each micro-batch is a batch by its number, so one that is run again after a failure counts once."""
    return stream.writeStream.foreachBatch(lambda rows, n: append(rows, path, f"{name}-{n:012}")).option("checkpointLocation", checkpoint)


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = f"entity string, facet string, kind string, valid_from timestamp, recorded_at timestamp, seq bigint, changes {CHANGES}"
    return spark.read.schema(f"{kind}, batch string").parquet(path)


def as_of(ledger: DataFrame, valid_at: str, recorded_by: str) -> DataFrame:
    """Leaves (entity, facet, path, value) of the states valid at an instant, as far as they were recorded by another."""
    seen = ledger.where((F.col("valid_from") <= F.lit(valid_at).cast("timestamp")) & (F.col("recorded_at") <= F.lit(recorded_by).cast("timestamp")))
    order = F.struct("valid_from", F.col("kind") == "delta", "recorded_at", "seq").alias("order")
    seen = seen.select(*KEYS, "kind", order, "changes")
    since = seen.where("kind = 'snapshot'").groupBy(*KEYS).agg(F.max("order").alias("since"))
    # A snapshot says all: what was changed before it is left out. Deltas without one before them start from nothing.
    live = seen.join(since, list(KEYS), "left").where(F.col("since").isNull() | (F.col("order") >= F.col("since")))
    each = live.select(*KEYS, "order", F.explode("changes").alias("c"))
    last = each.groupBy(*KEYS, F.col("c.path").alias("path")).agg(F.max_by(F.struct("c.op", "c.value"), "order").alias("last"))
    return last.where("last.op <> 'remove'").select(*KEYS, "path", F.col("last.value").alias("value"))


def as_documents(leaf_rows: DataFrame) -> DataFrame:
    """Leaves (entity, facet, path, value) as (entity, facet, state): a state's own leaves come together, as in the document itself."""
    x = leaf_rows.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("leaves"))
    return x.select(*KEYS, documents("leaves").alias("state"))
