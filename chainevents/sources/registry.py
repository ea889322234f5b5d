"""Event ABI tables: parsing, signatures, resolution order and wanted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainevents.functions.abi import canonical_types, compiled_layout, keccak_text, layout_error
from chainevents.functions.expressions import json_string

_INPUT = "struct<name:string,type:string,indexed:boolean,components:string>"
_ENTRIES = f"array<struct<type:string,name:string,inputs:array<{_INPUT}>>>"


def is_abi_text(text: Column | str) -> Column:
    """True when the text is a JSON array."""
    return F.json_array_length(text).isNotNull()


def event_entries(text: Column | str) -> Column:
    """Event definitions of an ABI text, in order; NULL when it is not a JSON array.

    Nameless events are dropped, and so is any input without name, type or indexed.
    """
    whole = lambda i: i["name"].isNotNull() & i["type"].isNotNull() & i["indexed"].isNotNull()
    events = F.filter(F.from_json(text, _ENTRIES), lambda e: (e["type"] == "event") & e["name"].isNotNull())
    cleaned = F.transform(
        events,
        lambda e: F.struct(
            e["name"].alias("name"),
            F.filter(F.coalesce(e["inputs"], F.expr(f"array() :: array<{_INPUT}>")), whole).alias("inputs"),
        ),
    )
    return F.when(is_abi_text(text), cleaned)


def abi_events(contracts: DataFrame) -> DataFrame:
    """One row per event: ``contracts`` columns, ``position``, ``event_name`` and ``inputs``."""
    keep = [c for c in contracts.columns if c != "abi_json"]
    parsed = contracts.select(*keep, F.posexplode(event_entries("abi_json")).alias("position", "event"))
    return parsed.select(*keep, "position", F.col("event.name").alias("event_name"), F.col("event.inputs").alias("inputs"))


def normalized_abi(text: Column | str) -> Column:
    """The event entries alone, written back as ABI text."""
    entries = F.transform(
        event_entries(text),
        lambda e: F.concat(
            F.lit('{"type":"event","name":'),
            json_string(e["name"]),
            F.lit(',"inputs":['),
            F.array_join(
                F.transform(
                    e["inputs"],
                    lambda i: F.concat(
                        F.lit('{"name":'), json_string(i["name"]),
                        F.lit(',"type":'), json_string(i["type"]),
                        F.lit(',"indexed":'), i["indexed"].cast("string"),
                        F.lit(',"components":'), F.coalesce(i["components"], F.lit("[]")),
                        F.lit("}"),
                    ),
                ),
                ",",
            ),
            F.lit("]}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))


def flat_signature(name: Column | str, inputs: Column | str) -> Column:
    """Signature of an event without tuples, without leaving the JVM."""
    types = F.array_join(F.transform(inputs, lambda i: i["type"]), ",")
    return F.concat(F.col(name) if isinstance(name, str) else name, F.lit("("), types, F.lit(")"))


def with_signatures(events: DataFrame) -> DataFrame:
    """Add ``signature``, ``topic0`` and what decoding needs to event rows.

    ``layout`` lists [name, type] of the non-indexed inputs, ``compiled`` is what
    decoding makes of it; ``repeated`` tells whether any name occurs twice.
    """
    plain = F.filter("inputs", lambda i: ~i["indexed"])
    layout = F.to_json(F.transform(plain, lambda i: F.array(i["name"], i["type"])))
    described = F.to_json(F.transform("inputs", lambda i: F.struct(i["type"].alias("type"), i["components"].alias("components"))))
    names = F.transform("inputs", lambda i: i["name"])
    return (
        events.withColumn("signature", F.concat("event_name", F.lit("("), canonical_types(described), F.lit(")")))
        .withColumn("topic0", keccak_text("signature"))
        .withColumn("layout", layout)
        .withColumn("layout_error", layout_error("layout"))
        .withColumn("compiled", compiled_layout("layout"))
        .withColumn("repeated", F.size(F.array_distinct(names)) < F.size(names))
    )


def wanted_events(scopes: DataFrame, events: DataFrame) -> DataFrame:
    """Events each scope asks for: (scope_id, requested, position, event columns, error).

    ``*`` keeps every event; a named event takes the last definition of that
    name, and a name the ABI lacks gives one row with ``EventNotFound``.
    """
    newest = Window.partitionBy("scope_id", "event_name").orderBy(F.desc("position"))
    by_name = events.withColumn("rank", F.row_number().over(newest)).where("rank = 1").drop("rank", "position")
    asked = scopes.select("scope_id", F.posexplode("events").alias("position", "requested"))
    named = (
        asked.where(F.col("requested") != "*")
        .join(by_name.withColumn("requested", F.col("event_name")), ["scope_id", "requested"], "left")
        .withColumn("error", F.when(F.col("event_name").isNull(), F.lit("EventNotFound")))
    )
    everything = (
        asked.where(F.col("requested") == "*").drop("position")
        .join(events, "scope_id")
        .withColumn("error", F.lit(None).cast("string"))
    )
    return named.unionByName(everything)


def resolve_abis(scopes: DataFrame, cache: DataFrame, overrides: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Pick each scope's ABI text: cache, then override file, then remote snapshot.

    ``cache`` is the contracts table, ``overrides`` has (path, content) and
    ``snapshot`` has (address, abi_json). Adds ``abi_source``, ``abi_json`` and
    ``error``; a resolved override or snapshot text is to be saved under the
    scope's own address (``to_save``).
    """
    wildcard = (F.size("events") == 1) & (F.get("events", F.lit(0)) == "*")
    joined = (
        scopes.join(cache.select("address", F.col("abi_json").alias("cached")), "address", "left")
        .join(overrides.select(F.col("path").alias("abi_override"), F.col("content").alias("local")), "abi_override", "left")
        .join(
            snapshot.select(F.col("address").alias("fetch_address"), F.col("abi_json").alias("remote")),
            F.coalesce("impl_address", "address") == F.col("fetch_address"),
            "left",
        )
        .drop("fetch_address")
    )
    cache_broken = F.col("cached").isNotNull() & ~is_abi_text("cached")
    cache_usable = is_abi_text("cached") & ((F.size(event_entries("cached")) > 0) | wildcard)
    source = (
        F.when(cache_broken | cache_usable, "cache")
        .when(F.col("local").isNotNull() & is_abi_text("local"), "override")
        .when(F.col("remote").isNotNull(), "snapshot")
        .otherwise("none")
    )
    picked = joined.withColumn("abi_source", source).withColumn(
        "abi_json",
        F.when(F.col("abi_source") == "cache", F.col("cached"))
        .when(F.col("abi_source") == "override", F.col("local"))
        .when(F.col("abi_source") == "snapshot", F.col("remote")),
    )
    return (
        picked.withColumn(
            "error",
            F.when(F.col("abi_source") == "none", F.lit("AbiRequired")).when(
                ~is_abi_text("abi_json"), F.lit("AbiParseFailed")
            ),
        )
        .withColumn("to_save", F.col("abi_source").isin("override", "snapshot") & F.col("error").isNull())
        .drop("cached", "local", "remote")
    )


def scope_preparation(resolved: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope_id, error): NULL when the scope is ready, else why it failed to prepare."""
    faults = wanted.select("scope_id", F.coalesce("error", F.when(F.col("layout_error").isNotNull(), "BadEventType")).alias("fault"))
    first = faults.where(F.col("fault").isNotNull()).groupBy("scope_id").agg(F.max("fault").alias("fault"))
    return resolved.join(first, "scope_id", "left").select("scope_id", F.coalesce("error", "fault").alias("error"))
