"""Decoding matched logs into event fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainevents.functions.abi import OVERRUN, decode_others
from chainevents.functions.expressions import hex_text, json_string, prefixed_hex, topics_text
from chainevents.functions.words import rendered


def indexed_value(kind: Column, topic: Column) -> Column:
    """JSON text of an indexed parameter: ``topic`` is 64 hex digits, ``kind`` its type."""
    quoted = lambda c: F.concat(F.lit('"0x'), c, F.lit('"'))
    # Almost all numbers fit 64 bits and take the short way.
    number = F.when(F.substring(topic, 1, 48) == "0" * 48, F.lower(F.conv(F.substring(topic, 49, 16), 16, 16))).otherwise(F.regexp_replace(topic, "^0+", ""))
    size = F.coalesce(F.substring(kind, 6, 20).try_cast("int"), F.lit(32))
    return (
        F.when(kind == "address", quoted(F.substring(topic, 25, 40)))
        .when(kind == "bool", F.when(F.substring(topic, 63, 2) == "00", "false").otherwise("true"))
        .when(F.startswith(kind, F.lit("uint")) | F.startswith(kind, F.lit("int")), quoted(number))
        .when(
            F.startswith(kind, F.lit("bytes")) & (F.length(kind) > 5),
            quoted(F.substring(topic, F.lit(1), F.least(size, F.lit(32)) * 2)),
        )
        .otherwise(quoted(topic))
    )


def decode_logs(matched: DataFrame, arrow: bool = True) -> DataFrame:
    """Add ``decoded`` (JSON text) and ``decode_failed`` to matched logs.

    Needs ``topics``, ``data`` (binary), ``inputs``, ``compiled`` and ``repeated``.
    Indexed fields and static words of the data are column expressions; only dynamic
    fields, addresses and arrays of many words go through Arrow. Where the registry
    has no such field (``needs_arrow``), ``arrow`` can be left out and no Python runs.
    A field without its topic is absent, and so are data fields when data is empty.
    When data cannot be decoded the event keeps the raw bytes and an error marker.
    """
    indexed = F.filter("inputs", lambda i: i["indexed"])
    plain = F.transform(F.filter("inputs", lambda i: ~i["indexed"]), lambda i: i["name"])
    topics = F.slice("topics", 2, 3)
    present = F.slice(indexed, F.lit(1), F.least(F.size(indexed), F.size(topics)))
    named = F.transform(
        present, lambda i, at: F.struct(i["name"].alias("name"), indexed_value(i["type"], hex_text(F.get(topics, at))).alias("json"))
    )
    # Of equal names the last one present wins.
    later = lambda e, i: F.exists(F.slice(F.col("_indexed"), i + 2, 3), lambda x: x["name"] == e["name"])
    in_data = lambda e: F.col("_members").isNotNull() & F.array_contains(plain, e["name"])
    kept = F.when(F.col("repeated"), F.filter("_indexed", lambda e, i: ~later(e, i) & ~in_data(e))).otherwise(F.col("_indexed"))
    from_topics = F.array_join(F.transform(kept, lambda e: F.concat(json_string(e["name"]), F.lit(":"), e["json"])), ",")
    fallback = F.when(
        F.col("_error").isNotNull(),
        F.concat(F.lit('"_decode_error":'), json_string("_error"), F.lit(',"_raw_data":"'), hex_text("data"), F.lit('"')),
    )
    members = F.concat_ws(",", F.when(F.length(from_topics) > 0, from_topics), F.col("_members"), fallback)
    held = F.length("data")
    given = (held > 0) & (F.size("compiled.program") > 0)
    whole = given & (held >= F.col("compiled.size"))
    none = F.lit(None).cast("struct<values:array<string>,error:string>")
    others = decode_others(F.when(whole, F.col("compiled.others")), "data") if arrow else none
    return (
        matched.withColumn("_others", others)
        .withColumn("_error", F.when(given, F.when(whole, F.col("_others.error")).otherwise(OVERRUN)))
        .withColumn("_members", F.when(whole & F.col("_error").isNull(), rendered(F.col("compiled.program"), F.col("data"), F.col("_others.values"))))
        .withColumn("_indexed", named)
        .withColumn("decoded", F.concat(F.lit("{"), members, F.lit("}")))
        .withColumn("decode_failed", F.col("_error").isNotNull())
        .drop("_others", "_error", "_members", "_indexed")
    )


def needs_arrow(registry: DataFrame) -> bool:
    """Whether any event of the (small) registry has data that column expressions cannot render."""
    return not registry.where("compiled.others IS NOT NULL").limit(1).isEmpty()


def stored_rows(decoded: DataFrame, source: str = "era1", extra: list[str] | None = None) -> DataFrame:
    """Decoded logs in the stored event shape; ``contract`` is the registry's checksummed text."""
    return decoded.select(
        "contract",
        "event_name",
        "topic0",
        "block_number",
        prefixed_hex("block_hash").alias("block_hash"),
        prefixed_hex("tx_hash").alias("tx_hash"),
        "tx_index",
        "log_index",
        topics_text(F.transform("topics", prefixed_hex)).alias("raw_topics"),
        hex_text("data").alias("raw_data"),
        "decoded",
        F.lit(source).alias("source"),
        F.col("timestamp").cast("bigint").alias("timestamp"),
        *(extra or []),
    )
