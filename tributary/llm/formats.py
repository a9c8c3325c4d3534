"""Duplicates hidden by formatting differences: canonical form, 128-bit hash, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.blocks import block_pairs

FIELDS = ["review_id", "user_id", "business_id", "text"]


def canonical(text: Column) -> Column:
    """Lower-cased, only Unicode letters and digits left."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def payload_records(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """The four fields of the payloads that are complete JSON objects, whatever the order of their members.

    Payloads that are null, cut off, followed by more, or other than objects give no row; missing members are null.
    """
    schema = ", ".join([*(f"{c} string" for c in FIELDS), "_bad string"])
    body = F.btrim(F.col(payload), F.lit(" \t\n\r"))
    parsed = F.from_json(body, schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = messages.where(body.startswith("{") & body.endswith("}") & F.try_parse_json(body).isNotNull()).select(parsed.alias("d"))
    return rows.where("d._bad is null").select("d.*").select(*FIELDS)


class FormatCopies:
    """Records that agree in all fields but for case, white space, punctuation and field order.

    ``records`` has review_id, user_id, business_id and text; further columns play no
    part. Records with a null in a field, or a text without letter or digit, are left out.

    The canonical fields are hashed to 128 bits (MD5), with a 64-bit check hash of another
    function beside it. Counting combines before the shuffle, so a record copied a billion times is
    a row per task. A key whose records differ in the check hash is a collision: its records are kept
    apart by the check hash, and ``collisions`` lists it.
    """

    def __init__(self, records: DataFrame):
        rows = records.select(*FIELDS).dropna()
        fields = [canonical(F.col(c)) for c in ("user_id", "business_id", "text")]
        rows = rows.withColumns({"_u": fields[0], "_b": fields[1], "_t": fields[2]}).where("_t <> ''")
        # none of the canonical fields can hold the separator
        whole = F.concat_ws("|", "_u", "_b", "_t")
        self.rows = rows.select("review_id", F.md5(whole).alias("key"), F.xxhash64(whole).alias("check"))

    def counts(self) -> DataFrame:
        """(key, check, review_id, copies): one row per record, with the least id of its copies."""
        return self.rows.groupBy("key", "check").agg(F.min("review_id").alias("review_id"), F.count(F.lit(1)).alias("copies"))

    def collisions(self) -> DataFrame:
        """(key, checks): keys that different records share."""
        return self.rows.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b")

    def pairs(self) -> DataFrame:
        """(review_id_a, review_id_b): all pairs of different ids of one record."""
        members = self.rows.distinct()
        return block_pairs(members, ["key", "check"], "review_id").select("review_id_a", "review_id_b").distinct()
