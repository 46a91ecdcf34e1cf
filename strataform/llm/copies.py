"""Collapse records that differ only in writing: white space, letter case, punctuation, field order, notation.

Each normalised (field name, value) pair is hashed; the hashes of a record are added in a finite group, so
that the order of its fields is irrelevant (a commutative multiset hash, two independent sums of 61 bits).
Records are grouped by fingerprint and every copy is then compared with its group's first record field by
field, as multisets, without sorting. Records that share a fingerprint but not the fields are told apart by the
multiset itself.

A payload is parsed once: key, scope, fields and fingerprint are written to the checkpoint folder. Groups are
counted on key and fingerprint alone (hash aggregation on the map side); only first records of groups of two and
more are looked up again. A group of a third of all rows goes by broadcast (hot_split_lookup).

Cases: null, blank and field-less payloads count as records without fields and are copies of each other
(within paper and section); absent, null and empty fields are equal; a repeated field counts as often as it
comes; text that is neither JSON nor key-value lines is one field without a name; null paper or section is a
group of its own; very long values are kept whole; keys are unique: of repeated rows of one key none is a copy of
the other; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.stage import staged
from strataform.operators.skew import hot_split_lookup
from strataform.session import cut

_PRIME = (1 << 61) - 1
_IS = "\u0001"  # between the name and the value of a field


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def normal_value(c: Column) -> Column:
    """Lower case without white space, punctuation and control characters; a point between digits stays,
    and so does a percent sign."""
    kept = F.regexp_replace(F.lower(c), r"(?<=[0-9])\.(?=[0-9])", "\u0001")
    bare = F.regexp_replace(kept, "[\\s\\p{Z}[\\p{P}&&[^%]][\\p{C}&&[^\u0001]]]+", "")
    return F.translate(bare, "\u0001", ".")


def fields(payload: Column) -> Column:
    """array<string> of normalised name and value, with a control character between (neither can hold one), in the
    order of the payload: a JSON object, or key-value parts split by '|', ';' or line ends, with ':' or '=' after
    the name."""
    as_json = F.map_entries(F.from_json(payload, "map<string,string>"))
    sep = F.when(payload.contains("|"), F.lit("[|]")).when(payload.contains(";"), F.lit(";")).otherwise(F.lit("\\R"))
    parts = F.filter(F.split(payload, sep), lambda p: p.rlike(r"\S"))
    pair = lambda p: F.struct(
        F.when(p.rlike("[:=]"), F.regexp_extract(p, r"(?s)^([^:=]*)[:=]", 1)).otherwise(F.lit("")).alias("key"),
        F.when(p.rlike("[:=]"), F.regexp_extract(p, r"(?s)^[^:=]*[:=](.*)$", 1)).otherwise(p).alias("value"),
    )
    raw = F.when(payload.rlike(r"^\s*\{"), F.coalesce(as_json, F.transform(F.array(payload), lambda p: F.struct(F.lit("").alias("key"), p.alias("value"))))).otherwise(F.transform(parts, pair))
    pairs = F.transform(raw, lambda e: F.struct(normal_name(e["key"]).alias("n"), normal_value(e["value"]).alias("v")))
    kept = F.filter(pairs, lambda e: e["v"].isNotNull() & (e["v"] != ""))
    return F.coalesce(F.transform(kept, lambda e: F.concat_ws(_IS, e["n"], e["v"])), F.expr("CAST(array() AS array<string>)"))


def multiset_hash(pairs: Column, seed: int) -> Column:
    each = lambda e: F.pmod(F.xxhash64(F.lit(seed), e), F.lit(_PRIME))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, e: F.pmod(acc + each(e), F.lit(_PRIME)))


def same_multiset(a: str, b: str) -> Column:
    """Equality of two field arrays as multisets, by hash sets. Only arrays that hold an element twice are counted
    element by element."""
    once = f"size(array_distinct({a})) = size({a})"
    counted = f"forall(array_distinct({a}), one_ -> size(filter({a}, x_ -> x_ = one_)) = size(filter({b}, x_ -> x_ = one_)))"
    return F.expr(f"size({a}) = size({b}) AND size(array_intersect({a}, {b})) = size(array_distinct({a})) AND ({once} OR {counted})")


def fingerprints(df: DataFrame, key: str, scope: list[str], payload: str) -> DataFrame:
    """id, scope, f, h1, h2, materialised: a payload is parsed once."""
    src = df.select(F.col(key).cast("bigint").alias("id"), F.struct(*scope).alias("scope"), F.col(payload).alias("p"))
    src = staged(src, {"f": fields(F.col("p"))}).drop("p")
    place = lambda s: F.pmod(F.xxhash64(F.lit(s), F.to_json("scope", {"ignoreNullFields": "false"})), F.lit(_PRIME))
    add = lambda h, s: F.pmod(h + place(s), F.lit(_PRIME))
    return cut(src.select("id", "scope", "f", add(multiset_hash(F.col("f"), 11), 12).alias("h1"), add(multiset_hash(F.col("f"), 21), 22).alias("h2")))


def groups(fp: DataFrame) -> DataFrame:
    """h1, h2, first_id, n of each fingerprint. Combined on the map side, so a group of a third of all rows travels
    as one row per task."""
    return fp.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def compared(fp: DataFrame, many: DataFrame) -> DataFrame:
    """The rows of groups of two and more, with first_id and equal: whether a row has the fields and the scope of
    its group's first record."""
    first = many.join(fp.select("h1", "h2", F.col("id").alias("first_id"), F.col("f").alias("rf"), F.col("scope").alias("rscope")), ["h1", "h2", "first_id"])
    joined = hot_split_lookup(fp, cut(first), ["h1", "h2"], "n")
    return joined.withColumn("equal", same_multiset("f", "rf") & F.col("scope").eqNullSafe(F.col("rscope"))).drop("rf", "rscope")


def told_apart(other: DataFrame) -> DataFrame:
    """Rows whose fingerprints meet by chance, with the smallest id of those of equal fields (own). They are few;
    a field array is made a key by counting its elements."""
    count = F.transform(F.array_sort(F.array_distinct("f")), lambda x: F.concat(x, F.lit(_IS), F.size(F.filter("f", lambda y: y == x))))
    keyed = other.withColumn("k", F.to_json(F.struct("scope", count.alias("c")), {"ignoreNullFields": "false"}))
    return keyed.join(keyed.groupBy("k").agg(F.min("id").alias("own"), F.count(F.lit(1)).alias("own_n")), "k")


def copies(df: DataFrame, key: str, scope: list[str], payload: str) -> DataFrame:
    """(first_id, copy_id): each record that is a copy, with the smallest id of its group."""
    fp = fingerprints(df, key, scope, payload)
    c = compared(fp, groups(fp).where("n > 1"))
    sure = c.where("equal AND id <> first_id").select("first_id", F.col("id").alias("copy_id"))
    other = told_apart(c.where("NOT equal")).where("id <> own").select(F.col("own").alias("first_id"), F.col("id").alias("copy_id"))
    return sure.unionByName(other)


def collapsed(df: DataFrame, key: str, scope: list[str], payload: str) -> DataFrame:
    """One row per distinct record: first_id, n_copies (the record itself included), its fields as
    array<struct<name,value>>, repeated ones as often as they come. Groups are verified as in copies()."""
    fp = fingerprints(df, key, scope, payload)
    g = cut(groups(fp))
    c = cut(compared(fp, g.where("n > 1")).select("h1", "h2", "id", "scope", "f", "equal").where("NOT equal"))
    less = c.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("less"))
    sure = g.join(less, ["h1", "h2"], "left").select("first_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n_copies"))
    own = told_apart(c).where("id = own").select(F.col("own").alias("first_id"), F.col("own_n").alias("n_copies"))
    firsts = sure.unionByName(own).join(fp.select(F.col("id").alias("first_id"), "scope", "f"), "first_id")
    pair = lambda x: F.struct(F.substring_index(x, _IS, 1).alias("name"), F.substring_index(x, _IS, -1).alias("value"))
    return firsts.select("first_id", "n_copies", *[F.col(f"scope.{x}").alias(x) for x in scope], F.transform("f", pair).alias("fields"))
