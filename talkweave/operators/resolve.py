"""Which conversation a name means."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave import schema as S
from talkweave.operators.people import FIELDS, contact_matches, names


class NotFound(LookupError):
    """No contact, or a hidden one: the message is the same."""


class Ambiguous(ValueError):
    """Several visible contacts match."""


@dataclass(frozen=True)
class Resolved:
    user_name: str
    display_name: str | None = None


def resolve(contacts: DataFrame, name: str, hidden: DataFrame | None = None, show_hidden: bool = False, most: int = 10) -> Resolved:
    """In turn: ids that speak for themselves, a contact's id, what looks like an account, and a unique match of any field.

    One hidden match is not found; of several, hidden ones are left out first. At most most + 1 rows reach the driver."""
    if not name.strip():
        raise NotFound("empty contact identifier")
    missing = NotFound(f'contact "{name}" not found')

    def shown(found: Resolved) -> Resolved:
        if hidden is not None and not show_hidden and hidden.filter(F.col("id") == found.user_name).limit(1).count():
            raise NotFound(f'contact "{found.user_name}" not found')
        return found

    if name.startswith(S.PASS_THROUGH_PREFIX) or name.endswith(S.GROUP_SUFFIX) or name in S.PASS_THROUGH_IDS:
        return shown(Resolved(name))
    own = names(contacts)
    if exact := own.filter(F.col("user_name") == name).limit(1).collect():
        return shown(Resolved(name, exact[0]["display_name"]))
    if re.fullmatch(r"[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*", name):
        return shown(Resolved(name))
    near = contacts.filter(contact_matches(name)).join(own.select("user_name", "display_name"), "user_name").select("user_name", "display_name")
    found = near.orderBy("user_name").limit(2).collect()
    if len(found) == 1:
        return shown(Resolved(*found[0]))
    if hidden is not None and not show_hidden:
        near = near.join(hidden.select(F.col("id").alias("user_name")), "user_name", "left_anti")
    found = near.orderBy("user_name").limit(most + 1).collect()
    if not found:
        raise missing
    if len(found) > 1:
        raise Ambiguous(f'ambiguous contact "{name}": ' + ", ".join(f"{r.display_name} ({r.user_name})" for r in found[:most]))
    return Resolved(*found[0])


#: Bits of the filter that substrings pass before they are dealt out: 2 MB of longs.
BITS = 1 << 24


def substrings(texts: Column, lengths: Column) -> Column:
    """Hashes of the distinct substrings of these lengths."""
    at = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.xxhash64(F.substring(t, i, n)))
    each = lambda t: F.flatten(F.transform(F.filter(lengths, lambda n: n <= F.length(t)), lambda n: at(t, n)))
    return F.array_distinct(F.flatten(F.transform(texts, each)))


def bit_filter(keys: DataFrame) -> Column:
    """BITS bits, as an array of longs: those of the column key's values are set. A scalar subquery."""
    k = F.pmod(F.col("key"), F.lit(BITS))
    own = keys.groupBy(F.expr(f"pmod(key, {BITS}) div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (k % 64).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(BITS // 64).join(own, F.col("id") == F.col("word"), "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))), lambda s: s["bits"]).alias("f")).scalar()


def resolve_all(contacts: DataFrame, asked: DataFrame, hidden: DataFrame | None = None, show_hidden: bool = False) -> DataFrame:
    """asked, outcome (found, not found or ambiguous), user_name, display_name, n (contacts that are visible and match): what
    resolve() says of every distinct name of asked (a column of that name), in one plan.

    Names that do not speak for themselves meet contacts by hashes of whole names: of the contacts' fields these are the substrings
    that are as long as some name. A filter of fixed size leaves out most that no name has before they are dealt out, and what
    meets is a match, not a candidate; the name itself is compared then."""
    own = names(contacts).groupBy("user_name").agg(F.first("display_name").alias("display_name"))
    passes = F.col("asked").startswith(S.PASS_THROUGH_PREFIX) | F.col("asked").endswith(S.GROUP_SUFFIX) | F.col("asked").isin(*S.PASS_THROUGH_IDS)
    d = asked.select("asked").filter("asked is not null").distinct().join(own.select(F.col("user_name").alias("asked"), F.col("display_name").alias("__shown"), F.lit(True).alias("__exact")), "asked", "left")
    direct = passes | F.col("__exact").isNotNull() | F.col("asked").rlike("^[A-Za-z0-9_]*[0-9][A-Za-z0-9_]*$")
    d = d.withColumn("__direct", direct & (F.trim("asked") != ""))
    gone = None if hidden is None or show_hidden else hidden.select(F.col("id").alias("user_name"))

    open_ = d.filter(~F.col("__direct") & (F.trim("asked") != "")).select("asked", F.lower("asked").alias("low"))
    texts = F.transform(F.array_compact(F.concat(F.array(*FIELDS), F.coalesce("labels", F.array().cast("array<string>")))), lambda t: F.lower(t))
    seen = contacts if gone is None else contacts.join(gone, "user_name", "left_anti")
    seen = seen.select("user_name", texts.alias("texts"))
    wanted = open_.withColumn("key", F.xxhash64("low"))
    lengths = open_.agg(F.collect_set(F.length("low")).alias("lengths"))
    held = seen.crossJoin(F.broadcast(lengths)).select("user_name", F.explode(substrings(F.col("texts"), F.col("lengths"))).alias("key"))
    k = F.pmod(F.col("key"), F.lit(BITS))
    held = held.filter(F.call_function("getbit", F.element_at(bit_filter(wanted), (F.floor(k / 64) + 1).cast("int")), (k % 64).cast("int")) == 1)
    pairs = held.join(wanted, "key").select("asked", "low", "user_name").distinct()
    near = pairs.join(seen, "user_name").filter(F.exists("texts", lambda t: t.contains(F.col("low"))))
    near = near.groupBy("asked").agg(F.count("*").alias("n"), F.min("user_name").alias("__near")).join(own.withColumnRenamed("user_name", "__near"), "__near", "left")

    d = d.join(near, "asked", "left").withColumn("user_name", F.when(F.col("__direct"), F.col("asked")).when(F.col("n") == 1, F.col("__near")))
    if gone is not None:
        d = d.join(gone.distinct().withColumn("__gone", F.lit(True)), "user_name", "left").withColumn("user_name", F.when(F.col("__gone").isNull(), F.col("user_name")))
    outcome = F.when(F.col("user_name").isNotNull(), "found").when(F.coalesce("n", F.lit(0)) > 1, "ambiguous").otherwise("not found")
    shown = F.when(F.col("user_name").isNotNull(), F.when(F.col("__direct"), F.col("__shown")).otherwise(F.col("display_name")))
    return d.select("asked", outcome.alias("outcome"), "user_name", shown.alias("display_name"), F.coalesce("n", F.lit(0)).alias("n"))
