"""Customer data: revisions, children, contacts, project owners, provenance, outbox replay and counters, as joins and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_and_swap(known: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, value, revision, outcome): each change (key, value, revision) applies to the row that has its revision, which then rises.

    Unknown keys are created when the change has revision 0. At most one change a key.
    """
    rows = known.select(key, F.col("value").alias("_value"), F.col("revision").alias("_revision")).join(changes, key, "full_outer")
    created = F.col("_revision").isNull() & (F.col("revision") == 0)
    outcome = F.when(F.col("revision").isNull(), "kept").when(created, "created").when(F.col("_revision").isNull(), "unknown").when(F.col("_revision") == F.col("revision"), "updated").otherwise("conflict")
    done = outcome.isin("created", "updated")
    return rows.select(key, F.when(done, F.col("value")).otherwise(F.col("_value")).alias("value"), F.when(done, F.coalesce("_revision", F.lit(0)) + 1).otherwise(F.col("_revision")).alias("revision"), outcome.alias("outcome"))


def insert_or_ignore(known: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """known and those rows whose key it lacks, each key once."""
    return known.unionByName(rows.dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*known.columns))


def put_attempts(known: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The cache (key, status, attempts) after results (key, status): done entries stay as they are, others count one attempt more."""
    rows = known.select(key, F.col("status").alias("_was"), "attempts").join(results, key, "full_outer")
    fixed = (F.col("_was") == "ok") | F.col("status").isNull()
    return rows.select(key, F.when(fixed, F.col("_was")).otherwise(F.col("status")).alias("status"), F.when(fixed, F.col("attempts")).otherwise(F.coalesce("attempts", F.lit(0)) + 1).cast("long").alias("attempts"))


def fill_columns(known: DataFrame, update: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """known with each of the columns taken from update where that has a value."""
    new = update.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    rows = known.join(new, key, "left")
    return rows.select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def match_contacts(known: DataFrame, given: DataFrame, owner: str) -> DataFrame:
    """given (owner, place, uid, name, mail) with id, the known contact (owner, id, uid, name, mail) it is: by uid, else by name and mail, else by a name that occurs once on both sides."""
    by_uid = known.where("uid IS NOT NULL").groupBy(owner, "uid").agg(F.min("id").alias("_a"))
    exact = known.groupBy(owner, "name", "mail").agg(F.min("id").alias("_b"))
    once = lambda df: df.groupBy(owner, "name").agg(F.count("*").alias("_n"), F.min("id").alias("_c")).where("_n = 1").drop("_n")
    alone = given.groupBy(owner, "name").count().where("count = 1").select(owner, "name")
    named = once(known).join(alone, [owner, "name"])
    rows = given.join(by_uid, [owner, "uid"], "left").join(exact, [owner, "name", "mail"], "left").join(named, [owner, "name"], "left")
    return rows.withColumn("id", F.coalesce("_a", "_b", "_c")).drop("_a", "_b", "_c")


CONTACT = ("name", "role", "email", "phone")


def _replaced(known: list[dict], given: list[dict]) -> list[tuple]:
    """(place, id, outcome) of a customer's given contacts in order, and (None, id, removed) of known ones that none is."""
    fold = lambda c: tuple((c[f] or "").strip().casefold() for f in CONTACT)
    free, by_uid, out = {k["id"]: k for k in known}, {k["uid"]: k for k in known if k["uid"]}, []
    for g in given:
        alike = [k for k in free.values() if fold(k) == fold(g)]
        named = [k for k in free.values() if fold(g)[0] and fold(k)[0] == fold(g)[0]]
        if g["uid"]:
            match = by_uid.get(g["uid"])
            outcome = "unknown" if match is None else "matched" if match["id"] in free else "doubled"
        elif len(alike) == 1:
            match, outcome = alike[0], "matched"
        elif alike or len(named) > 1:
            match, outcome = None, "ambiguous"
        else:
            match, outcome = (named[0], "matched") if named else (None, "new")
        if outcome == "matched":
            del free[match["id"]]
        out.append((g["place"], match["id"] if outcome in ("matched", "doubled") else None, outcome))
    return out + [(None, i, "removed") for i in free]


def replace_contacts(known: DataFrame, given: DataFrame, owner: str) -> DataFrame:
    """(owner, place, id, outcome, valid): which known contact (owner, id, uid and CONTACT) each given one (owner, place, uid and CONTACT) is.

    Given ones are taken by place, and each known one is used once: by uid; without a uid by all four fields without case, else by a
    name that only one unused contact has; what matches none is new, and known ones left over are removed. An unknown
    or doubled uid and a name of several make the owner's whole list invalid, and then nothing of it holds. Owners
    are independent; one owner's contacts meet in one task.
    """
    id_kind, owner_kind = dict(known.dtypes)["id"], dict(known.dtypes)[owner]
    a = known.select(owner, F.lit(None).cast("int").alias("place"), "id", "uid", *CONTACT)
    b = given.select(owner, F.col("place").cast("int").alias("place"), F.lit(None).cast(id_kind).alias("id"), "uid", *CONTACT)
    parts = F.sort_array(F.collect_list(F.struct("place", "id", "uid", *CONTACT)))
    lists = a.unionByName(b).groupBy(owner).agg(parts.alias("x"))

    @F.arrow_udf(f"array<struct<place:int,id:{id_kind},outcome:string>>")
    def decide(values):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("place", pa.int32()), ("id", values.type.value_type.field("id").type), ("outcome", pa.string())]))
        rows = [_replaced([c for c in v if c["place"] is None], [c for c in v if c["place"] is not None]) for v in values.to_pylist()]
        return pa.array([[dict(zip(("place", "id", "outcome"), r, strict=True)) for r in out] for out in rows], kind)

    decided = lists.select(owner, decide("x").alias("x"))
    bad = F.exists("x", lambda r: r["outcome"].isin("unknown", "doubled", "ambiguous"))
    return decided.select(F.col(owner).cast(owner_kind), F.explode("x").alias("r"), (~bad).alias("valid")).select(owner, "r.*", "valid")


def assign_owners(owners: DataFrame, wanted: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """(key, owner, outcome) of assignments (key, owner): assigned, kept where the owner is the same, conflict where it is another.

    Of several for one unowned key the first by order is assigned (without an order the one with the least owner), and the others are held against it.
    """
    line = Window.partitionBy(key).orderBy(F.col("owner") if order is None else order)
    rows = wanted.withColumns({"_first": F.first("owner").over(line), "_place": F.row_number().over(line)}).join(owners.select(key, F.col("owner").alias("_owner")), key, "left")
    held = F.coalesce("_owner", "_first")
    outcome = F.when(F.col("_owner").isNull() & (F.col("_place") == 1), "assigned").when(held == F.col("owner"), "kept").otherwise("conflict")
    return rows.select(key, held.alias("owner"), outcome.alias("outcome"))


def provenance(known: DataFrame, records: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One record a key: the last of the new ones, else the known one."""
    last = records.groupBy(*key).agg(F.max_by("value", order).alias("_value"))
    return known.join(last, key, "full_outer").select(*key, F.coalesce("_value", "value").alias("value"))


def replay_outbox(mutations: DataFrame, key: str, order: str, conflict: Column) -> DataFrame:
    """mutations with outcome: per key, in order, applied up to the first conflict, which is reported; all behind it wait."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocked = F.coalesce(F.max(F.when(conflict, 1).otherwise(0)).over(upto), F.lit(0)) == 1
    return mutations.withColumn("outcome", F.when(blocked, "waiting").when(conflict, "conflict").otherwise("applied"))


def remap(mutations: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """mutations with local keys replaced by those that the server gave (local, id)."""
    new = mapping.select(F.col("local").alias(key), F.col("id").alias("_id"))
    rows = mutations.join(new, key, "left")
    return rows.withColumn(key, F.coalesce("_id", key)).drop("_id")


def reconcile_overlay(overlay: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    """The overlay rows (key, revision) that the snapshot (key, revision) has not yet reached."""
    rows = overlay.join(snapshot.select(key, F.col("revision").alias("_there")), key, "left")
    return rows.where(F.col("_there").isNull() | (F.col("_there") < F.col("revision"))).drop("_there")


def high_water(stored: DataFrame, ids: DataFrame, kind: str, number: str) -> DataFrame:
    """(kind, high): the greatest number ever given, also after its row is gone."""
    now = ids.groupBy(kind).agg(F.max(number).alias("_now"))
    return stored.join(now, kind, "full_outer").select(kind, F.greatest(F.coalesce("high", F.lit(0)), F.coalesce("_now", F.lit(0))).cast("long").alias("high"))


def bytes_used(rows: DataFrame, key: list[str], *columns: str) -> DataFrame:
    """Bytes of text columns by key."""
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in columns])
    return rows.groupBy(*key).agg(F.sum(size).cast("long").alias("bytes"))


def run_counters(changes: DataFrame, by: list[str], **counters: Column) -> DataFrame:
    """One row a group with the number of rows for which each condition holds."""
    return changes.groupBy(*by).agg(F.count("*").alias("discovered"), *[F.count_if(c).alias(name) for name, c in counters.items()])


def problems(coverage: DataFrame, key: str, good: tuple[str, ...] = ("ok", "unsupported")) -> DataFrame:
    """(key, files, problems) of coverage rows (key, status, files)."""
    bad = ~F.coalesce(F.col("status"), F.lit("")).isin(*good)
    return coverage.groupBy(key).agg(F.sum("files").alias("files"), F.sum(F.when(bad, F.col("files")).otherwise(0)).alias("problems"))


def verification_due(files: DataFrame, verified: str, now: Column, hours: int = 24) -> DataFrame:
    """Files whose content was never verified, or not for so many hours."""
    return files.where(F.col(verified).isNull() | (F.col(verified) <= now - F.make_interval(hours=F.lit(hours))))


def sources_are_the_same(known: DataFrame, seen: DataFrame, key: str) -> bool:
    """Whether a source may be read: nothing is known yet, or something known is still there. Call it before anything is deleted."""
    return not known.limit(1).count() or known.join(seen, key, "left_semi").limit(1).count() > 0


def with_local(hits: DataFrame, views: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Hits with their live views, and local rows whose key is not among them."""
    there = hits.select(key).distinct().join(views, key)
    return there.unionByName(local.join(there.select(key), key, "left_anti").select(*there.columns))
