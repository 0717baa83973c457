"""Recognition operators: candidates, blocklist, assessment, reconciliation, resolution and metrics."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..sources.shared import staged


def candidates(docs: DataFrame, doc_id: str, body: str, fields: tuple[str, ...] = ("email", "phone")) -> DataFrame:
    """(doc_id, field, value) of e-mail addresses and phone numbers in the text, each once per document; a text without an at sign or a number's end is passed over."""
    fact = lambda field: lambda value: F.struct(F.lit(field).alias("field"), value.alias("value"))
    none = F.array().cast("array<struct<field:string,value:string>>")
    c = F.col(body)
    parts = {"email": (c.contains("@"), text.emails(c)), "phone": (c.rlike("[0-9]-[0-9]{4}"), text.phones(c))}
    found = F.concat(*[F.when(parts[f][0], F.transform(parts[f][1], fact(f))).otherwise(none) for f in fields])  # one reading
    return docs.select(doc_id, F.explode(F.array_distinct(found)).alias("f")).select(doc_id, "f.field", "f.value").distinct()


def blocked(found: DataFrame, keys: Column, blocklist: DataFrame, key: str, keep: bool) -> DataFrame:
    """Candidates of which some key is (keep=False) or none is (keep=True) in the blocklist."""
    rows = found.withColumn("_key", F.explode(keys)) if not keep else found
    if not keep:
        return rows.join(blocklist.select(F.col(key).alias("_key")), "_key", "left_semi").drop("_key").distinct()
    hit = found.withColumn("_key", F.explode(keys)).join(blocklist.select(F.col(key).alias("_key")), "_key", "left_semi").drop("_key").distinct()
    return found.join(hit, found.columns, "left_anti")


def assess(evidence: DataFrame, key: str, rank: str, role: str, reason: str, action: str) -> DataFrame:
    """Per candidate: the best rank; the role if the best rows agree, else unknown; all reasons, sorted; whether decisions conflict."""
    by_rank = evidence.groupBy(key, rank).agg(F.min(role).alias("_lo"), F.max(role).alias("_hi"), F.collect_set(reason).alias("_reasons"), F.min(action).alias("_a"), F.max(action).alias("_b"))
    least = F.min_by(F.struct("_lo", "_hi"), rank).alias("_at")
    sums = by_rank.groupBy(key).agg(F.min(rank).alias("best"), least, F.sort_array(F.array_distinct(F.flatten(F.collect_list("_reasons")))).alias("reasons"), (F.min("_a") < F.max("_b")).alias("conflict"))
    sums = sums.withColumns({"_lo": F.col("_at._lo"), "_hi": F.col("_at._hi"), "conflict": F.coalesce("conflict", F.lit(False))})
    return sums.select(key, "best", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise("unknown").alias("role"), "reasons", "conflict")


def independent(evidence: DataFrame, key: str, family: Column) -> DataFrame:
    return evidence.groupBy(key).agg(F.count("*").alias("evidence"), F.count_distinct(family).alias("independent"))


def stale(found: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Candidates without active evidence."""
    return found.join(active.select(key), key, "left_anti")


def lifecycle(found: DataFrame, master: DataFrame, key: str, value: str, master_value: str) -> DataFrame:
    """found with state: satisfied where the master data has the same value, conflict where another, active where none."""
    rows = found.join(master.select(key, master_value), key, "left")
    state = F.when(F.coalesce(F.col(master_value), F.lit("")) == "", "active").when(text.identity_key(F.col(value)) == text.identity_key(F.col(master_value)), "satisfied").otherwise("conflict")
    return rows.withColumn("state", state)


def resolution(cities: Column, owners: Column, exact: Column) -> Column:
    """What a group of roots comes to, by how many cities, owners and customers of the same name it has."""
    return (
        F.when((cities > 1) & (owners == 0) & (exact == 0), "different_cities")
        .when(owners > 1, "conflicting_project_owners")
        .when(exact > 1, "duplicate_exact_names")
        .when(owners == 1, "assign_owner")
        .when(exact == 1, "assign_exact")
        .otherwise("create")
    )


def name_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def similar_names(names: DataFrame, name: str, least: float = 0.86) -> DataFrame:
    """Pairs of names that are alike but not equal: (name, other, ratio), the one with the smaller identity key first.

    Alike are names with the same legal forms and number of words, 6 characters or more, and a ratio of at least `least`;
    names without legal forms also share their first and their last word, and are joined on those. For names with forms a
    ratio bounds the characters that differ, so that one of the pieces of the shorter name stands in the longer one, hardly
    moved: they are joined on these pieces. The ratio then runs on Arrow batches of what met.
    """

    @F.pandas_udf("double")
    def ratio(a, b):
        import pandas as pd

        return pd.Series([name_ratio(x, y) for x, y in zip(a, b, strict=True)])

    key = text.identity_key(F.col(name))
    rows = names.select(F.col(name).alias("name"), key.alias("key"), values.legal_forms(F.col(name)).alias("forms")).where(F.length("key") >= 6).distinct()
    rows = rows.withColumns({"n": F.size(F.split("key", " ")), "size": F.length("key"), "ends": F.concat_ws(" ", F.substring_index("key", " ", 1), F.substring_index("key", " ", -1))})
    bare, formal = rows.where(F.size("forms") == 0), rows.where(F.size("forms") > 0)
    pair = [F.col("a.name").alias("name"), F.col("b.name").alias("other"), F.col("a.key").alias("ka"), F.col("b.key").alias("kb")]
    pairs = bare.alias("a").join(bare.alias("b"), (F.col("a.ends") == F.col("b.ends")) & (F.col("a.n") == F.col("b.n")) & (F.col("a.key") < F.col("b.key"))).select(*pair)

    # ratio = 2 m / (x + y) with m characters in common: of x <= y, y is at most x * (2 / least - 1), and at most `far` characters
    # of both have no counterpart, so one of far + 1 pieces of the shorter name is whole in the longer one, moved by `far` at most
    longest = 2 / least - 1
    far = F.floor(F.lit((1 - least) * (1 + longest)) * F.col("x")).cast("int")
    cut = lambda i: F.floor(i * F.col("x") / (F.col("far") + 1)).cast("int")
    pieces = lambda df: df.withColumn("far", far).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("far")))).withColumns({"start": cut(F.col("i")), "width": cut(F.col("i") + 1) - cut(F.col("i"))})
    shorter = pieces(formal.withColumn("x", F.col("size"))).withColumn("piece", F.expr("substring(key, start + 1, width)"))
    sizes = F.sequence(F.greatest(F.lit(6), F.ceil(F.col("size") / longest).cast("int")), F.col("size"))
    longer = pieces(formal.withColumn("x", F.explode(sizes)))
    moved = longer.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("start") - F.col("far")), F.col("start") + F.col("far"))))
    moved = moved.withColumn("piece", F.expr("substring(key, at + 1, width)")).where(F.length("piece") == F.col("width"))
    on = ["forms", "n", "x", "i", "piece"]
    met = shorter.select(*on, F.col("name").alias("_a"), F.col("key").alias("_ka")).join(moved.select(*on, F.col("name").alias("_b"), F.col("key").alias("_kb")).distinct(), on).where("_ka <> _kb")
    swap = F.col("_ka") < F.col("_kb")
    both = lambda c: [F.when(swap, F.col(f"_{c[0]}")).otherwise(F.col(f"_{c[1]}")).alias(c[2])]
    met = met.select(*both(("a", "b", "name")), *both(("b", "a", "other")), *both(("ka", "kb", "ka")), *both(("kb", "ka", "kb"))).distinct()
    alike = pairs.unionByName(met).where(2 * F.least(F.length("ka"), F.length("kb")) >= least * (F.length("ka") + F.length("kb")))
    return alike.withColumn("ratio", F.round(ratio("ka", "kb"), 6)).where(F.col("ratio") >= least).select("name", "other", "ratio")


def metrics(expected: DataFrame, actual: DataFrame, key: list[str], dimensions: list[str]) -> DataFrame:
    """True and false positives, false negatives, precision and recall, over all and by each dimension; null where nothing counts.

    key identifies a fact and includes the dimensions; repeated facts count once.
    """
    e = expected.select(*key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*key).distinct().withColumn("_a", F.lit(1))
    rows = e.join(a, key, "full_outer").select(*dimensions, F.coalesce("_e", F.lit(0)).alias("e"), F.coalesce("_a", F.lit(0)).alias("a"))
    spread = rows.select(F.explode(F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("g"), "e", "a")
    sums = spread.groupBy("g.dimension", "g.value").agg(F.sum(F.col("e") * F.col("a")).alias("tp"), F.sum((1 - F.col("e")) * F.col("a")).alias("fp"), F.sum(F.col("e") * (1 - F.col("a"))).alias("fn"))
    return sums.select("dimension", "value", "tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def scores(expected: DataFrame, actual: DataFrame, key: list[str], dimensions: list[str], customer: str) -> DataFrame:
    """(dimension, value, tp, fp, fn, precision, recall, macro_precision, macro_recall) over all and by each dimension.

    key identifies a fact and includes the dimensions and the customer; repeated facts count once. Facts are counted by all dimensions
    first; GROUPING SETS over (dimension, customer) then give each customer's figures, of which the macro columns are the means
    over the customers that have one. Null where nothing counts.
    """
    e = expected.select(*key).distinct().withColumn("_e", F.lit(1))
    a = actual.select(*key).distinct().withColumn("_a", F.lit(1))
    rows = e.join(a, key, "full_outer").select(*key, F.coalesce("_e", F.lit(0)).alias("e"), F.coalesce("_a", F.lit(0)).alias("a"))
    names = list(dict.fromkeys([*dimensions, customer]))
    small = rows.groupBy(*names).agg(F.sum(F.col("e") * F.col("a")).alias("tp"), F.sum((1 - F.col("e")) * F.col("a")).alias("fp"), F.sum(F.col("e") * (1 - F.col("a"))).alias("fn"))
    sets = [[F.col(customer)], *[[F.col(d), F.col(customer)] for d in dimensions if d != customer]]
    marks = [F.grouping(d).alias(f"_{i}") for i, d in enumerate(dimensions) if d != customer]
    grouped = small.groupingSets(sets, *names).agg(*marks, *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    dimension, value = F.lit("all"), F.lit("")
    for i, d in enumerate(dimensions):
        if d != customer:
            dimension, value = F.when(F.col(f"_{i}") == 0, d).otherwise(dimension), F.when(F.col(f"_{i}") == 0, F.col(d).cast("string")).otherwise(value)
    one = grouped.select(dimension.alias("dimension"), value.alias("value"), F.col(customer).cast("string").alias("_c"), "tp", "fp", "fn")
    if customer in dimensions:
        one = one.unionByName(one.where("dimension = 'all'").select(F.lit(customer).alias("dimension"), F.col("_c").alias("value"), "_c", "tp", "fp", "fn"))
    one = one.withColumns({"p": F.try_divide("tp", F.col("tp") + F.col("fp")), "r": F.try_divide("tp", F.col("tp") + F.col("fn"))})
    sums = one.groupBy("dimension", "value").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"))
    return sums.select("dimension", "value", "tp", "fp", "fn", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"), "macro_precision", "macro_recall")


def root_groups(roots: DataFrame, key: str, owners: DataFrame | None = None) -> DataFrame:
    """(key, name, cities, owners, services, roots) of project roots (key, year, path, name, city, service) of one recognition key.

    The name is that of the latest root, ties by path without case. Sets are sorted and without empty values; owners (path, owner) names
    who has a root already.
    """
    rows = roots if owners is None else roots.join(owners.select("path", "owner"), "path", "left")
    line = F.struct(-F.col("year"), F.lower("path"), F.col("path"))
    values_of = lambda c: F.sort_array(F.collect_set(F.when(F.col(c).cast("string") != "", F.col(c))))
    own = values_of("owner") if owners is not None else F.array().cast("array<long>")
    return rows.groupBy(key).agg(F.min_by("name", line).alias("name"), values_of("city").alias("cities"), own.alias("owners"), values_of("service").alias("services"), F.count("*").alias("roots"))


def resolve_groups(groups: DataFrame, customers: DataFrame, key: str, least: float = 0.86) -> DataFrame:
    """groups (of root_groups, key being the identity key of the name) with outcome, customer (whose it is) and candidates, as if taken one after another by key.

    A group with several cities, no owner and no customer of its name is `different_cities`; then come several owners, several
    customers (id, name) of its name, its one owner (`missing_project_owner` if there is no such customer), its one customer, and a customer of a
    similar name. What is left creates a customer, and a later group that is similar to one so created is `similar_name` too.
    Only similar names make groups depend on each other: in each round those groups are decided that no earlier undecided group is similar
    to, so as many rounds are run as the longest chain of such groups has links, each a join of pairs.
    """
    known = customers.select(F.col("id").cast("long").alias("id"), "name", text.identity_key(F.col("name")).alias("_key"))
    exact = known.groupBy("_key").agg(F.sort_array(F.collect_list("id")).alias("_exact"))
    pairs = staged(similar_names(groups.select("name").union(known.select("name")).distinct(), "name", least).select("name", "other"))
    both = pairs.union(pairs.select("other", "name")).distinct()
    alike = both.join(known.select(F.col("name").alias("other"), "id"), "other").groupBy("name").agg(F.sort_array(F.collect_set("id")).alias("_alike"))
    none = F.array().cast("array<long>")
    rows = groups.withColumn("_key", F.col(key)).join(exact, "_key", "left").join(alike, "name", "left")
    rows = rows.withColumns({"_exact": F.coalesce("_exact", none), "_alike": F.coalesce("_alike", none), "_owner": F.get("owners", F.lit(0)).cast("long")})
    rows = rows.join(known.select(F.col("id").alias("_owner"), F.lit(True).alias("_there")), "_owner", "left")
    first = resolution(F.size("cities"), F.size("owners"), F.size("_exact"))
    first = F.when((first == "assign_owner") & F.col("_there").isNull(), "missing_project_owner").when((first == "create") & (F.size("_alike") > 0), "similar_name").otherwise(first)
    rows = staged(rows.withColumn("outcome", first).withColumn("_pool", F.when(F.size("_exact") > 0, F.col("_exact")).otherwise(F.col("_alike"))))

    # among those that would create: later groups wait for earlier ones of similar names
    making = rows.where("outcome = 'create'").select(key, "name")
    a, b = making.select(F.col(key).alias("_before"), "name"), making.select(F.col(key).alias("_after"), F.col("name").alias("other"))
    links = staged(both.join(a, "name").join(b, "other").where("_before < _after").select("_before", "_after"))
    state = links.select(F.col("_before").alias("k")).union(links.select("_after")).distinct().withColumn("made", F.lit(None).cast("boolean"))
    while True:
        earlier = links.join(state.select(F.col("k").alias("_before"), "made"), "_before").groupBy(F.col("_after").alias("k"))
        seen = earlier.agg(F.max(F.coalesce("made", F.lit(False))).alias("_some"), F.count_if(F.col("made").isNull()).alias("_open"))
        now = F.when(F.col("made").isNotNull(), F.col("made")).when(F.col("_some"), False).when(F.coalesce("_open", F.lit(0)) == 0, True)
        state = staged(state.join(seen, "k", "left").select("k", now.alias("made")))
        if state.where("made IS NULL").isEmpty():
            break
    late = state.where(~F.col("made")).select(F.col("k").alias(key), F.lit(True).alias("_late"))
    outcome = F.when(F.col("_late"), "similar_name").otherwise(F.col("outcome"))
    customer = F.when(F.col("outcome") == "assign_owner", F.col("_owner")).when(F.col("outcome") == "assign_exact", F.get("_exact", F.lit(0)))
    return rows.join(late, key, "left").select(*groups.columns, outcome.alias("outcome"), customer.alias("customer"), F.col("_pool").alias("candidates"))
