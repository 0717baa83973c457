"""Recognition queries on the driver's tables: facts from texts, their evidence, and how groups are resolved."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import recognition
from ..registry import query
from ..sources.shared import staged
from .catalog import read

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_PHONE = r"(?:\+[0-9]{1,3} ?)?\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}"
_MAILS = f"SELECT DISTINCT doc_id, regexp_replace(v, '\\.+$', '') AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents)"
_CALLS = f"SELECT DISTINCT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS v FROM documents)"
_FACTS = f"SELECT doc_id, 'email' AS field, value FROM ({_MAILS}) UNION ALL SELECT doc_id, 'phone', value FROM ({_CALLS})"


def _facts(spark, sf_dir, *fields):
    return recognition.candidates(read(spark, sf_dir, "documents"), "doc_id", "text", fields or ("email", "phone"))


@query("email_candidates", _MAILS)
def email_candidates(spark, sf_dir):
    return _facts(spark, sf_dir, "email").select("doc_id", "value")


@query("email_domains", f"SELECT lower(string_split(value, '@')[-1]) AS domain, CAST(count(*) AS BIGINT) AS n FROM ({_MAILS}) GROUP BY 1")
def email_domains(spark, sf_dir):
    return _domains(email_candidates(spark, sf_dir))


def _domains(mails):
    return mails.groupBy(text.email_domain(F.col("value")).alias("domain")).agg(F.count("*").alias("n"))


@query("phone_candidates", _CALLS)
def phone_candidates(spark, sf_dir):
    return _facts(spark, sf_dir, "phone").select("doc_id", "value")


@query("channel_candidates", _FACTS)
def channel_candidates(spark, sf_dir):
    return _facts(spark, sf_dir)


_BLOCK = f"SELECT domain FROM (SELECT lower(string_split(value, '@')[-1]) AS domain, count(*) AS n FROM ({_MAILS}) GROUP BY 1) WHERE n >= 2"


def _blocked(spark, sf_dir, keep):
    """Addresses by the blocklist of the domains that they have twice; the texts are read once."""
    mails = staged(email_candidates(spark, sf_dir))
    keys = F.array(F.lower("value"), text.email_domain(F.col("value")))
    return recognition.blocked(mails, keys, _domains(mails).where("n >= 2"), "domain", keep)


@query("blocklist_keep", f"SELECT doc_id, value FROM ({_MAILS}) WHERE lower(string_split(value, '@')[-1]) NOT IN ({_BLOCK})")
def blocklist_keep(spark, sf_dir):
    return _blocked(spark, sf_dir, keep=True)


@query("blocklist_hits", f"SELECT doc_id, value FROM ({_MAILS}) WHERE lower(string_split(value, '@')[-1]) IN ({_BLOCK})")
def blocklist_hits(spark, sf_dir):
    return _blocked(spark, sf_dir, keep=False)


_FAMILY = "trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("document_family", f"SELECT doc_id, CASE WHEN length({_FAMILY}) = 0 THEN '' ELSE sha256({_FAMILY}) END AS family FROM documents")
def document_family(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.family_key(F.col("text")).alias("family"))


@query("independent_evidence", f"SELECT source, CAST(count(*) AS BIGINT) AS evidence, CAST(count(DISTINCT sha256({_FAMILY})) AS BIGINT) AS independent FROM documents GROUP BY 1")
def independent_evidence(spark, sf_dir):
    return recognition.independent(read(spark, sf_dir, "documents"), "source", text.family_key(F.col("text")))


@query("document_key", "SELECT doc_id, sha256(source || '|' || CAST(doc_id AS VARCHAR)) AS document_key FROM documents")
def document_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.document_key(F.col("source"), F.col("doc_id").cast("string")).alias("document_key"))


@query(
    "candidate_assessment",
    """WITH e AS (SELECT source, CASE WHEN quality = 1 THEN 0 WHEN toxic = 0 THEN 1 ELSE 2 END AS rank, lang AS role, CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS reason FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    b AS (SELECT *, min(rank) OVER (PARTITION BY source) AS best FROM e)
    SELECT source, min(rank) AS best, CASE WHEN min(CASE WHEN rank = best THEN role END) = max(CASE WHEN rank = best THEN role END) THEN min(CASE WHEN rank = best THEN role END) ELSE 'unknown' END AS role,
    string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons, count(DISTINCT reason) > 1 AS conflict FROM b GROUP BY 1""",
)
def candidate_assessment(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    rank = F.when(F.col("quality") == 1, 0).when(F.col("toxic") == 0, 1).otherwise(2)
    reason = F.when(F.col("toxic") == 1, "toxic").otherwise("clean")
    found = recognition.assess(rows.select("source", rank.alias("rank"), "lang", reason.alias("reason")), "source", "rank", "lang", "reason", "reason")
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("stale_candidates", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def stale_candidates(spark, sf_dir):
    active = read(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return recognition.stale(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), active, "c_custkey")


@query(
    "reconcile_master",
    """SELECT c_custkey, CASE WHEN coalesce(n_name, '') = '' THEN 'active' WHEN trim(regexp_replace(lower('Nation ' || CAST(c_custkey % 25 AS VARCHAR)), '[^\\p{L}\\p{N}]+', ' ', 'g')) = trim(regexp_replace(lower(replace(n_name, '_', ' ')), '[^\\p{L}\\p{N}]+', ' ', 'g'))
    THEN 'satisfied' ELSE 'conflict' END AS state FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
def reconcile_master(spark, sf_dir):
    found = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"), F.concat(F.lit("Nation "), (F.col("c_custkey") % 25).cast("string")).alias("value"))
    master = read(spark, sf_dir, "nation").select("n_nationkey", F.regexp_replace("n_name", "_", " ").alias("master"))
    return recognition.lifecycle(found, master, "n_nationkey", "value", "master").select("c_custkey", "state")


@query(
    "identity_key",
    "SELECT 'part' AS kind, p_partkey AS id, trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) AS key FROM part UNION ALL SELECT 'customer', c_custkey, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}_]+', ' ', 'g')) FROM customer",
)
def identity_key(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), text.identity_key(F.col("p_name")).alias("key"))
    return part.unionByName(read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), text.identity_key(F.col("c_name")).alias("key")))


@query("similar_names")
def similar_names(spark, sf_dir):
    """Names of roots and customers that are alike: parts' names as firms, and the same with one letter doubled."""
    names = read(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" GmbH")).alias("p_name")).distinct()
    doubled = names.select(F.regexp_replace("p_name", r"^(\S+ )(\S)(.*)$", "$1$2$2$3").alias("p_name"))
    return recognition.similar_names(names.unionByName(doubled), "p_name")


@query(
    "group_resolution",
    """WITH g AS (SELECT o_custkey, count(DISTINCT o_orderpriority) AS cities, count(DISTINCT CASE WHEN o_totalprice > 400000 THEN year(o_orderdate) END) AS owners FROM orders GROUP BY 1),
    x AS (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS exact FROM customer)
    SELECT o_custkey, CASE WHEN cities > 1 AND owners = 0 AND exact = 0 THEN 'different_cities' WHEN owners > 1 THEN 'conflicting_project_owners' WHEN exact > 1 THEN 'duplicate_exact_names' WHEN owners = 1 THEN 'assign_owner' WHEN exact = 1 THEN 'assign_exact' ELSE 'create' END AS outcome
    FROM g JOIN x ON c_custkey = o_custkey""",
)
def group_resolution(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    groups = orders.groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("cities"), F.count_distinct(F.when(F.col("o_totalprice") > 400000, F.year("o_orderdate"))).alias("owners"))
    names = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_acctbal") > 0, 1).otherwise(0).alias("exact"))
    return groups.join(names, "o_custkey").select("o_custkey", recognition.resolution(F.col("cities"), F.col("owners"), F.col("exact")).alias("outcome"))


@query(
    "customer_aggregate",
    """SELECT c_custkey, c_name, n_name, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS projects, CAST(count(o_orderkey) AS BIGINT) AS n
    FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
)
def customer_aggregate(spark, sf_dir):
    keys = F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string"))
    projects = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(keys, ",").alias("projects"), F.count("*").alias("n"))
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_name", "n_name")
    return rows.join(projects, "c_custkey", "left").withColumns({"projects": F.coalesce("projects", F.lit("")), "n": F.coalesce("n", F.lit(0))})


@query(
    "contact_variants",
    """WITH u AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'), c AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT c.conv_id, coalesce(u.turn, -1) AS user_turn, coalesce(a.turn, -1) AS assistant_turn FROM c LEFT JOIN u ON u.conv_id = c.conv_id LEFT JOIN a ON a.conv_id = c.conv_id""",
)
def contact_variants(spark, sf_dir):
    turns = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("turn"))))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns("user").alias("u"), turns("assistant").alias("a"))
    rows = rows.select("conv_id", F.explode_outer("u").alias("user_turn"), "a").select("conv_id", "user_turn", F.explode_outer("a").alias("assistant_turn"))
    return rows.select("conv_id", F.coalesce("user_turn", F.lit(-1)).alias("user_turn"), F.coalesce("assistant_turn", F.lit(-1)).alias("assistant_turn"))


@query(
    "recognition_metrics",
    """WITH j AS (SELECT d.doc_id, lang, source, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS e, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS a FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    s AS (SELECT CASE WHEN GROUPING(lang) = 0 THEN 'lang' WHEN GROUPING(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source, '') AS value, sum(e * a) AS tp, sum((1 - e) * a) AS fp, sum(e * (1 - a)) AS fn FROM j WHERE e + a > 0 GROUP BY GROUPING SETS ((), (lang), (source)))
    SELECT dimension, value, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall FROM s""",
)
def recognition_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    return recognition.metrics(rows.where("quality = 1"), rows.where("n_chars > 1500"), ["doc_id", "lang", "source"], ["lang", "source"])


_CARDS = """SELECT source, quality, doc_id, row_number() OVER (PARTITION BY source, quality ORDER BY d.doc_id) AS r FROM documents d JOIN labels USING (doc_id)"""


@query("review_cards", f"SELECT source, quality, doc_id, CAST(r AS BIGINT) AS place, CAST(greatest((SELECT count(*) FROM labels l2 JOIN documents d2 USING (doc_id) WHERE d2.source = c.source AND l2.quality = c.quality) - 3, 0) AS BIGINT) AS hidden FROM ({_CARDS}) c WHERE r <= 3")
def review_cards(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("source", "quality", "doc_id")
    hidden = rows.groupBy("source", "quality").agg(F.greatest(F.count("*") - 3, F.lit(0)).alias("hidden"))
    place = F.row_number().over(Window.partitionBy("source", "quality").orderBy("doc_id")).cast("long")
    return rows.withColumn("place", place).where("place <= 3").join(hidden, ["source", "quality"])


@query(
    "latest_conflicts",
    "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS actions FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1 HAVING count(DISTINCT event_type) > 1",
)
def latest_conflicts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error"))
    return rows.groupBy("user_id").agg(F.count_distinct("event_type").alias("actions")).where("actions > 1")


@query(
    "location_range",
    "SELECT s_nationkey, CAST(count(*) AS BIGINT) AS words, round(median(s_acctbal), 4) AS median_height, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier GROUP BY 1",
)
def location_range(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").groupBy("s_nationkey")
    return rows.agg(F.count("*").alias("words"), F.round(F.median("s_acctbal"), 4).alias("median_height"), F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))
