"""Suggestion, case and customer queries on the driver's tables: events are evidence, mutations and decisions; orders are suggestions or projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import customers, incremental, suggestions
from ..registry import query
from .catalog import read


@query(
    "visible_suggestions",
    """SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0 AND (o_orderstatus <> 'O' OR o_totalprice > 100000) AND o_orderpriority <> '5-LOW'""",
)
def visible_suggestions(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected")
    rows = read(spark, sf_dir, "orders").withColumns({
        "status": status, "lifecycle": F.when(F.col("o_totalprice") > 100000, "active").otherwise("stale"), "superseded_by": F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 1),
        "kind": F.when(F.col("o_orderpriority") == "5-LOW", "address_group").otherwise("field"),
    })
    return suggestions.visible(rows, groups=False).select("o_orderkey")


@query(
    "suggestion_upsert",
    """WITH k AS (SELECT user_id, CASE WHEN max(value) > 40 THEN 0 ELSE 1 END AS r, count(DISTINCT event_type) AS n, CASE WHEN user_id % 3 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM events WHERE event_type IN ('view', 'click') AND user_id % 4 > 0 GROUP BY 1),
    e AS (SELECT user_id, min(CASE WHEN value > 60 THEN 0 WHEN value > 20 THEN 1 ELSE 2 END) AS r, count(DISTINCT event_type) AS n FROM events WHERE event_type NOT IN ('view', 'click') GROUP BY 1),
    j AS (SELECT coalesce(k.user_id, e.user_id) AS user_id, k.r AS was, k.n AS had, k.status, least(coalesce(k.r, e.r), coalesce(e.r, k.r)) AS r, greatest(coalesce(k.n, 0), coalesce(e.n, 0)) AS n FROM k FULL OUTER JOIN e ON k.user_id = e.user_id)
    SELECT user_id, CASE r WHEN 0 THEN 'strong' WHEN 1 THEN 'review' ELSE 'other' END AS quality, CAST(n AS BIGINT) AS sources, coalesce(status, 'pending') AS status, CAST(CASE WHEN was IS NULL THEN 1 WHEN r <> was OR n <> had THEN 2 ELSE 1 END AS BIGINT) AS revision FROM j""",
)
def suggestion_upsert(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    early = F.col("event_type").isin("view", "click")
    known = events.where(early & (F.col("user_id") % 4 > 0)).groupBy("user_id").agg(F.when(F.max("value") > 40, "strong").otherwise("review").alias("quality"), F.count_distinct("event_type").alias("sources"))
    known = known.withColumns({"status": F.when(F.col("user_id") % 3 == 0, "accepted").otherwise("pending"), "revision": F.lit(1).cast("long")})
    quality = F.when(F.col("value") > 60, "strong").when(F.col("value") > 20, "review").otherwise("other")
    return suggestions.upsert(known, events.where(~early).select("user_id", quality.alias("quality"), F.col("event_type").alias("source")), ["user_id"])


@query(
    "unique_match",
    """SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM (SELECT DISTINCT c_nationkey, c_mktsegment, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 350000)
    GROUP BY 1, 2 HAVING count(*) = 1""",
)
def unique_match(spark, sf_dir):
    active = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 350000)
    evidence = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), active.alias("active"))
    return suggestions.unique_match(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), evidence, "c_custkey", ["c_nationkey", "c_mktsegment"])


@query(
    "run_finalised",
    """WITH e AS (SELECT o_custkey, o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') AND NOT (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice < 300000) AS active FROM orders)
    SELECT o_custkey FROM e GROUP BY 1 HAVING NOT bool_or(active)""",
)
def run_finalised(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    evidence = orders.select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderstatus") != "P").alias("active"))
    existing = read(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey"))
    return suggestions.finalise(evidence, F.col("o_totalprice") >= 300000, orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH')"), existing, "o_custkey", "o_orderkey")[1]


_STATUS = "CASE WHEN value > 55 THEN 'accepted' WHEN value > 50 THEN 'rejected' ELSE 'pending' END"


@query(
    "duplicate_absorption",
    f"""WITH s AS (SELECT user_id, event_type, event_id, {_STATUS} AS status FROM events), w AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN status = 'pending' THEN 1 ELSE 0 END, event_id) AS winner FROM s)
    SELECT event_id, user_id, event_type, status, CASE WHEN winner <> event_id THEN winner END AS superseded_by FROM w""",
)
def duplicate_absorption(spark, sf_dir):
    rows = read(spark, sf_dir, "events").selectExpr("user_id", "event_type", "event_id", f"{_STATUS} AS status")
    return suggestions.absorb(rows, ["user_id", "event_type"], "status", "event_id")


@query(
    "suggestion_decisions",
    """WITH d AS (SELECT user_id, event_id, event_id % 3 AS rev, CASE event_type WHEN 'purchase' THEN 'accept' ELSE 'reject' END AS action FROM events WHERE event_type IN ('purchase', 'error')),
    o AS (SELECT d.user_id AS c_custkey, d.event_id, d.action, CASE WHEN c_nationkey % 4 = 0 THEN 'accepted' WHEN c_nationkey IS NOT NULL THEN 'pending' END AS status, CASE d.action WHEN 'accept' THEN 'accepted' ELSE 'rejected' END AS goal, c_custkey % 3 AS cur, d.rev, c_mktsegment FROM d LEFT JOIN customer ON c_custkey = d.user_id),
    r AS (SELECT *, CASE WHEN status IS NULL THEN 'unknown' WHEN status = goal THEN 'repeated' WHEN cur <> rev THEN 'stale' WHEN action = 'accept' AND c_mktsegment <> 'BUILDING' THEN 'conflict' ELSE 'applied' END AS outcome FROM o)
    SELECT c_custkey, action, outcome, CASE WHEN outcome = 'applied' THEN goal ELSE status END AS status FROM r""",
)
def suggestion_decisions(spark, sf_dir):
    events = read(spark, sf_dir, "events").where("event_type IN ('purchase', 'error')")
    decisions = events.select(F.col("user_id").alias("c_custkey"), (F.col("event_id") % 3).alias("revision"), F.when(F.col("event_type") == "purchase", "accept").otherwise("reject").alias("action"), F.lit("BUILDING").alias("value"))
    found = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("revision"), F.when(F.col("c_nationkey") % 4 == 0, "accepted").otherwise("pending").alias("status"), F.col("c_mktsegment").alias("current"))
    return suggestions.decide(found, decisions, "c_custkey")


@query(
    "pending_revalidation",
    r"""SELECT p_partkey, CASE WHEN p_size > 10 THEN trim(regexp_replace(lower(p_name), '[^\p{L}\p{N}_]+', ' ', 'g')) ELSE '' END AS value, CASE WHEN p_size > 10 THEN 'active' ELSE 'invalid' END AS lifecycle FROM part""",
)
def pending_revalidation(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.lit("active").alias("lifecycle"))
    return suggestions.revalidate(rows, F.when(F.col("p_size") > 10, text.identity_key(F.col("p_name"))).otherwise("")).select("p_partkey", "value", "lifecycle")


_RANK = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END"


@query("top_evidence", f"SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_RANK}, o_orderkey) AS r FROM orders) WHERE r <= 5")
def top_evidence(spark, sf_dir):
    quality = F.when(F.col("o_orderpriority") == "1-URGENT", "strong").when(F.col("o_orderpriority") == "2-HIGH", "review").otherwise("other")
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", quality.alias("quality"))
    return suggestions.top_evidence(rows, "o_custkey", "quality", "o_orderkey", 5).select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


_ACTIONS = "CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'signup' THEN 'assign' ELSE 'reject' END"


@query(
    "case_status",
    f"""WITH d AS (SELECT user_id, ts, event_id, {_ACTIONS} AS action FROM events WHERE event_type IN ('purchase', 'signup', 'error') AND value > 45),
    f AS (SELECT user_id, arg_min(action, (ts, event_id)) AS first, count(DISTINCT action) > 1 AS conflict FROM d GROUP BY 1), c AS (SELECT DISTINCT user_id FROM events)
    SELECT c.user_id, CASE WHEN first IS NULL THEN 'pending' WHEN first = 'reject' THEN 'rejected' ELSE 'resolved' END AS status, coalesce(conflict, false) AS conflict FROM c LEFT JOIN f ON f.user_id = c.user_id""",
)
def case_status(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    decisions = events.where("event_type IN ('purchase', 'signup', 'error') AND value > 45").selectExpr("user_id", "ts", "event_id", f"{_ACTIONS} AS action")
    return suggestions.case_status(events.select("user_id").distinct(), decisions, "user_id", ["ts", "event_id"])


@query(
    "case_upsert",
    """SELECT o_orderkey, CASE WHEN k.status IN ('resolved', 'rejected') THEN k.status ELSE 'pending' END AS status FROM orders LEFT JOIN
    (SELECT l_orderkey, CASE WHEN max(l_returnflag) = 'R' THEN 'rejected' WHEN min(l_returnflag) = 'N' THEN 'resolved' ELSE 'pending' END AS status FROM lineitem GROUP BY 1) k ON l_orderkey = o_orderkey""",
)
def case_upsert(spark, sf_dir):
    status = F.when(F.max("l_returnflag") == "R", "rejected").when(F.min("l_returnflag") == "N", "resolved").otherwise("pending")
    known = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(status.alias("status"))
    return suggestions.keep_decided(known, read(spark, sf_dir, "orders").select("o_orderkey", F.lit("pending").alias("status")), "o_orderkey")


@query(
    "recognition_state",
    """WITH l AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS p, count(l_orderkey) AS d, count(*) FILTER (l_returnflag <> 'R') AS s, count(*) FILTER (l_linestatus = 'F') AS r, count(*) FILTER (l_discount > 0.09) AS f, count(*) FILTER (l_quantity > 49) AS c FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'disabled' WHEN coalesce(p, 0) = 0 THEN 'no_projects' WHEN d = 0 THEN 'no_documents' WHEN s = 0 THEN 'unsupported' WHEN r = 0 THEN 'no_text' WHEN f > 0 THEN 'partial' WHEN c > 0 THEN 'review' ELSE 'no_candidates' END AS state FROM customer LEFT JOIN l ON o_custkey = c_custkey""",
)
def recognition_state(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("d"), F.count_if(F.col("l_returnflag") != "R").alias("s"), F.count_if(F.col("l_linestatus") == "F").alias("r"), F.count_if(F.col("l_discount") > 0.09).alias("f"), F.count_if(F.col("l_quantity") > 49).alias("c")
    )
    sums = read(spark, sf_dir, "orders").join(per, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("p"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "dsrfc"])
    rows = read(spark, sf_dir, "customer").join(sums, "c_custkey", "left").fillna(0, ["p", "d", "s", "r", "f", "c"])
    return rows.select("c_custkey", suggestions.recognition_state(F.col("c_acctbal") >= 0, *[F.col(x) for x in "pdsrfc"]).alias("state"))


@query("candidate_key", """SELECT p_partkey, sha256('["' || p_brand || '","' || p_type || '","' || p_name || '","' || p_size || '"]') AS key FROM part""")
def candidate_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", suggestions.candidate_key(F.col("p_brand"), F.col("p_type"), F.col("p_name"), F.col("p_size")).alias("key"))


@query(
    "canonical_payload",
    """SELECT p_partkey, '{"brand":"' || lower(p_brand) || CASE WHEN p_size > 25 THEN '","kind":"' || lower(p_type) ELSE '' END || '","name":"' || lower(p_name) || '"}' AS payload FROM part""",
)
def canonical_payload(spark, sf_dir):
    payload = F.create_map(
        F.lit("name"), F.concat(F.lit(" "), "p_name"), F.lit("kind"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""), F.lit("id"), F.col("p_partkey").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("address_kind"), F.lit("foreign"),
    )
    return read(spark, sf_dir, "part").select("p_partkey", suggestions.canonical_payload(payload).alias("payload"))


@query("json_field", "SELECT json_extract_string(props, '$.k') AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


_LAST = "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1"


@query(
    "revision_swap",
    f"""WITH c AS (SELECT l.user_id, event_type AS value, l.event_id % 3 AS revision FROM ({_LAST}) l JOIN events USING (event_id)), k AS (SELECT c_custkey, c_mktsegment AS value, c_nationkey % 3 AS revision FROM customer WHERE c_custkey % 5 > 0),
    j AS (SELECT coalesce(c_custkey, user_id) AS c_custkey, k.value AS v, k.revision AS r, c.value AS w, c.revision AS s, CASE WHEN c.revision IS NULL THEN 'kept' WHEN k.revision IS NULL AND c.revision = 0 THEN 'created' WHEN k.revision IS NULL THEN 'unknown' WHEN k.revision = c.revision THEN 'updated' ELSE 'conflict' END AS outcome FROM k FULL OUTER JOIN c ON user_id = c_custkey)
    SELECT c_custkey, CASE WHEN outcome IN ('created', 'updated') THEN w ELSE v END AS value, CASE WHEN outcome IN ('created', 'updated') THEN coalesce(r, 0) + 1 ELSE r END AS revision, outcome FROM j""",
)
def revision_swap(spark, sf_dir):
    last = incremental.latest(read(spark, sf_dir, "events"), "user_id", [F.desc("event_id")])
    changes = last.select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("value"), (F.col("event_id") % 3).cast("int").alias("revision"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select("c_custkey", F.col("c_mktsegment").alias("value"), (F.col("c_nationkey") % 3).alias("revision"))
    return customers.compare_and_swap(known, changes, "c_custkey")


@query(
    "insert_or_ignore",
    "SELECT c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) UNION SELECT DISTINCT CAST(user_id % 25 AS INTEGER), event_type FROM events",
)
def insert_or_ignore(spark, sf_dir):
    known = read(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 25).cast("int").alias("c_nationkey"), F.col("event_type").alias("c_mktsegment"))
    return customers.insert_or_ignore(known, rows, ["c_nationkey", "c_mktsegment"])


@query(
    "cache_attempts",
    """SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, CASE WHEN l.quality = 1 OR d.doc_id IS NULL THEN CASE WHEN l.quality = 1 THEN 'ok' ELSE 'error' END WHEN d.n_chars > 500 THEN 'ok' ELSE 'partial' END AS status,
    CAST(CASE WHEN l.quality = 1 OR d.doc_id IS NULL THEN l.toxic + 1 ELSE coalesce(l.toxic + 1, 0) + 1 END AS BIGINT) AS attempts FROM labels l FULL OUTER JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) d ON l.doc_id = d.doc_id""",
)
def cache_attempts(spark, sf_dir):
    known = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"), (F.col("toxic") + 1).cast("long").alias("attempts"))
    results = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", F.when(F.col("n_chars") > 500, "ok").otherwise("partial").alias("status"))
    return customers.put_attempts(known, results, "doc_id")


@query(
    "classification_fill",
    "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN 'good' END, lang) AS lang, coalesce(CASE WHEN toxic = 1 THEN 'masked' END, source) AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def classification_fill(spark, sf_dir):
    update = read(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), F.when(F.col("toxic") == 1, "masked").alias("source"))
    return customers.fill_columns(read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), update, "doc_id", ["lang", "source"])


@query(
    "contact_matching",
    """WITH k AS (SELECT p_size AS owner, p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN p_brand END AS uid, p_name AS name, p_type AS mail FROM part),
    g AS (SELECT p_size AS owner, p_partkey AS place, CASE WHEN p_partkey % 5 = 0 THEN p_brand END AS uid, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'none' END AS mail FROM part WHERE p_partkey % 3 = 0),
    a AS (SELECT owner, uid, min(id) AS id FROM k WHERE uid IS NOT NULL GROUP BY 1, 2), b AS (SELECT owner, name, mail, min(id) AS id FROM k GROUP BY 1, 2, 3),
    c AS (SELECT owner, name, min(id) AS id FROM k GROUP BY 1, 2 HAVING count(*) = 1), o AS (SELECT owner, name FROM g GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT g.place, coalesce(a.id, b.id, CASE WHEN o.name IS NOT NULL THEN c.id END) AS id FROM g LEFT JOIN a ON a.owner = g.owner AND a.uid = g.uid LEFT JOIN b ON b.owner = g.owner AND b.name = g.name AND b.mail = g.mail LEFT JOIN c ON c.owner = g.owner AND c.name = g.name LEFT JOIN o ON o.owner = g.owner AND o.name = g.name""",
)
def contact_matching(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumnsRenamed({"p_size": "owner", "p_name": "name"})
    known = part.select("owner", F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, F.col("p_brand")).alias("uid"), "name", F.col("p_type").alias("mail"))
    given = part.where("p_partkey % 3 = 0").select("owner", F.col("p_partkey").alias("place"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).alias("uid"), "name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise("none").alias("mail"))
    return customers.match_contacts(known, given, "owner").select("place", "id")


@query(
    "project_owners",
    """SELECT o_orderkey, coalesce(k.owner, o_custkey) AS owner, CASE WHEN k.owner IS NULL THEN 'assigned' WHEN k.owner = o_custkey THEN 'kept' ELSE 'conflict' END AS outcome
    FROM orders LEFT JOIN (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN max(l_suppkey) ELSE max(o_custkey) END AS owner FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY 1) k ON l_orderkey = o_orderkey""",
)
def project_owners(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("owner"))
    items = read(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(orders, "o_orderkey")
    owners = items.groupBy("o_orderkey").agg(F.when(F.col("o_orderkey") % 2 == 0, F.max("l_suppkey")).otherwise(F.max("owner")).alias("owner"))
    return customers.assign_owners(owners, orders, "o_orderkey")


@query(
    "provenance_records",
    """SELECT coalesce(k.user_id, e.user_id) AS user_id, coalesce(k.event_type, e.event_type) AS event_type, coalesce(e.value, k.value) AS value FROM
    (SELECT user_id, event_type, max(event_id) AS value FROM events WHERE value < 20 GROUP BY 1, 2) k FULL OUTER JOIN (SELECT user_id, event_type, arg_max(event_id, ts) AS value FROM events WHERE value >= 20 GROUP BY 1, 2) e ON k.user_id = e.user_id AND k.event_type = e.event_type""",
)
def provenance_records(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    known = events.where("value < 20").groupBy("user_id", "event_type").agg(F.max("event_id").alias("value"))
    return customers.provenance(known, events.where("value >= 20").select("user_id", "event_type", F.col("event_id").alias("value"), "ts"), ["user_id", "event_type"], F.col("ts"))


@query(
    "outbox_conflicts",
    """WITH e AS (SELECT *, event_type = 'error' AND value > 20 AS bad FROM events), f AS (SELECT user_id, min(event_id) AS head FROM e WHERE bad GROUP BY 1)
    SELECT event_id, e.user_id, CASE WHEN event_id > head THEN 'waiting' WHEN bad THEN 'conflict' ELSE 'applied' END AS outcome FROM e LEFT JOIN f ON f.user_id = e.user_id""",
)
def outbox_conflicts(spark, sf_dir):
    bad = (F.col("event_type") == "error") & (F.col("value") > 20)
    return customers.replay_outbox(read(spark, sf_dir, "events"), "user_id", "event_id", bad).select("event_id", "user_id", "outcome")


@query("outbox_remap", "SELECT event_id, coalesce(c_custkey + 1000000, user_id) AS user_id FROM events LEFT JOIN customer ON c_custkey = user_id AND c_nationkey < 9")
def outbox_remap(spark, sf_dir):
    mapping = read(spark, sf_dir, "customer").where("c_nationkey < 9").select(F.col("c_custkey").alias("local"), (F.col("c_custkey") + 1000000).alias("id"))
    return customers.remap(read(spark, sf_dir, "events").select("event_id", "user_id"), mapping, "user_id")


@query("overlay_reconcile", "SELECT user_id, revision FROM (SELECT user_id, max(event_id) % 100 AS revision FROM events GROUP BY 1) LEFT JOIN customer ON c_custkey = user_id WHERE c_custkey IS NULL OR c_nationkey * 4 < revision")
def overlay_reconcile(spark, sf_dir):
    overlay = read(spark, sf_dir, "events").groupBy("user_id").agg((F.max("event_id") % 100).alias("revision"))
    snapshot = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") * 4).alias("revision"))
    return customers.reconcile_overlay(overlay, snapshot, "user_id")


@query(
    "id_high_water",
    """SELECT o_orderpriority, CAST(greatest(coalesce(a, 0), coalesce(b, 0)) AS BIGINT) AS high FROM (SELECT o_orderpriority, max(o_orderkey) FILTER (o_orderstatus = 'F') AS a, max(o_orderkey) FILTER (o_orderstatus = 'O') AS b FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)""",
)
def id_high_water(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    stored = orders.where("o_orderstatus = 'F'").groupBy("o_orderpriority").agg(F.max("o_orderkey").alias("high"))
    return customers.high_water(stored, orders.where("o_orderstatus = 'O'"), "o_orderpriority", "o_orderkey")


@query("bytes_used", "SELECT lang, CAST(sum(strlen(text) + strlen(source)) AS BIGINT) AS bytes FROM documents GROUP BY 1")
def bytes_used(spark, sf_dir):
    return customers.bytes_used(read(spark, sf_dir, "documents"), ["lang"], "text", "source")


@query(
    "run_counters",
    """SELECT lang, CAST(count(*) AS BIGINT) AS discovered, CAST(count(quality) AS BIGINT) AS processed, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS reused, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS failed FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1""",
)
def run_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return customers.run_counters(rows, ["lang"], processed=F.col("quality").isNotNull(), reused=F.col("quality") == 1, failed=F.col("toxic") == 1)


@query(
    "coverage_problems",
    "SELECT source, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (quality IS NULL OR (quality = 0 AND toxic = 1)) AS BIGINT) AS problems FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1",
)
def coverage_problems(spark, sf_dir):
    status = F.when(F.col("quality") == 1, "ok").when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "unsupported")
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return customers.problems(rows.groupBy("source", status.alias("status")).agg(F.count("*").alias("files")), "source")


@query("verification_due", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-02 00:00:00' - INTERVAL 24 HOUR")
def verification_due(spark, sf_dir):
    return customers.verification_due(read(spark, sf_dir, "orders"), "o_orderdate", F.lit("1996-01-02 00:00:00").cast("timestamp_ntz")).select("o_orderkey")


@query("backups_per_component", "SELECT l_shipdate, CAST(greatest(count(*) - 1, 0) AS BIGINT) AS backups FROM lineitem GROUP BY 1")
def backups_per_component(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("backups"))


@query(
    "hits_with_local",
    """WITH h AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000), t AS (SELECT c_custkey, c_name FROM customer JOIN h ON o_custkey = c_custkey),
    l AS (SELECT DISTINCT user_id AS c_custkey, 'local ' || user_id AS c_name FROM events) SELECT * FROM t UNION ALL SELECT * FROM l WHERE c_custkey NOT IN (SELECT c_custkey FROM t)""",
)
def hits_with_local(spark, sf_dir):
    hits = read(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    local = read(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), F.concat(F.lit("local "), F.col("user_id").cast("string")).alias("c_name")).distinct()
    return customers.with_local(hits, read(spark, sf_dir, "customer").select("c_custkey", "c_name"), local, "c_custkey")


@query("protected_references", "SELECT o_orderkey AS ref FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT event_id FROM events")
def protected_references(spark, sf_dir):
    kept = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ref"))
    other = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("ref"))
    return kept.unionByName(other).unionByName(read(spark, sf_dir, "events").select(F.col("event_id").alias("ref"))).distinct()
