"""Catalog queries on the driver's tables: documents are files, lang their domain, source their project root."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import catalog
from ..operators.text_index import TextIndex
from ..operators.text_index import search as search_files
from ..registry import query
from ..sources.shared import shared_folder

IMPORTANT, CUES, TECHNICAL = ["that", "und", "para"], ["for", "die", "que"], ["###", " | "]
_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PRIORITY = (
    " + ".join(f"CASE WHEN contains(translate(text, {_ASCII}), '{w}') THEN 4 ELSE 0 END" for w in IMPORTANT)
    + " + " + " + ".join(f"CASE WHEN contains(translate(substr(text, 1, 12000), {_ASCII}), '{w}') THEN 5 ELSE 0 END" for w in CUES)
    + " + " + " + ".join(f"CASE WHEN contains(translate(text, {_ASCII}), '{w}') THEN -2 ELSE 0 END" for w in TECHNICAL)
    + " + CAST(least(length(regexp_replace(text, '[^\\p{L}]', '', 'g')), 500) // 100 AS INTEGER)"
)
_URL = "trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The index of the documents' texts, written once for each state of the table's files and kept in the shared folder."""
    files = f"{sf_dir}/documents.parquet"
    docs = read(spark, sf_dir, "documents")
    state = spark.read.format("binaryFile").load(files).select(F.to_json(F.struct("path", "length", "modificationTime")).alias("f")).orderBy("f").collect()  # one row a file, contents not read
    name = hashlib.sha256("\n".join(r["f"] for r in state).encode()).hexdigest()[:24]
    index = TextIndex(spark, f"{shared_folder(spark).rstrip('/')}/text-index-batched-{name}")
    if not index.exists():
        index.write(docs, "doc_id", "text")
    return index


_FOLDED = "strip_accents(lower(text))"
_HAS = "regexp_matches(strip_accents(lower(text)), '(^|[^\\p{L}\\p{N}])"


@query(
    "catalog_search_prefix",
    f"SELECT doc_id, lang, source, n_chars FROM documents WHERE {_HAS}threr') AND {_HAS}hand') AND translate(lang, {_ASCII}) = 'en'",
)
def catalog_search_prefix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    hits = text_index(spark, sf_dir).having_prefixes(["Threr", "hand"])
    return catalog.equal_filters(docs, {"lang": "EN"}).join(hits, F.col("doc_id") == F.col("doc"), "left_semi")


@query(
    "catalog_search_phrase",
    """WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' AS line FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda t: t <> '') AS t FROM benchmark)
    SELECT DISTINCT doc_id, item_id FROM b JOIN d ON contains(d.line, ' ' || array_to_string(b.t, ' ') || ' ') WHERE len(t) > 0""",
)
def catalog_search_phrase(spark, sf_dir):
    return text_index(spark, sf_dir).phrase_hits(read(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("doc").alias("doc_id"), "item_id")


@query(
    "catalog_search",
    f"""SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'de' AND n_chars >= 0
    AND (contains(translate(source, {_ASCII}), 'und ver') OR contains(translate(lang || '/' || source || '/' || doc_id, {_ASCII}), 'und ver') OR ({_HAS}und') AND {_HAS}ver')))""",
)
def catalog_search(spark, sf_dir):
    """Filters and the OR of name, path and full text in one call."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.concat_ws("/", "lang", "source", "doc_id").alias("path"))
    return search_files(docs, text_index(spark, sf_dir), "doc_id", "source", "path", "Und, ver", {"lang": "DE"}).select("doc_id", "lang", "source", "n_chars")


@query(
    "catalog_search_gram",
    f"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(translate(text, {_ASCII}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' AS line FROM documents),
    b AS (SELECT item_id, list_filter(string_split_regex(translate(text, {_ASCII}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS t FROM benchmark)
    SELECT DISTINCT doc_id, item_id FROM b JOIN d ON contains(d.line, ' ' || array_to_string(b.t, ' ') || ' ') WHERE len(t) > 0""",
)
def catalog_search_gram(spark, sf_dir):
    """Phrases without an index: documents' n-grams meet the phrases' first ones."""
    return catalog.phrase_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 8, "doc_id", "text", "item_id", "text")


@query("catalog_search_like", f"SELECT p_partkey, p_name FROM part WHERE contains(translate(p_name, {_ASCII}), 'ring')")
def catalog_search_like(spark, sf_dir):
    return read(spark, sf_dir, "part").where(text.like_literal(F.col("p_name"), "RING")).select("p_partkey", "p_name")


@query(
    "catalog_search_page",
    "SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25",
)
def catalog_search_page(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 25, 25)


@query(
    "search_semi_or",
    "SELECT doc_id, source FROM documents d WHERE n_chars > 5000 OR EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1)",
)
def search_semi_or(spark, sf_dir):
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("good", F.lit(True))
    return read(spark, sf_dir, "documents").join(good, "doc_id", "left").where("n_chars > 5000 OR good").select("doc_id", "source")


@query(
    "facets",
    """SELECT DISTINCT 'domain' AS facet, lang AS value FROM documents WHERE lang <> '' UNION ALL SELECT DISTINCT 'root', source FROM documents WHERE source <> ''
    UNION ALL SELECT DISTINCT 'year', CAST(year(o_orderdate) AS VARCHAR) FROM orders""",
)
def facets(spark, sf_dir):
    docs, orders = read(spark, sf_dir, "documents"), read(spark, sf_dir, "orders")
    return catalog.facets([("domain", docs, F.col("lang")), ("root", docs, F.col("source")), ("year", orders, F.year("o_orderdate"))])


@query(
    "folder_rollup_direct",
    """SELECT n_nationkey, n_name, CAST(count(c_custkey) AS BIGINT) AS files, CAST(coalesce(sum(CAST(c_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS bytes, max(c_name) AS last
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""",
)
def folder_rollup_direct(spark, sf_dir):
    files = read(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    rolled = catalog.rollup_direct(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), files, "n_nationkey", F.col("c_acctbal").cast("decimal(18,2)"), F.col("c_name"))
    return rolled.select("n_nationkey", "n_name", "files", F.col("bytes").cast("double").alias("bytes"), "last")


@query(
    "project_file_counts",
    """SELECT o_orderkey, o_orderstatus, CAST(count(l_orderkey) AS BIGINT) AS files, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS bytes
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def project_file_counts(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rolled = catalog.rollup_direct(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", F.col("l_quantity").cast("long"), F.col("l_shipdate"))
    return rolled.select("o_orderkey", "o_orderstatus", "files", "bytes")


@query(
    "folder_rollup_recursive",
    f"""WITH f AS (SELECT {_URL} AS path, strlen(html) AS size FROM pages),
    d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS folder FROM f, unnest(range(1, len(string_split(path, '/')))) AS t(n))
    SELECT folder, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM d JOIN f ON starts_with(path, folder || '/') GROUP BY 1""",
)
def folder_rollup_recursive(spark, sf_dir):
    return catalog.rollup_recursive(read(spark, sf_dir, "pages"), paths.url_path(F.col("url")), F.octet_length("html").cast("long"))


@query(
    "folder_details",
    """SELECT n_nationkey, n_name, CAST(count(s_suppkey) AS BIGINT) AS files, CAST(coalesce(sum(CAST(s_acctbal AS DECIMAL(18,2))), 0) AS DOUBLE) AS bytes, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS children
    FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2""",
)
def folder_details(spark, sf_dir):
    below = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(
        F.count("*").alias("files"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double").alias("bytes"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("children")
    )
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").join(below, "n_nationkey", "left")
    return rows.withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0.0)), "children": F.coalesce("children", F.lit(""))})


@query(
    "folder_tree",
    """WITH RECURSIVE folders AS (SELECT r_name AS path, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT r_name || '/' || n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, r_name || '/' || n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    tree AS (SELECT path, 0 AS depth FROM folders WHERE parent IS NULL UNION ALL SELECT f.path, depth + 1 FROM folders f JOIN tree t ON f.parent = t.path) SELECT path, depth FROM tree""",
)
def folder_tree(spark, sf_dir):
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    second = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("r_name").alias("parent"))
    third = supplier.join(second, supplier.s_nationkey == second.n_nationkey).select(F.concat_ws("/", "path", "s_name").alias("path"), F.col("path").alias("parent"))
    folders = region.select(F.col("r_name").alias("path"), F.lit(None).cast("string").alias("parent")).unionByName(second.select("path", "parent")).unionByName(third)
    return spark.sql(
        """WITH RECURSIVE tree AS (SELECT path, 0 AS depth FROM {folders} WHERE parent IS NULL UNION ALL SELECT f.path, depth + 1 FROM {folders} f JOIN tree t ON f.parent = t.path)
        SELECT path, depth FROM tree""",
        folders=folders,
    )


@query(
    "path_dimensions",
    f"""SELECT page_id, coalesce(string_split({_URL}, '/')[1], '') AS domain_folder, coalesce(string_split({_URL}, '/')[2], '') AS time_bucket, coalesce(string_split({_URL}, '/')[3], '') AS project_name FROM pages""",
)
def path_dimensions(spark, sf_dir):
    path = paths.url_path(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", paths.segment(path, 1).alias("domain_folder"), paths.segment(path, 2).alias("time_bucket"), paths.segment(path, 3).alias("project_name"))


@query(
    "project_roots",
    """SELECT o_orderkey, o_orderpriority || '/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || c_name AS path, CAST(year(o_orderdate) AS VARCHAR) AS year, c_name AS customer
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) >= 1996""",
)
def project_roots(spark, sf_dir):
    path = F.concat_ws("/", "o_orderpriority", F.year("o_orderdate").cast("string"), "c_name")
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", path.alias("path"))
    rows = rows.withColumn("root", paths.classify_root(F.col("path"), 1996)).where("root IS NOT NULL")
    return rows.select("o_orderkey", "path", "root.year", "root.customer")


def _ranked(spark, sf_dir, skip):
    docs = read(spark, sf_dir, "documents")
    files = docs.select("doc_id", "source", "n_chars", text.priority(F.col("text"), IMPORTANT, CUES, TECHNICAL).alias("priority"))
    content = docs.select("doc_id", "text")
    best = catalog.ranked_evidence(files, content, "doc_id", "source", [F.desc("priority"), F.desc("n_chars"), F.col("doc_id")], 24, skip)
    return best.select("source", "doc_id", "priority", F.col("rank").cast("long").alias("rank"), F.md5("text").alias("content"))


_RANKED = f"""SELECT source, doc_id, priority, CAST(rank AS BIGINT) AS rank, content FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY priority DESC, n_chars DESC, doc_id) AS rank
    FROM (SELECT doc_id, source, n_chars, md5(text) AS content, {_PRIORITY} AS priority FROM documents)) WHERE rank > {{0}} AND rank <= {{0}} + 24"""


@query("ranked_evidence", _RANKED.replace("{0}", "0"))
def ranked_evidence(spark, sf_dir):
    return _ranked(spark, sf_dir, 0)


@query("ranked_evidence_page2", _RANKED.replace("{0}", "24"))
def ranked_evidence_page2(spark, sf_dir):
    return _ranked(spark, sf_dir, 24)


@query("document_priority", f"SELECT doc_id, {_PRIORITY} AS priority FROM documents")
def document_priority(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.priority(F.col("text"), IMPORTANT, CUES, TECHNICAL).alias("priority"))


_STATUS = "CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'ok' ELSE 'partial' END"
_REASON = "CASE WHEN l.doc_id IS NULL THEN 'not_processed' WHEN toxic = 1 THEN 'review' ELSE '' END"


def _coverage(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels").withColumn("there", F.lit(1))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("quality") == 1, "ok").otherwise("partial")
    reason = F.when(F.col("there").isNull(), "not_processed").when(F.col("toxic") == 1, "review").otherwise("")
    return catalog.coverage(docs, docs.join(labels, "doc_id", "left"), "source", status, reason)


@query("coverage", f"SELECT source, {_STATUS} AS status, {_REASON} AS reason, CAST(count(*) AS BIGINT) AS files FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2, 3")
def coverage(spark, sf_dir):
    return _coverage(spark, sf_dir)


@query(
    "coverage_maps",
    f"""WITH c AS (SELECT source, {_STATUS} AS status, {_REASON} AS reason, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2, 3),
    s AS (SELECT source, string_agg(status || '=' || n, ',' ORDER BY status) AS by_status FROM (SELECT source, status, sum(n) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT source, string_agg(reason || '=' || n, ',' ORDER BY reason) AS by_reason FROM (SELECT source, reason, sum(n) AS n FROM c WHERE reason <> '' GROUP BY 1, 2) GROUP BY 1)
    SELECT s.source, by_status, coalesce(by_reason, '') AS by_reason FROM s LEFT JOIN r ON r.source = s.source""",
)
def coverage_maps(spark, sf_dir):
    line = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return catalog.coverage_maps(_coverage(spark, sf_dir), "source").select("source", line("by_status").alias("by_status"), line("by_reason").alias("by_reason"))


@query("source_states", f"SELECT d.doc_id, source, {_STATUS} AS status FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def source_states(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").withColumn("there", F.lit(1))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("quality") == 1, "ok").otherwise("partial")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", "source", status.alias("status"))


@query(
    "reason_merge",
    """SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS reasons FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
)
def reason_merge(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy("user_id", "event_type").count()
    entries = F.transform(F.sort_array(F.collect_list(F.struct("event_type", "count"))), lambda e: F.concat(e["event_type"], F.lit("="), e["count"].cast("string")))
    return counts.groupBy("user_id").agg(F.array_join(entries, ",").alias("reasons"))


def _records(spark, sf_dir):
    part, customer, supplier, nation = (read(spark, sf_dir, t) for t in ("part", "customer", "supplier", "nation"))
    return (
        part.select(F.lit("document").alias("kind"), F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.concat_ws(" · ", "p_brand", "p_type").alias("subtitle"))
        .unionByName(customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("subtitle")))
        .unionByName(supplier.select(F.lit("project").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("title"), F.lit("").alias("subtitle")))
        .unionByName(nation.select(F.lit("folder").alias("kind"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("title"), F.lit("").alias("subtitle")))
    )


_RECORDS = """SELECT 'document' AS kind, p_partkey AS key, p_name AS title, p_brand || ' · ' || p_type AS subtitle FROM part UNION ALL SELECT 'customer', c_custkey, c_name, c_mktsegment FROM customer
    UNION ALL SELECT 'project', s_suppkey, s_name, '' FROM supplier UNION ALL SELECT 'folder', n_nationkey, n_name, '' FROM nation"""
_NEEDLE = f"contains(translate(title, {_ASCII}), 'red') OR contains(translate(subtitle, {_ASCII}), 'red')"
_RANK = f"CASE WHEN translate(title, {_ASCII}) = 'red' THEN 0 WHEN starts_with(translate(title, {_ASCII}), 'red') THEN 1 WHEN contains(translate(title, {_ASCII}), 'red') THEN 2 WHEN contains(translate(subtitle, {_ASCII}), 'red') THEN 3 ELSE 4 END"


def _hits(spark, sf_dir, needle):
    rows = _records(spark, sf_dir)
    return rows.where(text.like_literal(F.col("title"), needle) | text.like_literal(F.col("subtitle"), needle))


@query("global_search", f"SELECT kind, key, title, rank FROM (SELECT *, {_RANK} AS rank FROM ({_RECORDS})) WHERE {_NEEDLE} ORDER BY rank, kind, title, key LIMIT 50")
def global_search(spark, sf_dir):
    rows = _hits(spark, sf_dir, "red").withColumn("rank", catalog.relevance(F.col("title"), F.col("subtitle"), "red"))
    return catalog.page(rows.select("kind", "key", "title", "rank"), [F.col("rank"), F.col("kind"), F.col("title"), F.col("key")], 50)


@query(
    "kind_counts",
    f"SELECT k.kind, CAST(count(r.kind) AS BIGINT) AS n FROM (VALUES ('document'), ('folder'), ('project'), ('customer')) k(kind) LEFT JOIN (SELECT * FROM ({_RECORDS}) WHERE {_NEEDLE}) r ON r.kind = k.kind GROUP BY 1",
)
def kind_counts(spark, sf_dir):
    return catalog.kind_counts(_hits(spark, sf_dir, "red"), ["document", "folder", "project", "customer"])


@query(
    "app_statistics",
    """SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM orders) AS projects, (SELECT CAST(count(DISTINCT o_orderpriority) AS BIGINT) FROM orders) AS services,
    (SELECT count(*) FROM lineitem) AS files, (SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) FROM lineitem) AS bytes""",
)
def app_statistics(spark, sf_dir):
    customers = read(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    projects = read(spark, sf_dir, "orders").agg(F.count("*").alias("projects"), F.count_distinct("o_orderpriority").alias("services"))
    files = read(spark, sf_dir, "lineitem").agg(F.count("*").alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))
    one = F.lit(1).alias("one")
    return customers.select("*", one).join(projects.select("*", one), "one").join(files.select("*", one), "one").drop("one")


@query(
    "tree_prune",
    f"""WITH f AS (SELECT DISTINCT {_URL} AS path FROM pages), d AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS folder FROM f, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(n))
    SELECT folder FROM d WHERE EXISTS (SELECT 1 FROM d m WHERE contains(m.folder, '/fr') AND (m.folder = d.folder OR starts_with(m.folder, d.folder || '/')))""",
)
def tree_prune(spark, sf_dir):
    path = paths.url_path(F.col("url"))
    folders = read(spark, sf_dir, "pages").select(F.explode(F.concat(paths.ancestors(path), F.array(path))).alias("folder")).distinct()
    return catalog.prune_tree(folders, "folder", F.col("folder").contains("/fr"))
