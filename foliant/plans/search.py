"""Search, sort and listing queries, and the facts of documents, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import blocks, catalog, search
from ..registry import query
from ..sources.shared import spread
from .catalog import read

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("search_page_total", "SELECT doc_id, source, n_chars, CAST((SELECT count(*) FROM documents WHERE lang = 'en') AS BIGINT) AS total FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, source, doc_id LIMIT 20 OFFSET 10")
def search_page_total(spark, sf_dir):
    rows = catalog.equal_filters(read(spark, sf_dir, "documents"), {"lang": "EN"}).select("doc_id", "source", "n_chars")
    return search.page_with_total(rows, search.sort_order("size", "source", "n_chars", "n_chars", "doc_id"), 20, 10)


@query("search_sort_name", f"SELECT p_partkey, p_name FROM part ORDER BY {_FOLD.format('p_name')}, p_partkey LIMIT 50")
def search_sort_name(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "part").select("p_partkey", "p_name"), search.sort_order("name", "p_name", "p_size", "p_size", "p_partkey"), 50)


@query("search_sort_modified", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, lower(o_orderpriority), o_orderkey LIMIT 50")
def search_sort_modified(spark, sf_dir):
    return catalog.page(read(spark, sf_dir, "orders"), search.sort_order("modified", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey"), 50).select("o_orderkey", "o_orderdate")


@query(
    "client_search",
    f"""SELECT p_partkey FROM part WHERE (contains({_FOLD.format("p_name")}, 'ring') OR contains({_FOLD.format("p_brand")}, 'd#1') OR contains({_FOLD.format("p_type")}, 'ring')) AND p_size > 5""",
)
def client_search(spark, sf_dir):
    found = read(spark, sf_dir, "part").where(search.any_contains("RING", "p_name", "p_type") | search.any_contains("d#1", "p_brand"))
    return found.where("p_size > 5").select("p_partkey")


@query("year_facets", "SELECT value FROM (SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS value FROM orders UNION SELECT DISTINCT o_orderstatus FROM orders) ORDER BY regexp_full_match(value, '[0-9]+') DESC, value DESC LIMIT 5")
def year_facets(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    values = orders.select(F.year("o_orderdate").cast("string").alias("value")).unionByName(orders.select(F.col("o_orderstatus").alias("value"))).distinct()
    return catalog.page(values, search.year_order(F.col("value")), 5)


@query("gated_search", "SELECT 'file' AS kind, CAST(doc_id AS VARCHAR) AS key FROM documents WHERE lang = 'de' UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING'")
def gated_search(spark, sf_dir):
    key = lambda c: F.col(c).cast("string").alias("key")
    records = {
        "file": read(spark, sf_dir, "documents").where("lang = 'de'").select(key("doc_id")), "folder": read(spark, sf_dir, "region").select(key("r_regionkey")), "project": read(spark, sf_dir, "orders").select(key("o_orderkey")),
        "customer": read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(key("c_custkey")),
    }
    gates = {"folder": ("file_type",), "project": ("file_type",), "customer": ("source", "domain", "year")}
    return search.gated(records, {"file_type": "txt", "source": None}, gates)


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query("folder_filter", f"SELECT page_id FROM pages WHERE list_contains(string_split({_PATH}, '/'), 'en') AND contains({_FOLD.format(_PATH)}, 'example.org')")
def folder_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return search.folder_filter(rows, "path", "en", "Example.ORG").select("page_id")


@query("project_filter", "SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = 1996 AND contains(lower(c_name), '#00000000') AND lower(c_mktsegment) = 'building'")
def project_filter(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.select("o_orderkey", F.year("o_orderdate").alias("year"), F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("domain"))
    return search.project_filter(rows, "1996", "#00000000", "Building").select("o_orderkey")


@query("file_types", "SELECT DISTINCT lower(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), regexp_extract(source || '.Src' || doc_id % 4, '\\.([^./]+)$', 1))) AS type FROM documents")
def file_types(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("kind"), F.concat(F.col("source"), F.lit(".Src"), (F.col("doc_id") % 4).cast("string")).alias("name"))
    return rows.select(search.file_type(F.col("kind"), F.col("name")).alias("type")).distinct()


@query("filter_files", f"SELECT p_partkey FROM part WHERE (contains({_FOLD.format('p_name')}, 'bolt') OR contains({_FOLD.format('p_brand')}, 'bolt')) AND lower(p_type) = 'economy'")
def filter_files(spark, sf_dir):
    return search.filter_files(read(spark, sf_dir, "part"), "BOLT", "Economy", "p_name", "p_brand", "p_type").select("p_partkey")


@query("merged_files", "SELECT path, min(size) AS size FROM (SELECT p_brand || '/' || p_name AS path, p_size AS size FROM part) GROUP BY 1")
def merged_files(spark, sf_dir):
    part = read(spark, sf_dir, "part").groupBy("p_brand", "p_name").agg(F.min("p_size").alias("size"))
    shown = part.select(F.concat_ws("/", "p_brand", "p_name").alias("path"), "size")
    loaded = part.where("size > 10").select(F.upper(F.concat_ws("\\", "p_brand", "p_name")).alias("path"), F.lit(-1).alias("size"))
    return search.merged_files(shown, loaded, "path")


@query("roots_page", "SELECT o_orderkey FROM orders ORDER BY o_orderstatus, year(o_orderdate) DESC, lower(o_orderpriority), o_orderkey LIMIT 100 OFFSET 100")
def roots_page(spark, sf_dir):
    order = [F.col("o_orderstatus"), F.desc(F.year("o_orderdate")), text.ascii_fold(F.col("o_orderpriority")), F.col("o_orderkey")]
    return catalog.page(read(spark, sf_dir, "orders"), order, 100, 100).select("o_orderkey")


@query("journal_page", "SELECT event_id FROM events ORDER BY CASE WHEN CAST(floor(value) AS INTEGER) - 10 > 0 THEN CAST(floor(value) AS INTEGER) - 10 ELSE 2147483648 END, event_id LIMIT 200")
def journal_page(spark, sf_dir):
    number = F.floor("value").cast("int") - 10
    return catalog.page(read(spark, sf_dir, "events"), search.journal_order(number, F.col("event_id")), 200).select("event_id")


@query("document_facts")
def document_facts(spark, sf_dir):
    """Facts of whole texts by the rules of German business documents; the customer is the document's source."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("names")))
    found = blocks.document_facts(docs, identities="names")
    return found.withColumn("reasons", F.array_join("reasons", ",")).withColumn("locator", F.to_json("locator"))


@query(
    "directory_metadata",
    """WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages), s AS (SELECT page_id, path, string_split(path, '/') AS x FROM p)
    SELECT page_id, x[-1] AS name, CASE WHEN len(x) > 1 THEN array_to_string(x[1:len(x) - 1], '/') END AS parent, x[1] AS domain_folder, coalesce(x[2], '') AS time_bucket, coalesce(x[3], '') AS project_name FROM s""",
)
def directory_metadata(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", paths.url_path(F.col("url")).alias("path"))
    return rows.select("page_id", paths.parse_directory(F.col("path"), F.lit("primary")).alias("d")).select("page_id", "d.*")


@query("source_uris", "SELECT p_partkey, 'source://primary/' || replace(replace(p_brand, '#', '%23'), ' ', '%20') || '/' || replace(p_name, ' ', '%20') AS uri, p_brand || '/' || p_name AS path FROM part")
def source_uris(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", paths.source_uri(F.lit("primary"), F.concat_ws("/", "p_brand", "p_name")).alias("uri"))
    return rows.withColumn("path", paths.from_source_uri(F.col("uri"))["path"])


@query("display_values", "SELECT o_orderkey, CASE WHEN o_orderkey < 100000 THEN substr(lpad(CAST(o_orderkey AS VARCHAR), 5, '0'), 1, 2) || '-' || substr(lpad(CAST(o_orderkey AS VARCHAR), 5, '0'), 3, 3) ELSE CAST(o_orderkey AS VARCHAR) END AS shown FROM orders")
def display_values(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", text.display_number(F.col("o_orderkey"), F.lit("00-000")).alias("shown"))


@query("document_versions", "SELECT doc_id, sha256('parser-1' || chr(0) || source || chr(0) || CAST(n_chars AS VARCHAR)) AS version, sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS record FROM documents WHERE lang IS NOT NULL")
def document_versions(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where("lang IS NOT NULL")
    return rows.select("doc_id", text.version_hash(F.lit("parser-1"), F.col("source"), F.col("n_chars")).alias("version"), text.record_hash("lang", "doc_id").alias("record"))


@query(
    "recognition_run_summary",
    "SELECT source, CAST(count(*) AS BIGINT) AS detected, CAST(count(*) FILTER (quality = 1) AS BIGINT) AS created, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS BIGINT) AS pending, CAST(count(*) FILTER (toxic = 1) AS BIGINT) AS rejected FROM documents JOIN labels USING (doc_id) GROUP BY 1",
)
def recognition_run_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id").groupBy("source")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return rows.agg(F.count("*").alias("detected"), F.count_if(good).alias("created"), F.count_if(~good & ~toxic).alias("pending"), F.count_if(toxic).alias("rejected"))


@query("sheet_preview", "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) > 500 AS cut FROM orders ORDER BY o_orderkey LIMIT 500")
def sheet_preview(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    more = orders.limit(501).agg((F.count("*") > 500).alias("cut"))
    return catalog.page(orders, [F.col("o_orderkey")], 500).join(F.broadcast(more), how="cross")  # one row
