"""Queries on trees, versions, layouts and scores: structure sync, preservation, positioned words, macro averages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import catalog, evaluation, preservation, recognition, records, structure
from ..registry import query
from ..sources import layout
from .catalog import _URL, read

_ALL = f"SELECT page_id, {_URL} AS path FROM pages"
_TREE = "SELECT DISTINCT array_to_string(string_split(path, '/')[1:n], '/') AS path, n AS depth FROM ({0}), unnest(range(1, len(string_split(path, '/')))) AS t(n)"


@query(
    "structure_sync",
    f"""WITH u AS ({_ALL}), a AS ({_TREE.format("SELECT path FROM u WHERE page_id % 3 <> 0")}), b AS ({_TREE.format("SELECT path FROM u WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")}),
    k AS (SELECT path, depth, row_number() OVER (ORDER BY depth, path) AS id FROM a),
    n AS (SELECT path, depth, (SELECT coalesce(max(id), 0) FROM k) + row_number() OVER (ORDER BY depth, path) AS id FROM b WHERE path NOT IN (SELECT path FROM a)),
    now AS (SELECT id, path, depth, 'new' AS state FROM n UNION ALL SELECT id, path, depth, 'kept' FROM k WHERE path IN (SELECT path FROM b)),
    up AS (SELECT c.id, c.path, p.id AS parent_id, c.state FROM now c LEFT JOIN now p ON p.depth = c.depth - 1 AND starts_with(c.path, p.path || '/')),
    old AS (SELECT c.id, c.path, p.id AS parent_id, 'removed' AS state FROM k c LEFT JOIN k p ON p.depth = c.depth - 1 AND starts_with(c.path, p.path || '/') WHERE c.path NOT IN (SELECT path FROM b))
    SELECT CAST(id AS BIGINT) AS id, path, CAST(parent_id AS BIGINT) AS parent_id, state FROM up UNION ALL SELECT CAST(id AS BIGINT), path, CAST(parent_id AS BIGINT), state FROM old""",
)
def structure_sync(spark, sf_dir):
    """Two scans of the pages' tree: the first gives numbers, the second keeps, adds and drops folders."""
    pages = read(spark, sf_dir, "pages")
    path = paths.url_path(F.col("url"))
    first = structure.sync(None, structure.folders_of(pages.where("page_id % 3 <> 0"), path))
    second = structure.sync(first, structure.folders_of(pages.where("page_id % 5 <> 0 AND page_id % 7 <> 0"), path))
    return second.select("id", "path", "parent_id", "state")


_AFTER = "SELECT c_custkey, CASE WHEN c_custkey % 97 = 5 THEN c_name || 'x' ELSE c_name END AS c_name, c_nationkey FROM customer WHERE c_custkey % 131 <> 7 UNION ALL SELECT -c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 211 = 3"


@query(
    "preservation_check",
    f"""WITH a AS ({_AFTER}) SELECT coalesce(a.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'lost' WHEN c.c_custkey IS NULL THEN 'added' ELSE 'changed' END AS change
    FROM customer c FULL OUTER JOIN a ON a.c_custkey = c.c_custkey WHERE a.c_custkey IS NULL OR c.c_custkey IS NULL OR a.c_name <> c.c_name""",
)
def preservation_check(spark, sf_dir):
    before = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    renamed = before.where("c_custkey % 131 <> 7").withColumn("c_name", F.when(F.col("c_custkey") % 97 == 5, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")))
    after = renamed.unionByName(before.where("c_custkey % 211 = 3").withColumn("c_custkey", -F.col("c_custkey")))
    return preservation.differences(before, after, ["c_custkey"])


@query(
    "page_layout",
    """WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda t: t <> '') AS ws FROM conversations),
    p AS (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w)
    SELECT conv_id, turn, CAST(i % 2 AS INTEGER) AS block, string_agg(word, chr(10) ORDER BY i) AS text, CAST(50 + 300 * (i % 2) AS DOUBLE) AS x0, CAST(12 * max(i // 2) + 10 AS DOUBLE) AS y1, CAST(count(*) AS INTEGER) AS words FROM p GROUP BY conv_id, turn, i % 2""",
)
def page_layout(spark, sf_dir):
    """Turns are pages, set in two columns with one word a line: each column is a paragraph."""
    words = F.filter(F.split("text", r"[ \t\r\n]+"), lambda t: t != "")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("i", "text"))
    left, top = 50 + 300 * (F.col("i") % 2), 12 * F.floor(F.col("i") / 2)
    placed = rows.select("conv_id", "turn", left.alias("x0"), (left + 20).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), "text")
    found = layout.layout_blocks(placed, "conv_id", "turn")
    return found.select("conv_id", "turn", "block", "text", F.col("bbox")[0].alias("x0"), F.col("bbox")[3].alias("y1"), "words")


_DIMENSIONS = ["lang", "source", "toxic", "split", "customer"]
_MACRO = "SELECT '{0}' AS dimension, {1} AS value, customer, sum(e * a) AS tp, sum((1 - e) * a) AS fp, sum(e * (1 - a)) AS fn FROM j WHERE e + a > 0 GROUP BY 2, 3"


@query(
    "recognition_scores",
    f"""WITH j AS (SELECT d.doc_id, lang, source, toxic, d.doc_id % 2 AS split, d.doc_id % 17 AS customer, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS e, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS a FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
    s AS ({" UNION ALL ".join(_MACRO.format(d, v) for d, v in [("all", "''"), *((d, f"CAST({d} AS VARCHAR)") for d in _DIMENSIONS)])}),
    f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM s),
    t AS (SELECT dimension, value, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall FROM f GROUP BY 1, 2)
    SELECT dimension, value, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, macro_precision, macro_recall FROM t""",
)
def recognition_scores(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumns({"split": F.col("doc_id") % 2, "customer": F.col("doc_id") % 17})
    return recognition.scores(rows.where("quality = 1"), rows.where("n_chars > 1500"), ["doc_id", *_DIMENSIONS], _DIMENSIONS, "customer")


_ROUNDS = """WITH d AS (SELECT source, doc_id, contains(text, '@') AS mail, contains(text, ' | ') AS bars, (row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1) // 4 AS round FROM documents),
    s AS (SELECT source, CASE WHEN count(CASE WHEN mail THEN 1 END) > 0 AND count(CASE WHEN bars THEN 1 END) > 0 THEN greatest(min(CASE WHEN mail THEN round END), min(CASE WHEN bars THEN round END)) ELSE 99 END AS stop FROM d WHERE round < 10 GROUP BY 1)
    SELECT d.source, doc_id, field, CAST(round AS INTEGER) AS round FROM d JOIN s ON s.source = d.source, (SELECT unnest(['mail', 'bars']) AS field) f
    WHERE round < 10 AND round <= stop AND CASE field WHEN 'mail' THEN mail ELSE bars END"""


@query("adaptive_evaluation", _ROUNDS)
def adaptive_evaluation(spark, sf_dir):
    """Sources' documents in rounds of four until both fields are found, 40 at most; later rounds read no text of a source that has both."""
    docs = read(spark, sf_dir, "documents")
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select("source", "doc_id", place.alias("rank"))
    fields = {"mail": "@", "bars": " | "}

    def find(wanted):
        texts = docs.select("doc_id", "text").join(catalog.sized(wanted), "doc_id")
        return texts.select("source", "doc_id", F.explode(F.filter(F.array(*[F.when(F.contains("text", F.lit(w)), f) for f, w in fields.items()]), lambda f: f.isNotNull())).alias("field"))

    needed = docs.select("source").distinct().select("source", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field"))
    return evaluation.evaluate_in_rounds(ranked, "source", "rank", needed, find, batch=4, most=40)


_CHANGED = """WITH c AS (SELECT o_custkey AS k, min(o_orderkey) AS o FROM orders GROUP BY 1), k AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, c_custkey % 3 AS revision FROM customer WHERE c_custkey % 4 > 0),
    n AS (SELECT c.k, CASE o % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS op, o % 2 AS revision, 'n' || o AS name, CASE WHEN o % 5 = 0 THEN 's' || o END AS segment FROM c),
    j AS (SELECT coalesce(k.k, n.k) AS k, op, k.revision AS r, n.name AS nn, n.segment AS ns, k.name AS kn, k.segment AS ks,
        CASE WHEN op IS NULL THEN NULL WHEN op = 'create' AND k.k IS NOT NULL THEN 'exists' WHEN op = 'create' THEN 'created' WHEN k.k IS NULL THEN 'unknown' WHEN k.revision <> n.revision THEN 'conflict' WHEN op = 'update' THEN 'updated' ELSE 'deleted' END AS outcome
        FROM k FULL OUTER JOIN n ON n.k = k.k)"""


def _records(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderkey").alias("o"))
    known = read(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), (F.col("c_custkey") % 3).alias("revision"))
    op = F.when(F.col("o") % 3 == 0, "create").when(F.col("o") % 3 == 1, "update").otherwise("delete")
    changes = orders.select("k", op.alias("op"), (F.col("o") % 2).alias("revision"), F.concat(F.lit("n"), "o").alias("name"), F.when(F.col("o") % 5 == 0, F.concat(F.lit("s"), "o")).alias("segment"))
    old = known.select("k", F.col("name").alias("child"))
    given = orders.where("o % 7 < 4").select("k", F.concat(F.lit("c"), "o").alias("child"))
    return records.apply_changes(known, changes, "k", ["name", "segment"], {"child": (old, given)})


@query("record_changes", f"{_CHANGED} SELECT k, CASE WHEN outcome IN ('created', 'updated') THEN nn ELSE kn END AS name, CASE WHEN outcome IN ('created', 'updated') THEN coalesce(ns, ks) ELSE ks END AS segment, CAST(CASE WHEN outcome IN ('created', 'updated') THEN coalesce(r, 0) + 1 ELSE r END AS BIGINT) AS revision FROM j WHERE outcome IS NULL OR outcome IN ('created', 'updated') OR (outcome <> 'deleted' AND r IS NOT NULL)")
def record_changes(spark, sf_dir):
    return _records(spark, sf_dir).records


@query("record_outcomes", f"{_CHANGED} SELECT outcome, CAST(count(*) AS BIGINT) AS n FROM j WHERE op IS NOT NULL GROUP BY 1")
def record_outcomes(spark, sf_dir):
    return _records(spark, sf_dir).outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "record_children",
    f"""{_CHANGED}, g AS (SELECT k, 'c' || o AS child FROM c WHERE o % 7 < 4 AND k IN (SELECT k FROM j WHERE outcome IN ('created', 'updated')))
    SELECT k, child FROM g UNION ALL SELECT k, name AS child FROM k WHERE k NOT IN (SELECT k FROM g) AND k NOT IN (SELECT k FROM j WHERE outcome = 'deleted')""",
)
def record_children(spark, sf_dir):
    return _records(spark, sf_dir).children["child"]


@query(
    "customer_tags",
    """WITH t AS (SELECT DISTINCT o_custkey AS c_custkey, lower(o_orderpriority) AS tag FROM orders WHERE o_totalprice > 200000)
    SELECT c.c_custkey, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM customer c LEFT JOIN t ON t.c_custkey = c.c_custkey GROUP BY 1""",
)
def customer_tags(spark, sf_dir):
    names = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("tag"))
    tags, links = records.tagged(names, "c_custkey", spark.createDataFrame([], "id long, name string"))
    lists = records.tag_lists(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", links, tags)
    return lists.select("c_custkey", F.lower(F.array_join("tags", ",")).alias("tags"))
