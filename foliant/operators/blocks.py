"""How blocks of documents become segments: sheet rows, joined sections and parties' parts, each with the place it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text
from ..functions.arrays import once
from .documents import CELL_LABELS, CONTACT_START, EMAIL, PARTY_START, PHONE_LABEL, POSTAL, STREET, document_candidates, segments_of

#: What a locator holds, besides the segment. Fixed values.
LOCATOR = {
    "page": "int", "bbox": "array<double>", "section": "string", "sheet": "string", "cell": "string", "block_id": "string", "block_ids": "array<string>", "order": "int", "extraction_method": "string", "confidence": "double",
}
#: A joined block takes no further line from so many characters on. Fixed value.
LONGEST = 1800
_MARKS = "struct<sheet:string,column:string,row:string,label:string,section:string,page:int,opens:boolean,contact:boolean,edge:boolean,blank:boolean,colon:boolean,size:int>"
_PLAN = "struct<heads:array<string>,groups:array<struct<first:int,size:int>>>"


def grouping(marks: list[dict]) -> dict:
    """What one pass over a document's blocks decides: the label that heads each cell, and which neighbouring blocks are one.

    Cells of one row of a sheet are one. A label heads its column until the next. A block joins the one before it in the same
    section and page if it opens no party and that one is below LONGEST: in headers and footers unless it is blank, elsewhere if that one
    opens a party and this is a contact line or stands behind its colon.
    """
    heads, groups, labels = [], [], {}
    last: dict = {}
    for i, m in enumerate(marks):
        row, column = (m["sheet"], m["row"]), (m["sheet"], m["column"])
        in_row = m["row"] is not None
        heads.append(None if not in_row or m["label"] else labels.get(column))
        if in_row and m["label"]:
            labels[column] = m["label"]
        if in_row:
            joins = last.get("at_row") == row
        else:
            joins = bool(m["section"]) and last.get("section") == m["section"] and last["page"] == m["page"] and not m["opens"] and last["size"] < LONGEST
            joins = joins and ((m["edge"] and not m["blank"]) or (last["opens"] and (m["contact"] or last["colon"])))
        if joins:
            groups[-1]["size"] += 1
            last["size"] += 1 + m["size"]
            last["colon"] = last["colon"] if m["blank"] else m["colon"]
        else:
            groups.append({"first": i, "size": 1})
            last = m | {"at_row": row if in_row else None}
    return {"heads": heads, "groups": groups}


def _plan(marks: Column) -> Column:
    @F.arrow_udf(_PLAN)
    def plan(values):
        import pyarrow as pa

        kind = pa.struct([("heads", pa.list_(pa.string())), ("groups", pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())])))])
        return pa.array([grouping(v or []) for v in values.to_pylist()], kind)

    return plan(marks)


def _fields(blocks: DataFrame, column: str) -> set[str]:
    kind = blocks.schema[column].dataType
    if not isinstance(kind, ArrayType) or not isinstance(kind.elementType, StructType):
        raise ValueError(f"{column} is no array of structs")
    return set(kind.elementType.names)


def _whole(there: set[str]):
    """A block with all fields of a locator, text and kind, whatever its own struct has."""

    def make(b: Column) -> Column:
        get = lambda name, kind: b[name].cast(kind) if name in there else F.lit(None).cast(kind)
        method = F.coalesce(get("extraction_method", "string"), get("method", "string"))
        kept = [get(n, k).alias(n) for n, k in LOCATOR.items() if n not in ("extraction_method", "block_ids")]
        kind = F.coalesce(get("kind", "string"), get("block_type", "string"), F.lit("paragraph"))
        return F.struct(F.coalesce(get("text", "string"), F.lit("")).alias("text"), kind.alias("kind"), *kept, method.alias("extraction_method"))

    return make


def _marks(b: Column) -> Column:
    body, here = b["text"], F.trim(b["text"])
    in_row = (F.coalesce(b["sheet"], F.lit("")) != "") & F.coalesce(b["cell"].rlike("^[A-Z]+[0-9]+$"), F.lit(False))
    in_section = ~in_row & (F.coalesce(b["section"], F.lit("")) != "")
    labels = F.create_map(*[F.lit(x) for pair in CELL_LABELS.items() for x in pair])
    contact = body.rlike(f"(?iuU){PHONE_LABEL}") | body.rlike(EMAIL) | body.rlike(rf"(?iuU)^\s*{CONTACT_START}") | here.rlike(POSTAL) | here.rlike(STREET) | body.rlike(r"(?iuU)^\s*(?:Fax|Rolle|Funktion|E-?Mail)\s*:")
    only = lambda when, value: F.coalesce(F.when(when, value), F.lit(False))
    return F.struct(
        b["sheet"].alias("sheet"), F.when(in_row, F.regexp_extract(b["cell"], "^[A-Z]+", 0)).alias("column"), F.when(in_row, F.regexp_extract(b["cell"], "[0-9]+$", 0)).alias("row"),
        F.when(in_row, labels[text.identity_key(body)]).alias("label"), b["section"].alias("section"), b["page"].alias("page"), only(in_section, body.rlike(rf"(?iuU)^\s*{PARTY_START}")).alias("opens"),
        only(in_section, contact).alias("contact"), only(in_section, b["section"].rlike("^(?:header|footer)")).alias("edge"), (here == "").alias("blank"), F.rtrim(body).endswith(":").alias("colon"), F.length(body).alias("size"),
    )


def _joined(group: Column, number: Column) -> Column:
    """struct<text, kind, locator> of blocks that are one."""
    first, rest = group[0], F.slice(group, 2, F.size(group))
    in_row = (F.size(group) > 1) & first["cell"].isNotNull()
    cell = F.when(in_row, F.concat(F.substring_index(first["cell"], ":", 1), F.lit(":"), F.element_at(group, -1)["cell"])).otherwise(first["cell"])
    ids = F.when(~in_row & (F.size(rest) > 0), F.transform(rest, lambda b: F.coalesce(b["block_id"], b["order"].cast("string"), (number + 1).cast("string"))))
    values = {"cell": cell, "block_ids": ids, "block_id": F.coalesce(first["block_id"], number.cast("string"))}
    locator = F.struct(*[(values[n] if n in values else first[n]).alias(n) for n in LOCATOR])
    return F.struct(F.array_join(F.transform(group, lambda b: b["text"]), "\n").alias("text"), first["kind"].alias("kind"), locator.alias("locator"))


def prepared(docs: DataFrame, doc_id: str, body: str | None = None, blocks: str | None = None, *others: str) -> DataFrame:
    """(doc_id, others, block, kind, text, locator): a document's blocks, rows of sheets and sections joined, in order.

    blocks names a column of structs with any of the fields text, kind, page, bbox, section, sheet, cell, block_id, order,
    extraction_method and confidence. A document without blocks is its text, cut at blank lines and form feeds; null texts give nothing.
    What Python sees of a block are its marks, never its text.
    """
    none = F.struct(*[F.lit(None).cast(k).alias(n) for n, k in LOCATOR.items() if n != "block_id"])
    paragraphs = F.filter(F.split(F.coalesce(F.col(body), F.lit("")), r"\n\s*\n|\f"), lambda p: F.trim(p) != "") if body else F.array().cast("array<string>")
    place = lambda i: F.struct(*[i.cast("string").alias(n) if n == "block_id" else none[n].alias(n) for n in LOCATOR])
    plain = F.transform(paragraphs, lambda p, i: F.struct(p.alias("text"), F.lit("paragraph").alias("kind"), place(i).alias("locator")))
    if blocks is None:
        return docs.select(doc_id, *others, F.posexplode(plain).alias("block", "b")).select(doc_id, *others, "block", "b.kind", "b.text", "b.locator")
    whole = F.transform(F.coalesce(F.col(blocks), F.array()), _whole(_fields(docs, blocks)))
    rows = docs.select(doc_id, *others, *([body] if body else []), whole.alias("_blocks"))
    rows = rows.withColumn("_plan", _plan(F.transform("_blocks", _marks)))
    written = F.zip_with("_blocks", "_plan.heads", lambda b, h: F.when(h.isNotNull(), b.withField("text", F.concat_ws(": ", h, b["text"]))).otherwise(b))
    joined = once(written, lambda all_: F.transform(F.col("_plan.groups"), lambda g, i: _joined(F.slice(all_, g["first"] + 1, g["size"]), i)))
    rows = rows.select(doc_id, *others, F.posexplode(F.when(F.size("_blocks") > 0, joined).otherwise(plain)).alias("block", "b"))
    return rows.select(doc_id, *others, "block", "b.kind", "b.text", "b.locator")


def segments(docs: DataFrame, doc_id: str, body: str | None = None, blocks: str | None = None, *others: str) -> DataFrame:
    """Prepared blocks cut at lines that name a party: (doc_id, others, block, kind, locator, segment, text)."""
    return segments_of(prepared(docs, doc_id, body, blocks, *others), doc_id, *others, "locator")


def document_facts(docs: DataFrame, doc_id: str = "doc_id", body: str | None = "text", blocks: str | None = None, identities: str | None = None, own: str | None = None, path: str | None = None) -> DataFrame:
    """All facts of documents in one call: their blocks are prepared, cut into parties' segments and searched; see document_candidates.

    Each fact has the locator of its segment. A document's facts follow from its own row: nothing is shuffled but facts that repeat.
    """
    others = [c for c in dict.fromkeys((identities, own, path)) if c]
    return document_candidates(prepared(docs, doc_id, body, blocks, *others), doc_id, identities, own, path)
