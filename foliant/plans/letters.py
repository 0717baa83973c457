"""Facts of letters and sheets that are written from the customers' rows, whose facts SQL knows from the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import blocks
from ..registry import query
from ..sources.shared import spread
from .catalog import read

_FIELDS = ("text", "kind", "section", "sheet", "cell", "page")


def _block(text: Column | str, section: str | None = None, sheet: str | None = None, cell: str | None = None) -> Column:
    lit = lambda x: F.lit(x).cast("string")
    values = (text if isinstance(text, Column) else F.lit(text), lit("table_cell" if cell else "paragraph"), lit(section), lit(sheet), lit(cell), F.lit(1 if section else None).cast("int"))
    return F.struct(*[v.alias(n) for n, v in zip(_FIELDS, values, strict=True)])


def letters(spark, sf_dir):
    """(doc_id, names, own, path, blocks): a letter of each customer with a header, the customer's block, another party's and a sheet."""
    k = F.col("c_custkey")
    six = F.lpad((k % 1_000_000).cast("string"), 6, "0")
    firm = F.concat("c_name", F.lit(" Bau GmbH"))
    body = [
        "Auftraggeber:", firm, F.concat(F.lit("Musterweg "), k % 99 + 1), F.concat(k % 90_000 + 10_000, F.lit(" Musterstadt")), F.concat(F.lit("Telefon: 030 2"), six), F.concat(F.lit("Fax: 030 9"), six),
        F.concat(F.lit("kunde"), k, F.lit("@example.org")), F.concat(F.lit("Ansprechpartner: Anna "), F.initcap("c_mktsegment")), F.concat(F.lit("anna"), k, F.lit("@example.org")), "Lieferant: Fremd AG\nTelefon: 040 1234567",
    ]
    cells = {"A1": "Kunde", "B1": "Telefon", "C1": "E-Mail", "A2": firm, "B2": F.concat(F.lit("030 2"), six), "C2": F.concat(F.lit("tab"), k, F.lit("@example.org"))}
    parts = [_block("Absender: Büro Nord", "header1"), _block("Telefon: 030 7654321", "header1"), *[_block(t, "body") for t in body], *[_block(t, sheet="Kontakte", cell=c) for c, t in cells.items()]]
    return spread(read(spark, sf_dir, "customer")).select(k.alias("doc_id"), F.array(firm).alias("names"), F.array(F.lit("Büro Nord")).alias("own"), F.lit("letter.docx").alias("path"), F.array(*parts).alias("blocks"))


_FACT = "SELECT c_custkey AS doc_id, '{0}' AS field, {1} AS value, 'strong' AS quality, '{2}' AS place, {3} AS block, {4} AS joined FROM customer"
_FIRM = "lower(c_name || ' Bau GmbH')"


@query(
    "document_candidates",
    " UNION ALL ".join(
        _FACT.format(*f)
        for f in (
            ("email", "'kunde' || c_custkey || '@example.org'", "body", 1, 8),
            ("phone", "'+49302' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')", "body", 1, 8),
            ("address", """'{"city":"musterstadt","postal_code":"' || (c_custkey % 90000 + 10000) || '","street":"musterweg ' || (c_custkey % 99 + 1) || '"}'""", "body", 1, 8),
            ("company", _FIRM, "body", 1, 8),
            ("contact", """'{"email":"anna' || c_custkey || '@example.org","name":"anna ' || lower(c_mktsegment) || '"}'""", "body", 1, 8),
            ("email", "'tab' || c_custkey || '@example.org'", "Kontakte A2:C2", 4, 0),
            ("company", _FIRM, "Kontakte A2:C2", 4, 0),
        )
    ),
)
def document_candidates(spark, sf_dir):
    """All facts of the letters in one call, from their blocks on."""
    found = blocks.document_facts(letters(spark, sf_dir), "doc_id", None, "blocks", "names", "own", "path")
    place = F.coalesce("locator.section", F.concat_ws(" ", "locator.sheet", "locator.cell"))
    return found.select("doc_id", "field", "value", "quality", place.alias("place"), "block", F.coalesce(F.size("locator.block_ids"), F.lit(0)).alias("joined"))
