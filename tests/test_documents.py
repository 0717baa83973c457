"""Facts of documents: channels, parties, contacts, addresses, companies and how blocks are prepared."""

import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import values
from foliant.operators import blocks, documents


def facts_of(spark, bodies, names=("Erika Beispiel",), own=("Büro Nord",), path="a.txt", **block):
    """Facts of each text, found together: most of a small job's time is planning."""
    rows = spark.createDataFrame([(i, body, list(names), list(own), path) for i, body in enumerate(bodies)], "doc_id long, text string, names array<string>, own array<string>, path string")
    parts = documents.blocks_of(rows, "doc_id", "text", "names", "own", "path")
    for name, value in block.items():
        parts = parts.withColumn(name, value)
    found = documents.document_candidates(parts, identities="names", own="own", path="path").collect()
    return [sorted((r["field"], r["value"], r["quality"]) for r in found if r["doc_id"] == i) for i in range(len(bodies))]


def facts(spark, body, **options):
    return facts_of(spark, [body], **options)[0]


HEAD = "Auftraggeber: Erika Beispiel\n"


LINES = [
    ("Telefon: 030 1234567", [("phone", "+49301234567")]), ("Tel. +49 (0)30 1234567", [("phone", "+49301234567")]), ("0049 171 2345678", [("phone", "+491712345678")]), ("Fax: 030 1234567", []), ("Telefon: 030 1234567 Fax: 030 7654321", [("phone", "+49301234567")]),
    ("Fax 030 7654321; Mobil 0171 2345678", [("phone", "+491712345678")]), ("Datum: 01.02.2020", []), ("01 02 2020", []), ("Rechnung 0301234567", []), ("0301234567", []), ("Tel: 0301234567", [("phone", "+49301234567")]), ("0.030 12345678", []), ("030 12345678,00", []),
    ("030 1234567 EUR", []), ("Telefon: 030 1234567 durchwahl 12", [("phone", "+49301234567;ext=12")]), ("Tel. +1 212 555 0100", [("phone", "+12125550100")]), ("Tel. +1 112 555 01", []), ("mail Max.Muster@Example.ORG.", [("email", "Max.Muster@example.org")]),
    ("a..b@example.org", []), ("x@host.local", []), ("x@-bad.org", []), ("IBAN DE12 0301 2345 67", []),
]


def test_channels(spark):
    got = facts_of(spark, [HEAD + line for line, _ in LINES])
    assert [(line, g) for (line, _), g in zip(LINES, got, strict=True)] == [(line, sorted((*w, "strong") for w in want)) for line, want in LINES]


PARTIES = [
    ("Lieferant: Erika Beispiel\na@example.org", []), ("Auftraggeber: Otto Fremd\na@example.org", [("email", "a@example.org", "review")]), ("a@example.org", [("email", "a@example.org", "review")]), ("Erika  BEISPIEL\na@example.org", [("email", "a@example.org", "strong")]),
    ("Büro Nord\nAuftraggeber\na@example.org", []), ("Erika Beispielfrau\na@example.org", [("email", "a@example.org", "review")]),
    ("Auftraggeber: Erika Beispiel\na@example.org\nBaustelle: Musterweg 1\nb@example.org", [("email", "a@example.org", "strong")]),
    ("Auftraggeber: Tel 030 1234567", [("phone", "+49301234567", "strong")]),
]


def test_parties(spark):
    assert facts_of(spark, [body for body, _ in PARTIES]) == [want for _, want in PARTIES]


def test_contacts_addresses_and_companies(spark):
    body = HEAD + "Musterstraße 12a\n12345 Beispielstadt\nAnsprechpartner: Frau Dr. Anna von Muster (Leitung)\nTel. 030 1234567\nanna@example.org"
    found = {f: json.loads(v) if v.startswith("{") else v for f, v, q in facts(spark, body) if q == "strong"}
    assert found == {
        "address": {"city": "beispielstadt", "postal_code": "12345", "street": "musterstraße 12a"},
        "contact": {"email": "anna@example.org", "name": "dr. anna von muster", "phone": "+49301234567", "role": "leitung"},
    }
    bodies = ["Kontakt: Max Muster\na@example.org\nb@example.org\nTel 030 1234567", "Kontakt: Telefon\nTel 030 1234567", "Postfach 12 34\n12345 Musterstadt", "Straße: Am Ring 5\nPLZ: 12345\nOrt: Musterstadt"]
    two, unnamed, box, labelled = facts_of(spark, [HEAD + b for b in bodies])
    assert [f for f, _, _ in two] == ["contact", "contact"]
    assert unnamed == [("phone", "+49301234567", "strong")]
    assert [(f, q) for f, _, q in box] == [("address", "review")]
    assert [(f, q) for f, _, q in labelled] == [("address", "strong")]
    firm = facts(spark, "Kunde: Beispiel Bau GmbH & Co. KG\nx", names=("Beispiel Bau GmbH & Co. KG",))
    assert firm == [("company", "beispiel bau gmbh & co. kg", "strong")]


def test_ocr_spreadsheets_and_empty_texts(spark):
    body = HEAD + "Telefon: 030 1234567\na@example.org"
    assert facts(spark, body, path="list.XLSX") == [("email", "a@example.org", "strong")]
    ocr = {"extraction_method": F.lit("tesseract-ocr"), "confidence": F.lit(0.5), "page": F.lit(1), "bbox": F.array(F.lit(1.0))}
    assert {q for _, _, q in facts(spark, body, **ocr)} == {"review"}
    assert {q for _, _, q in facts(spark, body, **(ocr | {"confidence": F.lit(0.9)}))} == {"strong"}
    assert facts_of(spark, ["", None, "wort " * 50_000]) == [[], [], []]


def test_repeated_facts_and_rows(spark):
    assert facts(spark, HEAD + "a@example.org\na@example.org") == [("email", "a@example.org", "strong")]


NAMES = [("Anna Muster", True), ("Dr. Muster", True), ("Muster", False), ("von der", False), ("Max Angebot", False), ("Muster GmbH", False), ("李小龍", True), ("A. Muster", True), ("Anna2 Muster", False), ("nicht bekannt", False), ("Leistungsverzeichnis Bau", False), ("", False), (None, False)]


def test_person_names(spark):
    rows = spark.createDataFrame(NAMES, "n string, want boolean").select("n", "want", values.person_name(F.col("n")).alias("got")).collect()
    assert [(r["n"], r["got"]) for r in rows] == NAMES


PHONES = [
    ("030 1234567", "+49301234567"), ("+43 1 5128000", "+4315128000"), ("0041 44 668 18 00", "+41446681800"), ("+33 1 42 68 53 00", "+33142685300"), ("+1 212 555 0100", "+12125550100"), ("+352 26 12 34", "+352261234"), ("+7 495 123 45 67", "+74951234567"),
    ("0800 1234567", "+498001234567"), ("0171 2345678", "+491712345678"), ("0151 23456789", "+4915123456789"), ("+210 1234567", ""), ("+384 1234567", ""), ("+999 1234567", ""), ("0110 123456", ""), ("0171 23", ""), ("+1 112 555 0100", ""), ("+49 123456789", ""), ("030 123", ""),
]


def test_phone_plans(spark):
    rows = spark.createDataFrame(PHONES, "n string, want string").select("n", values.phone_number(F.col("n")).alias("got")).collect()
    assert [(r["n"], r["got"]) for r in rows] == PHONES


BLOCKS = "array<struct<text:string,kind:string,section:string,sheet:string,cell:string,block_id:string,page:int,order:int,bbox:array<double>,extraction_method:string,confidence:double>>"
FIELDS = [f.split(":")[0] for f in BLOCKS[13:-2].replace("array<double>", "a").split(",")]


def structured(spark, *docs):
    """Documents (id, text, blocks as dicts, names, own, path)."""
    rows = [(i, body, [tuple(b.get(f) for f in FIELDS) for b in bs] if bs is not None else None, names, own, path) for i, body, bs, names, own, path in docs]
    return spark.createDataFrame(rows, f"doc_id string, text string, blocks {BLOCKS}, names array<string>, own array<string>, path string")


def groups(spark, bs):
    return blocks.prepared(structured(spark, ("d", None, bs, [], [], None)), "doc_id", "text", "blocks").orderBy("block").collect()


def test_sheet_rows(spark):
    cell = lambda t, s, c: {"text": t, "kind": "cell", "sheet": s, "cell": c}
    rows = groups(spark, [cell("Telefon", "S", "A1"), cell("Ort", "S", "B1"), cell("030 1", "S", "A2"), cell("Bonn", "S", "B2"), cell("x", "T", "A2"), cell("y", "S", "A3"), cell("Fax", "S", "A4"), cell("z", "S", "A5")])
    assert [(r["text"], r["locator"]["cell"]) for r in rows] == [
        ("Telefon\nOrt", "A1:B1"), ("Telefon: 030 1\nOrt: Bonn", "A2:B2"), ("x", "A2"), ("Telefon: y", "A3"), ("Fax", "A4"), ("Fax: z", "A5"),
    ]


def test_sections(spark):
    part = lambda t, s, p: {"text": t, "section": s, "page": p}
    rows = groups(spark, [part("Kunde:", "body", 1), part("Erika Beispiel", "body", 1), part("Tel 030 1", "body", 1), part("weiter", "body", 2), part("Kopf", "header1", 1), part("Zeile", "header1", 1), part("", "header1", 1), part("noch", "header1", 1), part("Kunde: X", "header1", 1)])
    assert [r["text"] for r in rows] == ["Kunde:\nErika Beispiel\nTel 030 1", "weiter", "Kopf\nZeile", "\nnoch", "Kunde: X"]
    assert rows[0]["locator"]["block_ids"] == ["1", "1"] and rows[1]["locator"]["block_ids"] is None
    long = groups(spark, [part("Kunde:" + "x" * 1794, "body", 1), part("Tel 030 1", "body", 1), part("Kunde:" + "x" * 1793, "body", 1), part("Tel 030 1", "body", 1)])
    assert [len(r["text"]) for r in long] == [1800, 9, 1809]


def test_a_long_sheet_is_folded_in_one_pass(spark):
    cells = [{"text": "E-Mail", "sheet": "S", "cell": "A1"}] + [{"text": f"n{i}@example.org", "sheet": "S", "cell": f"A{i + 2}"} for i in range(30_000)]
    found = blocks.document_facts(structured(spark, ("d", None, cells, [], [], "x.xlsx")), "doc_id", "text", "blocks", "names", "own", "path")
    assert found.count() == 30_000


#: Documents in the forms that occur, with the strong facts that they give: (id, text, blocks, path, facts). The customer is Kim Probe, the office Büro Süd.
CASES = [
    ("ocr", None, [{"text": "Kunde: Kim Probe\nE-Mail: ocr@example.org", "page": 2, "block_id": "p2-1", "bbox": [1.0, 2.0, 3.0, 4.0], "extraction_method": "ocr", "confidence": 0.9}], "a.pdf", [("email", "ocr@example.org")]),
    ("ocr-low", None, [{"text": "Kunde: Kim Probe\nE-Mail: ocr@example.org", "page": 2, "bbox": [1.0, 2.0, 3.0, 4.0], "extraction_method": "ocr", "confidence": 0.5}], "a.pdf", []),
    ("ocr-placeless", None, [{"text": "Kunde: Kim Probe\nE-Mail: ocr@example.org", "extraction_method": "tesseract", "confidence": 0.9}], "a.pdf", []),
    ("docx-header", None, [{"text": "Kunde: Kim Probe", "section": "header1", "order": 0}, {"text": "Tel: 030 2345678", "section": "header1", "order": 1}], "a.docx", [("phone", "+49302345678")]),
    ("docx-body", None, [{"text": "Auftraggeber:", "section": "body"}, {"text": "Kim Probe", "section": "body"}, {"text": "Am Ring 7", "section": "body"}, {"text": "10115 Berlin", "section": "body"}], "a.docx", [("address", "am ring 7")]),
    ("docx-two-pages", None, [{"text": "Kunde: Kim Probe", "section": "body", "page": 1}, {"text": "Tel: 030 2345678", "section": "body", "page": 2}], "a.docx", []),
    ("xlsx-cells", None, [{"text": t, "sheet": "K", "cell": c, "kind": "table_cell"} for t, c in (("Kunde", "A1"), ("Telefon", "B1"), ("E-Mail", "C1"), ("Kim Probe", "A2"), ("030 2345678", "B2"), ("cell@example.org", "C2"))], "a.xlsx", [("email", "cell@example.org")]),
    ("xls-row", None, [{"text": "Kunde: Kim Probe\nTelefon: 030 2345678", "sheet": "K", "cell": "A5:B5", "kind": "table_row"}], "a.xls", []),
    ("text-email", "Kunde: Kim Probe\nmail@example.org", None, "a.txt", [("email", "mail@example.org")]),
    ("text-phone", "Bauherrin: Kim Probe\nTel. (030) 234 56 78", None, "a.txt", [("phone", "+49302345678")]),
    ("text-mobile", "Rechnung an: Kim Probe\nMobil +49 171 2345678", None, "a.txt", [("phone", "+491712345678")]),
    ("text-fax", "Kunde: Kim Probe\nFax 030 2345678", None, "a.txt", []),
    ("text-address", "Kunde: Kim Probe\nAm Ring 7\n10115 Berlin", None, "a.txt", [("address", "am ring 7")]),
    ("text-labelled", "Kunde: Kim Probe\nStraße: Alt 1\nStraße: Am Ring 7\nPLZ: 10115\nOrt: Berlin", None, "a.txt", [("address", "am ring 7")]),
    ("text-postbox", "Kunde: Kim Probe\nPostfach 12 34\n10115 Berlin", None, "a.txt", []),
    ("text-contact", "Kunde: Kim Probe\nAnsprechpartner: Frau Jo Muster (Technik)\njo@example.org", None, "a.txt", [("contact", "jo muster")]),
    ("text-supplier", "Lieferant: Kim Probe\nmail@example.org", None, "a.txt", []),
    ("text-own", "Kunde: Kim Probe\nBüro Süd\nmail@example.org", None, "a.txt", []),
    ("text-other", "Kunde: Alex Fremd\nmail@example.org", None, "a.txt", []),
    ("text-two-parties", "Kunde: Kim Probe\na@example.org\nLieferant: Fremd AG\nb@example.org", None, "a.txt", [("email", "a@example.org")]),
    ("text-paragraphs", "Kim Probe\na@example.org\n\nb@example.org", None, "a.txt", [("email", "a@example.org")]),
    ("text-marks", "Kunde: Kim Probe\x01 a@example.org\x01Lieferant: x", None, "a.txt", [("email", "a@example.org")]),
    ("empty", "", [], "a.txt", []), ("null", None, None, None, []),
]


@pytest.fixture(scope="module")
def found_in_cases(spark):
    docs = structured(spark, *((i, body, bs, ["Kim Probe"], ["Büro Süd"], path) for i, body, bs, path, _ in CASES))
    return blocks.document_facts(docs, "doc_id", "text", "blocks", "names", "own", "path").collect()


def test_cases_give_their_facts_and_no_others(found_in_cases):
    name = lambda f, v: json.loads(v)[{"address": "street", "contact": "name"}[f]] if v.startswith("{") else v
    got = sorted((r["doc_id"], r["field"], name(r["field"], r["value"])) for r in found_in_cases if r["quality"] == "strong")
    assert got == sorted((i, f, v) for i, _, _, _, facts_ in CASES for f, v in facts_)


def test_facts_have_the_place_they_come_from(found_in_cases):
    at = {r["doc_id"]: r["locator"].asDict() for r in found_in_cases if r["quality"] == "strong"}
    assert at["ocr"] | {"bbox": None} == {"page": 2, "bbox": None, "section": None, "sheet": None, "cell": None, "block_id": "p2-1", "block_ids": None, "order": None, "extraction_method": "ocr", "confidence": 0.9, "segment": 0}
    assert (at["xlsx-cells"]["sheet"], at["xlsx-cells"]["cell"], at["xlsx-cells"]["block_id"]) == ("K", "A2:C2", "1")
    assert (at["docx-header"]["section"], at["docx-header"]["order"], at["docx-header"]["block_ids"]) == ("header1", 0, ["1"])


def test_no_contact_is_dropped(spark):
    body = HEAD + "".join(f"Kontakt: Max Muster\nm{i}@example.org\n" for i in range(10_050))
    assert len(facts(spark, body)) == 10_050


def test_many_numbers_in_a_line(spark):
    line = "Telefon: " + " und ".join(f"030 {2_000_000 + i}" for i in range(3000)) + "; Fax: " + " und ".join(f"030 {7_000_000 + i}" for i in range(3000))
    assert len(facts(spark, HEAD + line)) == 3000


def test_a_filter_on_parties_does_not_work_them_out_again(spark, sf_dir):
    from foliant import registry

    plan = registry.queries()["document_candidates"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("customer-role-identity-unresolved") == 1
