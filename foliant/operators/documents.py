"""Facts of documents: e-mail, phone, contact, address and company candidates with party, quality and reasons.

Everything is a chain of projections: blocks, segments, contacts and lines are arrays that are split and exploded in place, so a
document is read once and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, values
from ..functions.arrays import once
from . import ordered

# Labels of German business documents.
PARTY_START = r"(?:auftraggeber|auftragnehmer|bauherr(?:in)?|kunde|kundin|rechnung\s+an|lieferant|nachunternehmer|behörde|bauamt|baustelle|bauvorhaben|projekt(?:adresse)?|objektanschrift|absender|empfänger)\s*:"
CONTACT_START = r"(?:ansprechpartner(?:in)?|kontaktperson|kontakt|herr|frau)\b"
OTHER_PARTIES = (
    ("own_office", r"auftragnehmer|eigenes\s+büro"), ("supplier", r"lieferant|nachunternehmer"), ("authority", r"behörde|bauamt"),
    ("project", r"baustelle|bauvorhaben|projekt(?:adresse)?|objektanschrift"),
)
CUSTOMER = r"(?iuU)\b(?:auftraggeber|bauherr(?:in)?|kunde|kundin|rechnung\s+an)\b"
CUSTOMER_LINE = r"(?iuU)\b(?:auftraggeber|bauherr(?:in)?|kunde|kundin|rechnung\s+an)\b[ :\t]*([^\n|;]*)"
DOCUMENT_ROLE = r"(?imuU)^\s*(absender|empfänger|von|an)\s*:"
PHONE_LABEL = r"\b(?:telefon|tel\.?|mobil|mobile|phone|fon)\s*:?[ \t]*"
NO_PHONE_LABEL = (
    r"\b(?:fax|telefax|rechnungs?(?:nummer|nr\.?)|rechnung|iban|bic|steuer(?:nummer|nr\.?)|ust[ .-]*id|datum|date|stand|erstellt|geändert|gedruckt|geburtstag|geburtsdatum|termin|gültig\s+(?:ab|bis)"
    r"|flurstück|position|pos\.?|maße|menge|preis|betrag|kundennummer|konto(?:nummer)?|plz)\b"
)
STREET = r"(?uU)^(\p{L}[\wäöüÄÖÜß .'-]{1,75}\s+[0-9]{1,5}\s*[a-zA-Z]?(?:\s*[-/]\s*[0-9]{1,5}[a-zA-Z]?)?)$"
POSTAL = r"(?uU)^(?:(?:D|DE)-)?([0-9]{5})\s+(\p{L}[\wäöüÄÖÜß .()/-]{1,70})$"
STREET_WORD = r"(?iuU)(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|road|street|lane|avenue)\b"
ANY_POSTAL = r"(?iuU)^((?:[A-Z]{1,3}-)?[0-9]{4,6}|[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\s+(\p{L}[\w .()/-]+)$"
EMAIL = r"(?U)(?<![\w.+-])([\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+\.[\w-]+)"
UNITS = r"EUR|€|mm|cm|m²|kg|Stück"
#: A number with a prefix, not a part of a decimal or longer number, and not followed by a unit.
NUMBER = (
    r"(?<![\p{L}\p{N}+.,])(?<![0-9][ \t]{0,3}[.,][ \t]{0,3})((?>(?:\+[1-9]|\(0[1-9]|00[1-9]|0[1-9])(?:[() /\t\-‐-―]{0,2}[0-9]){4,18}(?:[ \t]*(?i:ext(?:ension)?\.?|durchwahl|x|#)[ \t:]*[0-9]{1,10}|;ext=[0-9]{1,10})?))"
    r"(?![0-9])(?![ \t]*\.[ \t]*[0-9]|,[0-9])(?!(?iuU)\s*(?:" + UNITS + r")(?!\w))"
)
CELL_LABELS = {
    "telefon": "Telefon", "tel": "Telefon", "mobil": "Mobil", "email": "E-Mail", "e mail": "E-Mail", "fax": "Fax", "ansprechpartner": "Ansprechpartner", "rolle": "Rolle", "funktion": "Rolle",
    "kunde": "Kunde", "auftraggeber": "Auftraggeber", "straße": "Straße", "strasse": "Straße", "plz": "PLZ", "ort": "Ort",
}
SPREADSHEETS = ("xls", "xlsx", "xlsm", "xlsb", "xlt", "xltx", "xltm")
#: Where a line's scopes begin: at a cell's end, or at a label; what is numbered in a scope falls under its label.
SCOPE = rf"(?iuU)(?=[;|])|(?={NO_PHONE_LABEL})|(?={PHONE_LABEL})"


def _split_before(body: Column, start: str) -> Column:
    """The text cut before each line that begins with the pattern; all parts in order."""
    return F.split(body, rf"(?imuU)(?<!\A)^(?=[\s&&[^\n]]*{start})")


def may_hold_facts(body: Column) -> Column:
    """Whether a text can give any fact: all but companies need an at sign or a digit, and companies a legal form."""
    return body.rlike("[@0-9]") | body.rlike(values.LEGAL_FORM)


def blocks_of(docs: DataFrame, doc_id: str, body: str, *others: str) -> DataFrame:
    """(doc_id, block, kind, text and the other columns): paragraphs, cut at blank lines and form feeds."""
    parts = F.filter(F.split(F.coalesce(F.col(body), F.lit("")), r"\n\s*\n|\f"), lambda p: F.trim(p) != "")
    return docs.select(doc_id, *others, F.posexplode(parts).alias("block", "text")).withColumn("kind", F.lit("paragraph"))


def segments_of(blocks: DataFrame, doc_id: str, *others: str) -> DataFrame:
    """Blocks cut at lines that name a party, numbered from 0 within the block."""
    lines = F.filter(_split_before(F.col("text"), PARTY_START), lambda s: F.trim(s) != "")
    return blocks.select(doc_id, *others, "block", "kind", F.posexplode(F.transform(lines, lambda s: F.regexp_replace(s, r"\n+$", ""))).alias("segment", "text"))


def party(body: Column, identities: Column, own: Column) -> Column:
    """(role, reasons) of a segment: own office, another named party, the customer by identity or by label, else unknown."""
    heading = F.substring_index(body, "\n", 2)
    reason = lambda *r: F.array(*[F.lit(x) for x in r])
    role = lambda name, reasons: F.struct(F.lit(name).alias("role"), reasons.alias("reasons"))
    out = F.when(values.contains_identity(body, own), role("own_office", reason("own-identity")))
    for name, labels in OTHER_PARTIES:
        out = out.when(heading.rlike(rf"(?imuU)^\s*(?:{labels})(?=\s*:|\s*$)"), role(name, reason("other-party-role")))
    doc_role = F.lower(F.regexp_extract(body, DOCUMENT_ROLE, 1))
    named = F.when(doc_role != "", F.array(F.concat(F.lit("document-role:"), doc_role))).otherwise(F.array().cast("array<string>"))
    out = out.when(values.contains_identity(body, identities), role("customer", F.concat(reason("customer-identity-in-block"), named)))
    tail = F.trim(F.regexp_extract(heading, CUSTOMER_LINE, 1))
    other = (F.size(F.filter(identities, lambda i: F.trim(i) != "")) > 0) & (tail != "") & ~tail.rlike(f"^(?iuU){PHONE_LABEL}") & ~tail.contains("@")
    out = out.when(heading.rlike(CUSTOMER) & other, role("unknown", reason("customer-role-identity-unresolved")))
    return out.when(heading.rlike(CUSTOMER), role("customer", reason("explicit-customer-role"))).otherwise(role("unknown", reason("party-unresolved")))


def _fact(field: str, raw: Column, value: Column, reasons: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), raw.alias("raw"), value.alias("value"), reasons.alias("reasons"))


def _mails(line: Column) -> Column:
    raw = F.transform(F.regexp_extract_all(line, F.lit(EMAIL), F.lit(1)), lambda m: F.regexp_replace(m, r"\.+$", ""))
    return F.transform(raw, lambda m: _fact("email", m, values.email_address(m), F.array(F.lit("valid-email-syntax"))))


def _calls(line: Column, kind: Column, allowed: Column) -> Column:
    """Phone facts of a line: the nearest label before a number decides, within its cell of the line.

    The line is cut where a label or a cell begins, so each number is looked at once, with the label that heads its part.
    """
    none = F.array().cast("array<struct<field:string,raw:string,value:string,reasons:array<string>>>")

    def facts(scope: Column, odd: Column) -> Column:
        no, yes = scope.rlike(rf"(?iuU)^{NO_PHONE_LABEL}"), scope.rlike(rf"(?iuU)^{PHONE_LABEL}")

        def fact(raw: Column) -> Column:
            good = values.phone_allowed(raw, yes) & (yes | (~odd & ~kind.startswith("table"))) & ~F.regexp_replace(raw, "[()]", "").rlike(f"^(?:{values.DATE})$")
            return _fact("phone", raw, F.when(good, values.phone_number(raw)).otherwise(""), F.array(F.lit("valid-phone-plan"), F.when(yes, "contact-label").otherwise("unlabelled-phone")))

        return F.when(no, none).otherwise(F.transform(F.regexp_extract_all(scope, F.lit(NUMBER), F.lit(1)), fact))

    scopes = lambda odd: F.flatten(F.transform(F.split(line, SCOPE), lambda s: F.when(s.rlike("[0-9]"), facts(s, odd)).otherwise(none)))
    return F.when(allowed & line.rlike("[0+]") & line.rlike(NUMBER), once(line.rlike(r"\b[A-Z]{2}[0-9]{2}|[0-9][ \t]{2,}[0-9]"), scopes)).otherwise(none)


def channels(body: Column, kind: Column, phones: Column) -> Column:
    """The valid e-mail and phone facts of a text, line by line in order."""
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: x.rlike("[@0-9]"))
    facts = F.flatten(F.transform(lines, lambda x: F.concat(F.when(x.contains("@"), _mails(x)).otherwise(F.slice(_mails(x), 1, 0)), _calls(x, kind, phones))))
    return F.filter(facts, lambda f: f["value"] != "")


def contact_head(body: Column) -> Column:
    """(name, role) of a contact's lines; an empty name where none is plausible."""
    heading = F.regexp_replace(F.substring_index(body, "\n", 1), r"(?iuU)^\s*(?:ansprechpartner(?:in)?|kontaktperson|kontakt)\s*:?\s*", "")
    name = F.regexp_replace(F.element_at(F.split(heading, r"(?iuU)[|;,(]|\b(?:Tel\.?|Telefon|Mobil|E-?Mail)\s*:"), 1), r"^[ :]+|[ :]+$", "")
    plain = F.regexp_replace(name, r"(?iuU)^(?:herr|frau)\s+", "")
    name = F.when(values.person_name(plain), plain).when(values.person_name(name), name).otherwise("")
    role = lambda g: F.regexp_extract(body, r"(?iuU)\(([^)]+)\)|\b(?:rolle|funktion)\s*:\s*([^\n;|]+)", g)
    return F.struct(name.alias("name"), F.trim(F.coalesce(F.nullif(role(1), F.lit("")), role(2))).alias("role"))


def address(body: Column) -> Column:
    """(street, postal_code, city, reason) of a segment, or null: labelled, or a street line with a postal line behind; else one to be reviewed."""
    trimmed = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    plain = F.transform(trimmed, lambda x: F.trim(F.regexp_replace(x, r"(?iuU)^\s*(?:anschrift|adresse)\s*:\s*", "")))
    place = lambda street, code, city, reason: F.struct(street.alias("street"), code.alias("postal_code"), F.trim(city).alias("city"), F.lit(reason).alias("reason"))
    label = lambda name: F.trim(F.coalesce(F.try_element_at(F.regexp_extract_all(F.array_join(plain, "\n"), F.lit(rf"(?imuU)^(?:{name})\s*:\s*(.+)$"), F.lit(1)), F.lit(-1)), F.lit("")))  # noqa: E731  the last of its kind
    street, code, city = label("straße|strasse"), label("plz"), label("ort")
    labelled = F.when(street.rlike(STREET) & F.concat_ws(" ", code, city).rlike(POSTAL) & code.rlike("^[0-9]{5}$"), place(street, code, city, "complete-address-in-same-block"))

    def first(lines: Column, test, make) -> Column:
        """make(line, next line) of the first neighbours that pass the test."""
        both = F.zip_with(F.slice(lines, 1, F.greatest(F.size(lines), F.lit(1))), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.lit("")).alias("b")))
        return F.transform(F.slice(F.filter(both, lambda x: test(x["a"], x["b"])), 1, 1), lambda x: make(x["a"], x["b"]))

    whole = first(
        plain, lambda a, b: a.rlike(STREET) & b.rlike(POSTAL) & ~a.rlike(f"(?iuU){NO_PHONE_LABEL}") & ~a.rlike(r"(?iuU)^postfach\b"),
        lambda a, b: place(a, F.regexp_extract(b, POSTAL, 1), F.regexp_extract(b, POSTAL, 2), "complete-address-in-same-block"),
    )
    box = lambda a: a.rlike(r"(?iuU)^Postfach\s+[0-9 ]+$")

    def unsure(a: Column, b: Column) -> Column:
        code, city = F.regexp_extract(b, ANY_POSTAL, 1), F.regexp_extract(b, ANY_POSTAL, 2)
        reason = F.when(code == "", "incomplete-address-block").when(box(a), "postbox-address").otherwise("non-domestic-address-format")
        return F.struct(a.alias("street"), code.alias("postal_code"), city.alias("city"), reason.alias("reason"))

    maybe = first(trimmed, lambda a, b: box(a) | (a.rlike(STREET) & a.rlike(STREET_WORD)) | a.rlike(r"(?iuU)^[0-9]{1,5}\s+[\w .'-]+(?:Road|Street|Lane|Avenue)$"), unsure)
    return F.coalesce(labelled, F.get(whole, F.lit(0)), F.get(maybe, F.lit(0)))


def company(body: Column, identities: Column) -> Column:
    """The first line with a legal form, its role label removed, that names the customer where its identities are known; else null."""
    lines = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(?iuU)^\s*(?:auftraggeber|bauherr(?:in)?|kund(?:e|in)|rechnung\s+an|firma|absender|empfänger|von|an)\s*:\s*", "")))
    known = F.size(F.filter(identities, lambda i: F.trim(i) != "")) > 0
    good = F.filter(lines, lambda x: x.rlike(values.LEGAL_FORM) & ~x.rlike(r"(?iuU)@|\b(?:Tel|Telefon|Fax)\b") & (~known | values.contains_identity(x, identities)))
    return F.get(good, F.lit(0))


def folded(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), r"\s+", " "))


def document_candidates(blocks: DataFrame, doc_id: str = "doc_id", identities: str | None = None, own: str | None = None, path: str | None = None) -> DataFrame:
    """One row per distinct fact: doc_id, block, segment, field, raw, value, party, party_role, quality, reasons, excerpt.

    blocks has doc_id, block, kind and text; identities and own name array columns with the customer's and the office's own
    names; path a column with the file's name, whose spreadsheets give no phones. OCR blocks with the columns confidence, page
    and bbox are strong only with a confidence of 0.6 and a place. A column locator (see blocks.prepared) holds these fields instead and comes
    back with the segment's number. Facts of other parties are none; unknown parties
    are for review, and only the customer's segments give addresses and companies. Null texts give nothing.
    """
    none = F.array().cast("array<string>")
    there = set(blocks.columns)
    inside = "locator" in there
    of = lambda name: F.col(f"locator.{name}") if inside else F.col(name) if name in there else None
    rows = blocks.where(may_hold_facts(F.col("text")))
    rows = rows.withColumn("_ids", F.coalesce(F.col(identities), none) if identities else none).withColumn("_own", F.coalesce(F.col(own), none) if own else none)
    sheet = F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([^./]+)$", 1)).isin(*SPREADSHEETS) if path else F.lit(False)
    for name in ("sheet", "cell"):
        if of(name) is not None:
            sheet = sheet | (F.coalesce(of(name), F.lit("")) != "")
    rows = rows.withColumn("_phones", ~sheet & (F.col("kind") != "cell"))
    doubts = none
    if of("extraction_method") is not None:
        unsure = F.coalesce(F.lower(of("extraction_method")).rlike("ocr|tesseract"), F.lit(False))
        low = F.coalesce(of("confidence"), F.lit(0.0)) < 0.6 if of("confidence") is not None else F.lit(True)
        away = F.coalesce(F.size(of("bbox")), F.lit(0)).isin(0, -1) | of("page").isNull() if of("bbox") is not None and of("page") is not None else F.lit(True)
        doubts = F.filter(F.array(F.when(unsure & low, "ocr-quality-unverified"), F.when(unsure & away, "ocr-layout-unverified")), lambda x: x.isNotNull())
    more = ["locator"] if inside else []
    rows = segments_of(rows.withColumn("_doubts", doubts), doc_id, "_ids", "_own", "_phones", "_doubts", *more).where(may_hold_facts(F.col("text")))
    # exploded, so that filters stay behind it: a condition on p would be worked out by working p out once more
    rows = rows.withColumn("p", F.explode(F.array(party(F.col("text"), F.col("_ids"), F.col("_own"))))).where(F.col("p.role").isin("customer", "unknown"))
    strong = F.col("p.role") == "customer"
    rows = rows.withColumn("party", F.when(strong, "customer").otherwise(F.concat(F.lit("unresolved:"), F.substring(F.sha2(text.identity_key(F.col("text")), 256), 1, 20))))
    rows = rows.withColumn("parts", _split_before(F.col("text"), CONTACT_START))
    begins = F.get("parts", F.lit(0)).rlike(rf"(?iuU)^\s*{CONTACT_START}")
    rows = rows.withColumn("plain", F.when(begins, F.lit("")).otherwise(F.get("parts", F.lit(0)))).withColumn("contacts", F.when(begins, F.col("parts")).otherwise(F.slice("parts", 2, F.size("parts"))))

    def person(body: Column) -> Column:
        return F.transform(F.array(F.struct(contact_head(body).alias("who"), channels(body, F.col("kind"), F.col("_phones")).alias("found"))), lambda c: variants(c, body))[0]

    def variants(c: Column, body: Column) -> Column:
        """A contact with each e-mail and phone of its lines, one row per pair; without a name its channels stand alone."""
        of = lambda field: F.transform(F.filter(c["found"], lambda f: f["field"] == field), lambda f: f["raw"])
        or_none = lambda xs: F.when(F.size(xs) > 0, xs).otherwise(F.array(F.lit("")))
        to = F.concat(F.col("party"), F.lit(":contact:"), F.substring(F.sha2(text.identity_key(c["who"]["name"]), 256), 1, 20))

        def whole(mail: Column, phone: Column) -> Column:
            raw = F.to_json(F.struct(mail.alias("email"), c["who"]["name"].alias("name"), phone.alias("phone"), c["who"]["role"].alias("role")))
            value = F.to_json(
                F.struct(
                    F.nullif(values.email_address(mail), F.lit("")).alias("email"), F.nullif(folded(c["who"]["name"]), F.lit("")).alias("name"), F.nullif(values.phone_number(phone), F.lit("")).alias("phone"),
                    F.nullif(folded(c["who"]["role"]), F.lit("")).alias("role"),
                )
            )
            return F.struct(_fact("contact", raw, value, F.array(F.lit("named-contact-in-same-block"))).alias("f"), to.alias("party"), body.alias("excerpt"))

        named = F.flatten(F.transform(or_none(of("email")), lambda m: F.transform(or_none(of("phone")), lambda n: whole(m, n))))
        alone = F.transform(c["found"], lambda f: F.struct(f.alias("f"), F.col("party").alias("party"), body.alias("excerpt")))
        return F.when(c["who"]["name"] == "", alone).when(F.size(c["found"]) > 0, named).otherwise(F.slice(alone, 1, 0))

    plain = F.transform(channels(F.col("plain"), F.col("kind"), F.col("_phones")), lambda f: F.struct(f.alias("f"), F.col("party").alias("party"), F.col("text").alias("excerpt")))
    people = F.flatten(F.transform("contacts", person))
    where = address(F.col("text"))
    rows = rows.withColumn("_where", F.when(strong, where)).withColumn("_firm", F.when(strong, company(F.col("text"), F.col("_ids"))))
    own_fact = lambda f: F.struct(f.alias("f"), F.col("party").alias("party"), F.col("text").alias("excerpt"))
    street, code, city = F.col("_where.street"), F.col("_where.postal_code"), F.col("_where.city")
    place = _fact(
        "address", F.to_json(F.struct(city.alias("city"), code.alias("postal_code"), street.alias("street"))),
        F.to_json(F.struct(*[F.nullif(folded(x), F.lit("")).alias(n) for n, x in (("city", city), ("postal_code", code), ("street", street))])), F.array(F.col("_where.reason")),
    )
    firm = _fact("company", F.col("_firm"), folded(F.col("_firm")), F.array(F.lit("legal-form-in-customer-block")))
    single = F.concat(F.when(F.col("_where").isNotNull(), F.array(own_fact(place))).otherwise(F.slice(plain, 1, 0)), F.when(F.col("_firm").isNotNull(), F.array(own_fact(firm))).otherwise(F.slice(plain, 1, 0)))
    found = rows.select(doc_id, "block", "segment", "p", "_doubts", *more, F.explode(F.concat(plain, people, single)).alias("x"))
    whole = ~F.col("x.f.reasons")[0].isin("incomplete-address-block", "postbox-address", "non-domestic-address-format")
    quality = F.when((F.col("p.role") == "customer") & (F.size("_doubts") == 0) & whole, "strong").otherwise("review")
    out = found.select(
        doc_id, "block", "segment", F.col("x.f.field").alias("field"), F.col("x.f.raw").alias("raw"), F.col("x.f.value").alias("value"), F.col("x.party").alias("party"), F.col("p.role").alias("party_role"),
        quality.alias("quality"), F.concat("p.reasons", "x.f.reasons", "_doubts").alias("reasons"), text.excerpt(F.col("x.excerpt"), 600).alias("excerpt"),
        *[F.col("locator").withField("segment", F.col("segment")).alias("locator") for _ in more],
    )
    return out.dropDuplicates([doc_id, "block", "segment", "field", "value", "party"])
