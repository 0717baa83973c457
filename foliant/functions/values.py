"""Syntax of contact values as Column expressions: names, legal forms, dates, phone numbers, addresses and e-mail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import once
from .text import identity_key

# Words and shapes of German business documents.
TITLES = r"(?iuU)^(?:(?:herrn?|frau|mr|mrs|ms|miss|dr(?:[.-]ing)?|prof|med|ing|dipl[.-]?(?:ing|kfm|kffr))\.?(?:\s+|$))+"
PARTICLES = (
    "al", "bin", "binti", "da", "das", "de", "del", "della", "den", "der", "di", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "zu", "zum", "zur",
)
NO_NAMES = (
    "abteilung", "adresse", "angebot", "angebote", "anfrage", "anlage", "anlagen", "anschrift", "ansprechpartner", "ansprechpartnerin", "auftrag", "auftraggeber", "auftragnehmer", "bauantrag",
    "baubeschreibung", "bauherr", "bauherrin", "bauherrn", "bauleitung", "baustelle", "bauvorhaben", "bewehrungsplan", "bearbeitet", "bearbeitung", "berechnung", "bericht", "betreff", "bezeichnung",
    "büro", "buero", "contract", "datum", "date", "dokument", "dokumentation", "email", "entwurf", "erstellt", "fax", "firma", "für", "genehmigung", "info", "information", "ingenieurbüro",
    "ingenieurbuero", "inhalt", "inhaltsverzeichnis", "keine", "keinen", "kontakt", "kontaktperson", "kunde", "kundin", "landesbetrieb", "leistung", "leistungen", "leistungsbeschreibung",
    "leistungsverzeichnis", "mail", "mobil", "mobile", "name", "nachname", "nachtrag", "nachweis", "phone", "plan", "planung", "plz", "projekt", "projektleitung", "projektname", "protokoll",
    "prüfbericht", "quotation", "quote", "rechnung", "schalplan", "service", "statische", "statischer", "statisches", "statik", "team", "tel", "telefon", "telefax", "unbenannt", "unbekannt", "und",
    "unknown", "unnamed", "unterlagen", "unterschrift", "vertrag", "verwaltung", "vorname", "zeichnung", "zentrale", "zusammenstellung", "übersicht",
)
NO_NAME_SHAPE = (
    r"(?iuU)^(?:(?:projekt|bau|tragwerks|ausführungs|entwurfs|genehmigungs|vor|detail|brandschutz|schall|entwässerungs)(?:planung|plan|nachweis|berechnung|unterlagen|beschreibung)"
    r"|(?:leistungs|honorar|kosten|bau|werk|wartungs|dienstleistungs|rahmen)(?:angebot|vertrag|beschreibung|aufstellung|verzeichnis|nachweis|berechnung|übersicht)"
    r"|(?:angebots|vertrags|auftrags|rechnungs|leistungs)(?:anfrage|bestätigung|nummer|datum|übersicht|beschreibung|bedingungen|gegenstand|nachweis)|(?:schluss|teil|abschlags)rechnung)$"
)
NO_NAME_PHRASES = ("nicht angegeben", "nicht bekannt", "nicht vorhanden", "noch offen", "not available", "not known", "no name", "to be determined")
LEGAL_FORM = r"(?iuU)\b(gmbh(?:\s*&\s*co\.?\s*(?:kg|ohg))?|ug\s*\(haftungsbeschränkt\)|ag|kg|ohg|gbr|se|eg|e\.?\s*v\.?|ltd\.?|llc|inc\.?|sarl|s\.a\.)(?!\w)"
_SEP, _DAY, _MONTH = r"(?:[ \t]*[./\-‐-―][ \t]*|[ \t]+)", r"(?:0?[1-9]|[12][0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
DATE = rf"(?<![0-9])(?:{_DAY}{_SEP}{_MONTH}{_SEP}[0-9]{{2,4}}|[0-9]{{4}}{_SEP}{_MONTH}{_SEP}{_DAY})(?![0-9])"
EXTENSION = r"(?i)(?:[ \t]*(?:ext(?:ension)?\.?|durchwahl|x|#)[ \t:]*|;ext=)([0-9]{1,10})$"
#: Reserved top-level names that no mail is sent to.
RESERVED = ("arpa", "invalid", "local", "localhost", "onion", "test")


def legal_forms(name: Column) -> Column:
    """The distinct legal forms in a name, by identity key, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(name, F.lit(LEGAL_FORM), F.lit(1)), identity_key)))


def entity_type(name: Column, given_names: list[str]) -> Column:
    """Company by legal form; else person if some token is a given name."""
    tokens = F.split(identity_key(name), " ")
    return F.when(name.rlike(LEGAL_FORM), "company").when(F.arrays_overlap(tokens, F.array(*[F.lit(g.lower()) for g in given_names])), "person").otherwise("company")


def contains_identity(body: Column, identities: Column) -> Column:
    """Whether some identity's whole tokens stand in the text, in order; identities is an array, empty ones do not count."""
    line = F.concat(F.lit(" "), identity_key(body), F.lit(" "))
    keys = F.filter(F.transform(identities, identity_key), lambda k: k != "")
    return (F.size(identities) > 0) & once(line, lambda x: F.exists(keys, lambda k: F.contains(x, F.concat(F.lit(" "), k, F.lit(" ")))))


def person_name(value: Column) -> Column:
    """Whether a value may be a person's name: letters, initials and particles, no document words; one word only with a title or in a script without blanks."""
    raw = F.trim(value)
    name = F.trim(F.regexp_replace(raw, TITLES, ""))
    titled = F.length(name) < F.length(raw)
    parts = F.split(name, r"(?U)[\s,]+")
    words = F.transform(parts, lambda p: F.lower(F.regexp_replace(p, r"[^\p{L}\p{N}_]", "")))
    meant = F.filter(words, lambda w: ~w.isin(*PARTICLES))
    shape = name.rlike(r"^[\p{L}\p{M}\s'’ʼ.,\-‐‑‒–—―]+$") & ~name.rlike(LEGAL_FORM) & ~F.lower(F.regexp_replace(name, r"\s+", " ")).isin(*NO_NAME_PHRASES)
    few = (F.size(parts) <= 9) & (F.length(F.regexp_replace(name, "[^,]", "")) <= 1) & (F.length(raw) <= 120) & ~raw.rlike(r"[\p{C}]")
    clean = F.forall(words, lambda w: (w != "") & ~w.isin(*NO_NAMES) & ~w.rlike(NO_NAME_SHAPE)) & F.exists(meant, lambda w: F.length(w) > 1)
    one = (F.size(parts) == 1) & (F.length(name) >= 2) & name.rlike(r"^[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]+$")
    return F.coalesce((name != "") & shape & few & clean & ((F.size(meant) >= 2) | titled | one), F.lit(False))


def phone_allowed(raw: Column, labelled: Column) -> Column:
    """Syntax of a phone number in a document: a prefix and ordinary separators; bare national digits need a label; dates are none."""
    main = F.trim(F.regexp_replace(F.trim(raw), EXTENSION, ""))
    shape = main.rlike(r"^\+?[0-9() /\t\-‐-―]+$") & main.rlike(r"^(?:\+[1-9]|00[1-9]|0[1-9]|\(0[1-9])") & ~F.regexp_replace(main, r"^[ ()]+|[ ()]+$", "").rlike(f"^(?:{DATE})$")
    return shape & (labelled | main.startswith("+") | main.startswith("00") | main.rlike(r"[ ()/\t\-‐-―]"))


# Calling codes by zones, none of which begins another, and the shapes of German numbers behind theirs.
CALLING_CODES = (
    "20|21[12368]|22[0-9]|23[0-9]|24[0-9]|25[0-8]|26[0-9]|27|29[01789]", "3[0-469]|35[0-9]|37[0-8]|38[0-35-79]", "4[013-9]|42[013]", "5[1-8]|50[0-9]|59[0-9]", "6[0-6]|67[02-9]|68[0-35-9]|69[0-2]", "7",
    "8[1246]|80[08]|85[02356]|870|88[0-36]", "9[0-58]|96[0-8]|97[0-79]|99[2-68]",
)
GERMAN = "(?:[2-9][0-9]{5,10}|15[0-9]{8,9}|16[023][0-9]{7,8}|17[0-9]{8,9}|180[0-9]{4,8}|(?:800|900)[0-9]{6,9})"


def phone_number(raw: Column, country: str = "49") -> Column:
    """'+' and digits, with ';ext=' where there is an extension; empty where the calling code or the lengths rule the number out.

    German numbers have an area code from 2 to 9, a mobile or a service one; other numbers of the home country 6 to 13 digits; those behind +1 have 10 digits, all
    others 8 to 15 in all, behind a calling code that is given out. Area codes within other countries are not looked up.
    """
    extension = F.regexp_extract(raw, EXTENSION, 1)
    main = F.regexp_replace(F.regexp_replace(F.trim(raw), EXTENSION, ""), r"\(0\)", "")
    digits = F.regexp_replace(main, "[^0-9]", "")
    whole = F.when(F.trim(main).startswith("+"), digits).when(digits.startswith("00"), F.substring(digits, 3, 99)).when(digits.startswith("0"), F.concat(F.lit(country), F.substring(digits, 2, 99)))
    home = F.when(whole.startswith("49"), whole.rlike(f"^49{GERMAN}$")).otherwise(whole.rlike(f"^{country}[1-9][0-9]{{5,12}}$"))
    abroad = whole.rlike(f"^(?:{'|'.join(CALLING_CODES)})[0-9]+$") & F.length(whole).between(8, 15)
    fits = F.when(whole.startswith(country) | whole.startswith("49"), home).when(whole.startswith("1"), whole.rlike("^1[2-9][0-9]{9}$")).otherwise(abroad)
    number = F.concat(F.lit("+"), whole, F.when(extension != "", F.concat(F.lit(";ext="), extension)).otherwise(""))
    return F.when(~F.regexp_replace(main, r"^[ .;()]+|[ .;()]+$", "").rlike(f"^(?:{DATE})$") & F.coalesce(fits, F.lit(False)), number).otherwise("")


def email_address(raw: Column) -> Column:
    """The address with its domain in lower case; empty where its syntax or its domain is not allowed."""
    local, domain = F.substring_index(raw, "@", 1), F.lower(F.substring_index(raw, "@", -1))
    good = local.rlike(r"^[^.\s@](?:[^\s@]*[^.\s@])?$") & ~local.contains("..") & (F.length(local) <= 64)
    labels = domain.rlike(r"^(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?\.)+[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?$")
    last = F.substring_index(domain, ".", -1)
    return F.when(good & labels & ~last.isin(*RESERVED) & ~last.rlike("^[0-9]+$"), F.concat(local, F.lit("@"), domain)).otherwise("")
