"""File sources: trees of files as rows, and readers that turn their bytes into text blocks on the executors."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as text_functions

TEXT = ("txt", "csv", "md", "log", "json", "xml", "yaml", "yml", "ini")
#: Extensions whose readers need a tool that is not part of Python or Spark.
NEEDS_TOOL = ("pdf", "doc", "xls", "png", "jpg", "jpeg", "tif", "tiff")
#: Cells that are read of one workbook; a larger one is partial. Fixed value.
MOST_CELLS = 200_000
#: Number formats that a workbook need not define and that show dates or times. Fixed values.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: Bytes that an office file may unpack to; a larger one is not read.
MOST_UNPACKED = 1 << 28
BLOCKS = "array<struct<text:string,kind:string,section:string,sheet:string,cell:string>>"


def _listed(rows: DataFrame, root: str, excluded: list[str]) -> DataFrame:
    base = F.regexp_replace(F.lit(root.rstrip("/")), r"^file:/+", "/")
    path = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), r"^/+", "/")
    relative = F.expr("substring(p, length(b) + 2)")
    rows = rows.withColumn("p", path).withColumn("b", base).withColumn("relative_path", relative)
    parts = F.split(F.lower("relative_path"), "/")
    for name in excluded:
        rows = rows.where(~F.array_contains(parts, name.lower()))
    filename = F.element_at(F.split("relative_path", "/"), -1)
    extension = F.when(filename.contains("."), F.lower(F.element_at(F.split(filename, r"\."), -1))).otherwise("")
    return rows.select("relative_path", filename.alias("filename"), extension.alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), *(["content"] if "content" in rows.columns else []))


def scan_files(spark: SparkSession, root: str, excluded: list[str] = (), only: list[str] | None = None) -> DataFrame:
    """(relative_path, filename, extension, size, modified, content) of the files below root; excluded names are whole path segments, in any case.

    only names the relative paths of the files that are read; all others are not opened.
    """
    reader = spark.read.format("binaryFile")
    if only is None:
        return _listed(reader.option("recursiveFileLookup", "true").load(root), root, excluded)
    escaped = [re.sub(r"([\\*?\[\]{}])", r"\\\1", f"{root.rstrip('/')}/{p}") for p in only]
    return _listed(reader.load(escaped), root, excluded)


def list_files(spark: SparkSession, root: str, excluded: list[str] = ()) -> DataFrame:
    """scan_files without content: files are listed and none is opened."""
    return _listed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).drop("content"), root, excluded)


def newest_first(files: DataFrame) -> DataFrame:
    """files in reading order: by their top folder's greatest number downward (years first), then by path without case."""
    top = F.substring_index("relative_path", "/", 1)
    return files.orderBy(F.desc(top.rlike("^[0-9]+$")), F.desc(F.when(top.rlike("^[0-9]+$"), top.cast("long"))), F.lower("relative_path"), "relative_path")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a list of words: comments from '#' on and blank lines are skipped, the rest is trimmed and lower-cased, each word once."""
    lines = spark.read.text(path).select(F.lower(F.trim(F.regexp_replace("value", "#.*$", ""))).alias("word"))
    return lines.where("word <> ''").distinct()


def ineligible(extension: Column, size: Column, enabled: bool, extensions: list[str], most_bytes: int) -> Column:
    """Why a file's text is not read, or null: disabled, too_large, extension_disabled, unsupported_extension in this order."""
    known = [*TEXT, "docx", "xlsx", *NEEDS_TOOL]
    return F.when(F.lit(not enabled), "disabled").when(size > most_bytes, "too_large").when(~extension.isin(extensions), "extension_disabled").when(~extension.isin(known), "unsupported_extension")


def text_of(content: Column) -> Column:
    """Bytes as UTF-8 with replacement characters."""
    return F.make_valid_utf8(content.cast("string"))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def docx_blocks(data: bytes) -> list[dict]:
    """Paragraphs and table rows (cells joined by tabs) of headers, body and footers."""
    blocks = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header\d*|document|footer\d*)\.xml", n))
        for name in sorted(names, key=lambda n: ("header" not in n, "document" not in n, n)):
            section = re.sub(r"\d", "", name.split("/")[1].split(".")[0])
            body = ElementTree.fromstring(z.read(name))
            inside = {p for table in body.iter() if _local(table.tag) == "tbl" for p in table.iter() if _local(p.tag) == "p"}
            said = lambda node: "".join("\t" if _local(x.tag) == "tab" else x.text or "" for x in node.iter() if _local(x.tag) in ("t", "tab"))
            for node in body.iter():
                if _local(node.tag) == "tr":
                    text, kind = "\t".join(said(c).strip() for c in node if _local(c.tag) == "tc"), "row"
                elif _local(node.tag) == "p" and node not in inside:
                    text, kind = said(node), "paragraph"
                else:
                    continue
                if text.strip():
                    blocks.append({"text": text, "kind": kind, "section": section, "sheet": None, "cell": None})
    return blocks


def xlsx_masks(z: zipfile.ZipFile) -> list[str]:
    """What the number of a cell is shown by, for each cell style: a mask, `@date`, or nothing special."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode", "") for x in root.iter() if _local(x.tag) == "numFmt"}

    def mask(i: int) -> str:
        code = own.get(i, "")
        letters = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
        return "@date" if i in DATE_FORMATS or re.search("[dmyhs]", letters, re.IGNORECASE) and "general" not in letters.lower() else code

    styles = next((x for x in root if _local(x.tag) == "cellXfs"), ())
    return [mask(int(x.get("numFmtId") or 0)) for x in styles]


def xlsx_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, file) of the sheets in the workbook's order, by its relations; by the files' numbers where it has none."""
    names = set(z.namelist())
    sheets = [s for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    if "xl/_rels/workbook.xml.rels" in names:
        target = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        refs = [next((v for k, v in s.attrib.items() if _local(k) == "id"), None) for s in sheets]
        files = [t.lstrip("/") if (t := target.get(r, "")).startswith("/") else f"xl/{t}" for r in refs]
    else:
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[1])[0]))
    return [(s.get("name"), f) for s, f in zip(sheets, files, strict=False) if f in names]


def xlsx_blocks(data: bytes) -> list[dict]:
    """Non-empty cells with their sheet and coordinate; formulas without a stored value have kind formula_result_missing."""
    blocks: list[dict] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        strings = []
        if "xl/sharedStrings.xml" in names:
            strings = ["".join(t.text or "" for t in item.iter() if _local(t.tag) == "t") for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(item.tag) == "si"]
        masks = xlsx_masks(z)
        for title, name in xlsx_sheets(z):
            for cell in ElementTree.fromstring(z.read(name)).iter():
                if _local(cell.tag) != "c":
                    continue
                parts = {_local(x.tag): x for x in cell.iter()}
                value = parts["v"].text if "v" in parts else "".join(x.text or "" for x in cell.iter() if _local(x.tag) == "t") or None
                kind = "formula_result_missing" if value is None and "f" in parts else "cell"
                if cell.get("t") == "s" and value is not None:
                    value = strings[int(value)]
                elif cell.get("t") == "b" and value is not None:
                    value = "TRUE" if value == "1" else "FALSE"
                if value or kind != "cell":
                    style, plain = int(cell.get("s") or 0), cell.get("t") in (None, "n") and value is not None
                    mask = masks[style] if plain and style < len(masks) else ""
                    blocks.append({"text": value or "", "kind": kind, "section": None, "sheet": title, "cell": cell.get("r"), "number": float(value) if mask else None, "mask": mask or None})
                    if len(blocks) > MOST_CELLS:
                        return blocks
    return blocks


def _shown(b: Column) -> Column:
    """A block as its sheet shows it: numbers by their masks, dates by ISO."""
    day = F.date_format(F.timestamp_seconds(F.round((b["number"] - 25_569) * 86_400)), "yyyy-MM-dd'T'HH:mm:ss")  # days from the end of 1899
    said = F.when(b["mask"] == "@date", day).when(b["number"].isNotNull(), text_functions.display_number(b["number"], b["mask"])).otherwise(b["text"])
    return F.struct(said.alias("text"), *[b[c].alias(c) for c in ("kind", "section", "sheet", "cell")])


def read_blocks(files: DataFrame) -> DataFrame:
    """files (of scan_files) with status and blocks: ok, tool_missing, unsupported, or error for damaged files; one bad file fails alone.

    Texts and sheets are read whole; bound files by their size with `ineligible` before reading.
    """

    @F.pandas_udf(f"struct<status:string,blocks:{BLOCKS[:-2]},number:double,mask:string>>>")
    def office(extension, content):
        import pandas as pd

        status, blocks = [], []
        for kind, data in zip(extension, content, strict=True):
            try:
                found, data = [], bytes(data)
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    large = sum(i.file_size for i in z.infolist()) > MOST_UNPACKED
                found = [] if large else (docx_blocks if kind == "docx" else xlsx_blocks)(data)
                cut = kind == "xlsx" and len(found) > MOST_CELLS
                found = found[:MOST_CELLS] if cut else found
                status.append("too_large" if large else "partial" if cut else "partial" if any(b["kind"] == "formula_result_missing" for b in found) else "ok")
            except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError):
                found = []
                status.append("error")
            blocks.append(found)
        return pd.DataFrame({"status": status, "blocks": blocks})

    plain = F.array(F.struct(text_of(F.col("content")).alias("text"), F.lit("text").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in ("section", "sheet", "cell")]))
    nothing = F.array().cast(BLOCKS)
    text = files.where(F.col("extension").isin(*TEXT)).withColumns({"status": F.lit("ok"), "blocks": plain})
    rest = files.where(~F.col("extension").isin(*TEXT, "docx", "xlsx")).withColumns({"status": F.when(F.col("extension").isin(*NEEDS_TOOL), "tool_missing").otherwise("unsupported"), "blocks": nothing})
    made = files.where(F.col("extension").isin("docx", "xlsx")).withColumn("made", office("extension", "content")).withColumns({"status": F.col("made.status"), "blocks": F.transform("made.blocks", _shown)}).drop("made")
    return text.unionByName(rest).unionByName(made).drop("content")


def word_lines(words: DataFrame, page: list[str], tolerance: float = 3.0) -> DataFrame:
    """Lines of positioned words (x0, x1, top, bottom, text): a word more than the tolerance below the one before starts a line."""
    from pyspark.sql import Window

    w = Window.partitionBy(*page).orderBy("top", "x0")
    starts = F.when(F.col("top") - F.lag("top").over(w) <= tolerance, 0).otherwise(1)
    rows = words.withColumn("_s", starts).withColumn("line", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(*page, "line").agg(joined.alias("text"), F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))


def ocr_blocks(words: DataFrame, scale: float = 1.0) -> DataFrame:
    """Blocks of OCR words (page, block, paragraph, line, word, left, top, width, height, conf, text): lines joined, box and mean confidence."""
    rows = words.where("level = 5 AND trim(text) <> ''")
    said = F.transform(F.sort_array(F.collect_list(F.struct("line", "word", "text"))), lambda x: x["text"])
    box = [F.min(F.col("left") * scale).alias("x0"), F.min(F.col("top") * scale).alias("y0"), F.max((F.col("left") + F.col("width")) * scale).alias("x1"), F.max((F.col("top") + F.col("height")) * scale).alias("y1")]
    return rows.groupBy("page", "block", "paragraph").agg(F.array_join(said, " ").alias("text"), *box, (F.avg(F.when(F.col("conf") >= 0, F.col("conf"))) / 100).alias("confidence"))
