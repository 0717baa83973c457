"""Layout of positioned words: lines, gutters between columns, and paragraphs with their boxes, page by page."""

from __future__ import annotations

from statistics import median

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Points between tops of words in a line; the least gutter and in heights; the least gap of a paragraph's lines and in heights; how far lines may begin apart; how far a line may reach into the one above.
LINE, GUTTER, GUTTER_HEIGHTS, GAP, GAP_HEIGHTS, INDENT, OVERLAP = 3.0, 24.0, 3.0, 7.0, 0.85, 12.0, 1.0


def line_numbers(tops: np.ndarray) -> np.ndarray:
    """The line of each word, tops ascending: a line takes the words whose tops are near that of its first."""
    out, line, first = np.zeros(len(tops), np.int64), -1, -np.inf
    for i, top in enumerate(tops.tolist()):
        if top - first > LINE:
            line, first = line + 1, top
        out[i] = line
    return out


def page_blocks(x0, x1, top, bottom, words) -> list[tuple]:
    """(text, x0, y0, x1, y1, words) of a page's paragraphs, in the order in which they begin.

    A line is parted where a gap is wider than a gutter, which the median height of its words scales. A part continues the paragraph whose last
    line ends closest above it and whose left edge is near its own; parts of one row never meet.
    """
    order = np.lexsort((x0, top))
    lines = np.zeros(len(order), np.int64)
    lines[order] = line_numbers(top[order])
    order = np.lexsort((x0, lines))
    words = [words[i] for i in order]
    edges = (np.flatnonzero(np.diff(lines[order])) + 1).tolist()
    whole = not any(np.isnan(c).any() for c in (x0, x1, top, bottom))
    # a few numbers at a time: plain lists, unless places are missing
    x0, x1, top, bottom = (c[order].tolist() for c in (x0, x1, top, bottom))
    least, most, middle = (min, max, median) if whole else (lambda xs: float(np.min(xs)), lambda xs: float(np.max(xs)), lambda xs: float(np.median(xs)))
    starts = [0, *edges, len(words)]
    heights = [middle([d - c for c, d in zip(top[a:b], bottom[a:b], strict=True)]) for a, b in zip(starts, starts[1:], strict=False) if b > a]
    reach = max([GAP, *(GAP_HEIGHTS * h for h in heights)])
    said: list[list[str]] = []
    lefts, boxes, sizes = [], [], []
    near: list[int] = []  # paragraphs that a line can still continue: tops only grow
    for a, b, height in zip(starts, starts[1:], heights, strict=False):
        if whole:
            here = least(top[a:b])
            near = [k for k in near if here - boxes[k][3] <= reach]
        gutter, gap_most, indent = max(GUTTER, GUTTER_HEIGHTS * height), max(GAP, GAP_HEIGHTS * height), max(INDENT, height)
        limits = [a, *(i for i in range(a + 1, b) if x0[i] - x1[i - 1] > gutter), b]
        for i, j in zip(limits, limits[1:], strict=False):
            box = [least(x0[i:j]), least(top[i:j]), most(x1[i:j]), most(bottom[i:j])]
            at, closest = -1, np.inf
            for k in near:
                gap = box[1] - boxes[k][3]
                if -OVERLAP <= gap <= gap_most and gap < closest and abs(lefts[k] - x0[i]) <= indent:
                    at, closest = k, gap
            if at < 0:
                near.append(len(said))
                said.append([" ".join(words[i:j])])
                lefts.append(x0[i])
                boxes.append(box)
                sizes.append(j - i)
            else:
                said[at].append(" ".join(words[i:j]))
                old = boxes[at]
                boxes[at] = [least([old[0], box[0]]), least([old[1], box[1]]), most([old[2], box[2]]), most([old[3], box[3]])]
                sizes[at] += j - i
    return [("\n".join(s), *map(float, b), n) for s, b, n in zip(said, boxes, sizes, strict=True)]


def layout_blocks(words: DataFrame, doc_id: str, page: str = "page", max_pages: int | None = None) -> DataFrame:
    """(doc_id, page, block, text, bbox, words) of positioned words (doc_id, page, x0, x1, top, bottom, text).

    Pages are laid out apart, so a document of any length spreads over tasks. Beyond max_pages pages are left out; see page_states for
    what that makes of the document. Words without text are left out.
    """
    rows = words.where("trim(text) <> ''")
    if max_pages is not None:
        rows = rows.where(F.col(page) <= max_pages)
    kinds = dict(rows.dtypes)
    box = ["x0", "x1", "top", "bottom"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            places, texts = [flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in box], flat.field("text").to_pylist()
            cuts = np.cumsum([0, *lists.value_lengths().to_pylist()])
            found = [page_blocks(*(p[a:b] for p in places), texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            text, *sides, n = zip(*(f for page_ in found for f in page_), strict=True) if len(at) else [()] * 6
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array([i for page_ in found for i in range(len(page_))], pa.int32()), pa.array(text, pa.string())]
            columns += [pa.array(list(map(list, zip(*sides, strict=True))), pa.list_(pa.float64())), pa.array(n, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, [doc_id, page, "block", "text", "bbox", "words"])

    schema = f"`{doc_id}` {kinds[doc_id]}, `{page}` {kinds[page]}, block int, text string, bbox array<double>, words int"
    pages = rows.groupBy(doc_id, page).agg(F.collect_list(F.struct(*[F.col(c).cast("double").alias(c) for c in box], "text")).alias("words"))
    return pages.mapInArrow(run, schema)


def page_states(pages: DataFrame, words: DataFrame, doc_id: str, page: str = "page", max_pages: int | None = None) -> DataFrame:
    """(doc_id, pages_total, pages_processed, empty_pages, status, reason) of documents: partial where pages lie beyond the budget."""
    there = words.where("trim(text) <> ''").select(doc_id, page).distinct().withColumn("_has", F.lit(1))
    within = F.lit(True) if max_pages is None else F.col(page) <= max_pages
    sums = pages.select(doc_id, page).distinct().join(there, [doc_id, page], "left").groupBy(doc_id)
    out = sums.agg(F.count("*").alias("pages_total"), F.count_if(within).alias("pages_processed"), F.count_if(within & F.col("_has").isNull()).alias("empty_pages"))
    cut = F.col("pages_processed") < F.col("pages_total")
    return out.withColumns({"status": F.when(cut, "partial").otherwise("ok"), "reason": F.when(cut, "page_budget").otherwise("")})
