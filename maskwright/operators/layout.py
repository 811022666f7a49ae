"""Page layout: extracted text items and recognised symbols to lines, text, boxes and rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.text import running
from maskwright.operators.intervals import overlap_join, points_in

# Distances as shares of the font or line height, padding, and characters of a page with text.
SAME_LINE, TAB_GAP, SPACE_GAP, NUMBER_GAP, SAME_ROW, BACK, PAD, FEW = 0.5, 1.5, 0.1, -0.3, 0.6, 0.5, 3.0, 25
# End of fixed values.

PAGE = ["doc_id", "page"]


def lines(items: DataFrame) -> DataFrame:
    """items (doc_id, page, x, y, w, h, text) with `line`: from the top, by the first item of each line.

    A fold over a page's items, from the top, notes where lines start; items then get their line's number by slices."""

    def add(acc: Column, i: Column) -> Column:
        same = (acc["n"] > 0) & (F.abs(i["y"] - acc["y"]) <= SAME_LINE * F.least(i["h"], acc["h"]))
        first = lambda c: F.when(same, acc[c]).otherwise(i[c]).alias(c)
        return F.struct((acc["n"] + 1).alias("n"), first("y"), first("h"), F.when(same, acc["starts"]).otherwise(F.array_append(acc["starts"], acc["n"])).alias("starts"))

    ordered = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "x", "y", "w", "h", "text"))).alias("i"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("y"), F.lit(0.0).alias("h"), F.array().cast("array<int>").alias("starts"))
    found = ordered.withColumn("starts", F.aggregate("i", start, add, lambda a: a["starts"]))
    numbered = """flatten(transform(starts, (s, n) -> transform(slice(i, s + 1, coalesce(get(starts, n + 1), size(i)) - s),
      t -> named_struct('x', t.x, 'y', t.y, 'w', t.w, 'h', t.h, 'text', t.text, 'line', n))))"""
    return found.select(*PAGE, F.inline(F.expr(numbered)))


def page_text(items: DataFrame) -> DataFrame:
    """doc_id, page, text: items of a line in order of x, with tabs and spaces for gaps, a newline after each line.
    A number beside a number or amount is parted even if they are almost flush."""
    by = Window.partitionBy(*PAGE, "line").orderBy("x")
    m = lines(items).withColumns({"reach": F.max(F.col("x") + F.col("w")).over(by.rowsBetween(Window.unboundedPreceding, -1)), "before": F.lag("text").over(by)})
    gap = F.col("x") - F.col("reach")
    numbers = F.col("before").rlike(r"\d\z") & F.col("text").rlike(r"^[-$(\d]") & (gap > NUMBER_GAP * F.col("h"))
    mark = F.when(F.col("reach").isNull(), "").when(gap > TAB_GAP * F.col("h"), "\t").when((gap > SPACE_GAP * F.col("h")) | numbers, " ").otherwise("")
    spaced = F.col("before").rlike(r"\s\z") | F.col("text").rlike(r"^\s")
    parts = m.withColumn("part", F.concat(F.when(spaced & (mark == " "), "").otherwise(mark), "text"))
    line = parts.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("x", "part"))).alias("p")).withColumn("t", F.array_join(F.transform("p", lambda x: x["part"]), ""))
    return line.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "t"))).alias("l")).select(*PAGE, F.array_join(F.transform("l", lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("text"))


def char_boxes(runs: DataFrame) -> DataFrame:
    """runs (doc_id, start, page, x, y, w, h, text, weights or null) as a box for each character: idx, page, x, y, w, h.
    A run's weights are summed once, from the left."""
    n = F.length("text")
    weights = F.coalesce("weights", F.transform(F.sequence(F.lit(1), n), lambda _: F.lit(1.0)))
    before = F.expr(running("__w", lambda a, b: f"{a} + {b}", "0D"))
    total = F.aggregate("__w", F.lit(0.0), lambda a, v: a + v)
    placed = runs.where(n > 0).withColumn("__w", weights).select("doc_id", "start", "page", "x", "y", "w", "h", "__w", before.alias("__b"), total.alias("__t"))
    e = placed.select("doc_id", "start", "page", "x", "y", "w", "h", "__t", F.posexplode(F.arrays_zip(F.col("__w").alias("v"), F.col("__b").alias("b"))).alias("k", "z"))
    x, w = F.col("x") + F.col("w") * F.col("z.b") / F.col("__t"), F.col("w") * F.col("z.v") / F.col("__t")
    return e.select("doc_id", (F.col("start") + F.col("k")).alias("idx"), "page", x.alias("x"), "y", w.alias("w"), "h")


def with_areas(found: DataFrame, areas: DataFrame) -> DataFrame:
    """Rectangles of findings and those that people drew (doc_id, page, x, y, w, h), each once: what is blacked out."""
    box = ["doc_id", "page", "x", "y", "w", "h"]
    return found.select(box).unionByName(areas.select(box)).distinct()


def symbols_text(symbols: DataFrame) -> DataFrame:
    """Recognised symbols (doc_id, page, paragraph, line, word, pos, text, x, w, y, h) as text with places: idx is
    where each symbol starts; words are parted by spaces, lines by newlines, paragraphs by empty lines."""
    by = Window.partitionBy(*PAGE).orderBy("paragraph", "line", "word", "pos")
    s = symbols.withColumns({c: F.lag(c.strip("_")).over(by) for c in ("paragraph_", "line_", "word_")})
    mark = F.when(F.col("word_").isNull(), "").when(F.col("paragraph_") != F.col("paragraph"), "\n\n").when(F.col("line_") != F.col("line"), "\n").when(F.col("word_") != F.col("word"), " ").otherwise("")
    s = s.withColumn("part", F.concat(mark, "text"))
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("idx", (F.sum(F.length("part")).over(so_far) - F.length("text")).cast("int")).drop("paragraph_", "line_", "word_")


def _joined_boxes(boxes: Column) -> Column:
    """Boxes of characters in order (page, x, y, w, h), one after another, as the rectangles that cover them."""

    def add(acc: Column, b: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        low, high = F.greatest(last["y"], b["y"]), F.least(last["y"] + last["h"], b["y"] + b["h"])
        beside = (b["x"] >= last["x"] - BACK * b["h"]) & (b["x"] <= last["x"] + last["w"] + b["h"])
        joins = F.coalesce((last["page"] == b["page"]) & (high - low > SAME_ROW * F.least(last["h"], b["h"])) & beside, F.lit(False))
        x, y = F.least(last["x"], b["x"]), F.least(last["y"], b["y"])
        w, h = (F.greatest(last[p] + last[q], b[p] + b[q]) - least for p, q, least in (("x", "w", x), ("y", "h", y)))
        grown = F.struct(last["page"].alias("page"), x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
        new = F.struct(b["page"].alias("page"), b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))
        return F.when(joins, F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), grown)).otherwise(F.array_append(acc, new))

    empty = F.array().cast("array<struct<page:int,x:double,y:double,w:double,h:double>>")
    shaped = F.transform(boxes, lambda b: F.struct(b["page"].cast("int").alias("page"), *(b[c].cast("double").alias(c) for c in ("x", "y", "w", "h"))))
    return F.aggregate(shaped, empty, add)


def _padded(joined: DataFrame) -> DataFrame:
    grown = [(F.col(c) - PAD).alias(c) for c in ("x", "y")] + [(F.col(c) + 2 * PAD).alias(c) for c in ("w", "h")]
    return joined.select("doc_id", "start", "end", "page", *grown)


def rectangles(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, start, end, page, x, y, w, h: the padded rectangles that cover each span's characters. boxes: a row for each
    character (idx), as of recognised symbols; see rectangles_of_runs for runs of text."""
    points = boxes.select("doc_id", "idx", "page", "x", "y", "w", "h")
    met = points_in(points, spans.select("doc_id", F.col("start").alias("__s"), F.col("end").alias("__e")).distinct(), ["doc_id"], "idx")
    per = met.groupBy("doc_id", F.col("__s").alias("start"), F.col("__e").alias("end")).agg(F.array_sort(F.collect_list(F.struct("idx", "page", "x", "y", "w", "h"))).alias("b"))
    return _padded(per.select("doc_id", "start", "end", F.inline(_joined_boxes(F.col("b")))))


#: The boxes of the characters of a run that a span covers: x and w of each by the weights before it.
_BOXES_IN_RUN = """transform(sequence(greatest(__s - start, 0), least(__e, __end) - start - 1), k -> named_struct('page', page,
  'x', x + w * get(__before, k) / __total, 'y', y, 'w', w * get(__weights, k) / __total, 'h', h))"""


def rectangles_of_runs(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """The same for runs of text (as char_boxes takes them): spans meet runs, not characters, and a run's boxes are made
    once they have met, for those alone that a span covers."""
    placed = runs.where(F.length("text") > 0).select("doc_id", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("text")).cast("int").alias("__end"), "page", "x", "y", "w", "h", F.col("weights").alias("__own"))
    met = overlap_join(placed, spans.select("doc_id", F.col("start").cast("int").alias("__s"), F.col("end").cast("int").alias("__e")).distinct(), ["doc_id"], ("start", "__end"))
    weighed = met.withColumn("__weights", F.coalesce("__own", F.transform(F.sequence(F.lit(1), F.col("__end") - F.col("start")), lambda _: F.lit(1.0)))).drop("__own")
    summed = weighed.select("*", F.expr(running("__weights", lambda a, b: f"{a} + {b}", "0D")).alias("__before"), F.aggregate("__weights", F.lit(0.0), lambda a, v: a + v).alias("__total"))
    own = summed.select("doc_id", F.col("__s").alias("s"), F.col("__e").alias("e"), "start", F.expr(_BOXES_IN_RUN).alias("b"))
    per = own.groupBy("doc_id", F.col("s").alias("start"), F.col("e").alias("end")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), "b"))).alias("r"))
    boxes = F.flatten(F.transform("r", lambda r: r["b"]))
    return _padded(per.select("doc_id", "start", "end", F.inline(_joined_boxes(boxes))))


def needs_ocr(items: DataFrame, forced: bool = False) -> DataFrame:
    """doc_id, page, needs_ocr: pages with hardly any text, or all."""
    return items.groupBy(*PAGE).agg(((F.coalesce(F.sum(F.length(F.trim("text"))), F.lit(0)) < FEW) | F.lit(forced)).alias("needs_ocr"))
