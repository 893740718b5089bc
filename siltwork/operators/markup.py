"""Markup as intervals: each tag and text of a document is a row with the places where it begins and ends.

A node lies inside another if its interval does, so ancestors, contents, nearest containers and captions are equi joins on the document with
a range condition, and Spark plans them. Only the cutting into tags is a map over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "lb", "graphic")
SILENT = ("script", "style", "head", "template", "noscript")
NODE = "begin int, end int, depth int, tag string, text string, at int, src string, alt string, rend string"


class _Cutter(HTMLParser):
    """Rows (begin, end, depth, tag, text, at, src, alt, rend); text nodes have no tag. at: characters of text before."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.place = self.at = 0

    def _add(self, tag, text, attrs=()) -> None:
        a = dict(attrs)
        self.rows.append([self.place, None, len(self.open), tag, text, self.at, a.get("src"), a.get("alt"), a.get("rend")])
        self.place += 1

    def handle_starttag(self, tag, attrs):
        self._add(tag, None, attrs)
        if tag in VOID:
            self.rows[-1][1] = self.rows[-1][0]
        else:
            self.open.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, None, attrs)
        self.rows[-1][1] = self.rows[-1][0]

    def handle_endtag(self, tag):
        if any(self.rows[i][3] == tag for i in self.open):
            while True:
                row = self.rows[self.open.pop()]
                row[1] = self.place
                if row[3] == tag:
                    break
            self.place += 1

    def handle_data(self, data):
        if data.strip():
            self._add(None, data)
            self.rows[-1][1] = self.rows[-1][0]
        self.at += len(data)

    def done(self) -> list[list]:
        self.close()
        for i in self.open:
            self.rows[i][1] = self.place
        return self.rows


def nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """(doc, begin, end, depth, tag, text, at, src, alt, rend) of the tags and texts of each row's markup; null markup has none."""
    kind = df.schema[key].dataType.simpleString()
    names = ["doc", *(f.split()[0] for f in NODE.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 3 + [pa.string()] * 2 + [pa.int32()] + [pa.string()] * 3
        for batch in batches:
            for i in range(batch.num_rows):
                cutter = _Cutter()
                cutter.feed(batch.column(1)[i].as_py() or "")
                rows = cutter.done()
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows))), *columns], names=names)

    return df.select(F.col(key), html).mapInArrow(run, f"doc {kind}, {NODE}")


def _inside(inner: str, outer: str) -> Column:
    return F.col(f"{inner}.doc").eqNullSafe(F.col(f"{outer}.doc")) & (F.col(f"{inner}.begin") > F.col(f"{outer}.begin")) & (F.col(f"{inner}.end") < F.col(f"{outer}.end"))


def _merged(outer: DataFrame, name: str) -> DataFrame:
    """The intervals of outer for a sort-merge join: they grow with the documents, and several such sides at once are too much for a driver to broadcast."""
    return outer.select("doc", "begin", "end").hint("merge").alias(name)


def inside_any(rows: DataFrame, outer: DataFrame, keep: bool) -> DataFrame:
    """rows that lie inside some node of outer, or (keep false) inside none."""
    return rows.alias("i").join(_merged(outer, "o"), _inside("i", "o"), "left_semi" if keep else "left_anti")


def audible(all_nodes: DataFrame) -> DataFrame:
    """The texts that readers see."""
    return inside_any(all_nodes.filter("tag is null"), all_nodes.filter(F.col("tag").isin(*SILENT)), False)


def contents(of: DataFrame, texts: DataFrame) -> DataFrame:
    """of with content: the texts inside each node in order, white space collapsed; empty for none."""
    pairs = texts.select("doc", "begin", "end", "text").alias("i").join(_merged(of, "o"), _inside("i", "o"))
    found = pairs.groupBy(F.col("o.doc").alias("c_doc"), F.col("o.begin").alias("c_begin")).agg(F.array_sort(F.collect_list(F.struct("i.begin", "i.text"))).alias("r"))
    flat = F.trim(F.regexp_replace(F.array_join(F.transform("r", lambda x: x["text"]), ""), r"\s+", " "))
    out = of.join(found.select("c_doc", "c_begin", flat.alias("content")), F.col("doc").eqNullSafe(F.col("c_doc")) & (F.col("begin") == F.col("c_begin")), "left")
    return out.withColumn("content", F.coalesce("content", F.lit(""))).drop("c_doc", "c_begin")


def nearest(of: DataFrame, outer: DataFrame) -> DataFrame:
    """of with container, the begin of the innermost node of outer around each; null for none."""
    pairs = of.select("doc", "begin", "end").alias("i").join(_merged(outer, "o"), _inside("i", "o"))
    found = pairs.groupBy(F.col("i.doc").alias("n_doc"), F.col("i.begin").alias("n_begin")).agg(F.max("o.begin").alias("container"))
    return of.join(found, F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("begin") == F.col("n_begin")), "left").drop("n_doc", "n_begin")


# --- main text ---

BLOCKS = ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption")
CONTAINERS = ("body", "main", "article", "section", "div", "aside", "ul", "ol", "table", "header", "footer", "nav", "form")
FURNITURE = ("nav", "footer", "aside", "form", "button")
MOST_LINKED = 0.4  # share of a container's text that may be links


def main_blocks(all_nodes: DataFrame) -> DataFrame:
    """(doc, begin, tag, content) of the blocks of a page's main text: outermost blocks of containers whose text is mostly no links.

    A block's container is the innermost one around it; a sidebar or a list of links goes by its density, whatever its tag.
    """
    texts = audible(all_nodes)
    texts = inside_any(texts, all_nodes.filter(F.col("tag").isin(*FURNITURE)), False)
    blocks = all_nodes.filter(F.col("tag").isin(*BLOCKS))
    blocks = inside_any(blocks, blocks, False)
    containers = all_nodes.filter(F.col("tag").isin(*CONTAINERS))
    linked = inside_any(texts, all_nodes.filter("tag = 'a'"), True).select("doc", "begin", F.lit(True).alias("linked"))
    sized = texts.join(linked, ["doc", "begin"], "left").select("doc", "begin", "end", F.length(F.trim("text")).alias("n"), F.coalesce("linked", F.lit(False)).alias("linked"))
    density = nearest(sized, containers).groupBy("doc", "container").agg((F.sum(F.when(F.col("linked"), F.col("n")).otherwise(0)) / F.sum("n")).alias("density"))
    density = density.select(F.col("doc").alias("d_doc"), F.col("container").alias("d_container"), "density")
    rows = contents(nearest(blocks, containers), texts).filter("content <> ''")
    rows = rows.join(density, F.col("doc").eqNullSafe(F.col("d_doc")) & F.col("container").eqNullSafe(F.col("d_container")), "left")
    return rows.filter(F.coalesce("density", F.lit(0.0)) <= MOST_LINKED).select("doc", "begin", "tag", "content")


# --- TEI ---

TEI_BLOCKS = ("head", "p", "list", "code", "table", "quote")
TEI_SKIPPED = ("teiheader", "graphic", "lb")


def tei_elements(all_nodes: DataFrame) -> DataFrame:
    """(doc, pos, type, text_level, text, table_caption) of a TEI document's blocks in order.

    The first head of rend h1 is level 1, other ones level 2; h2 and h3 are levels 2 and 3; heads of another rend and quotes are text. Items are lines with a dash, cells
    and rows an HTML table, whose caption is a text `Table N` right before it. Empty blocks aren't elements.
    """
    # a root is a block that no other encloses; its nodes come as one row, after the only shuffle, which is by document
    begun = Window.partitionBy("doc").orderBy("begin")
    before = begun.rowsBetween(Window.unboundedPreceding, -1)
    last_end = lambda c: F.coalesce(F.max(F.when(c, F.col("end"))).over(before), F.lit(-1))
    block = F.col("tag").isin(*TEI_BLOCKS)
    n = all_nodes.select("doc", "begin", "end", "tag", "text", "rend").withColumns({"skipped": last_end(F.col("tag").isin(*TEI_SKIPPED)) > F.col("end"), "root": F.coalesce(block, F.lit(False)) & (last_end(block) < F.col("end"))})
    n = n.withColumn("r", F.last(F.when(F.col("root"), F.struct("begin", "end")), ignorenulls=True).over(begun)).filter(F.col("end") <= F.col("r.end"))
    n = n.groupBy("doc", F.col("r.begin").alias("root")).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "tag", "text", "rend", "skipped"))).alias("r"))

    r = F.col("r")
    within = lambda i, o: (i["begin"] > o["begin"]) & (i["end"] < o["end"])
    free = lambda x, tags, o=None: ~F.exists(r, lambda y: F.coalesce(y["tag"].isin(*tags), F.lit(False)) & within(x, y) & (F.lit(True) if o is None else y["begin"] > o["begin"]))
    said = lambda o: F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(r, lambda x: x["tag"].isNull() & within(x, o)), lambda x: x["text"]), ""), r"\s+", " "))
    nearest_in = lambda o, tag, outer: F.filter(r, lambda x: F.coalesce(x["tag"] == tag, F.lit(False)) & within(x, o) & free(x, (outer,), o))
    blocks = F.filter(r, lambda x: F.coalesce(x["tag"].isin(*TEI_BLOCKS), F.lit(False)) & ~x["skipped"] & free(x, TEI_BLOCKS))
    e = n.select("doc", "r", F.explode(blocks).alias("b")).select("doc", "r", "b", "b.begin", "b.tag", "b.rend")
    b = F.col("b")
    listed = F.array_join(F.transform(F.filter(F.transform(nearest_in(b, "item", "list"), said), lambda x: x != ""), lambda x: F.concat(F.lit("- "), x)), "\n")
    cells = lambda row: F.transform(nearest_in(row, "cell", "row"), lambda x: F.concat(F.lit("<td>"), said(x), F.lit("</td>")))
    rows = F.filter(F.transform(nearest_in(b, "row", "table"), lambda x: F.array_join(cells(x), "")), lambda x: x != "")
    rows = F.array_join(F.transform(rows, lambda x: F.concat(F.lit("<tr>"), x, F.lit("</tr>"))), "")
    body = F.when(F.col("tag") == "list", listed).when(F.col("tag") == "table", F.concat(F.lit("<table>"), F.nullif(rows, F.lit("")), F.lit("</table>"))).otherwise(said(b))
    kind = F.when(F.col("tag").isin("list", "code", "table"), F.col("tag")).otherwise("text")
    e = e.select("doc", "begin", kind.alias("type"), "tag", "rend", body.alias("text")).filter("text is not null and text <> ''")
    order = Window.partitionBy("doc").orderBy("begin")
    top = (F.col("tag") == "head") & (F.col("rend") == "h1")
    first = F.min(F.when(top, F.col("begin"))).over(Window.partitionBy("doc"))
    head = F.col("tag") == "head"
    level = F.when(top, F.when(F.col("begin") == first, 1).otherwise(2)).when(head & (F.col("rend") == "h2"), 2).when(head & (F.col("rend") == "h3"), 3)
    before = F.when((F.lag("type").over(order) == "text") & F.regexp_like(F.lag("text").over(order), F.lit("^Table [0-9]+")), F.lag("text").over(order))
    e = e.withColumns({"text_level": level, "pos": F.row_number().over(order).cast("long"), "table_caption": F.when(F.col("type") == "table", F.coalesce(before, F.lit("")))})
    return e.select("doc", "pos", "type", "text_level", "text", "table_caption")


# --- images ---

NEAR = 600  # characters of text on either side in which a caption may stand
NO_IMAGE = r"(?i)^data:|icon|logo|pixel|\.svg$"


def captioned_images(all_nodes: DataFrame) -> DataFrame:
    """(doc, src, alt, caption) of each distinct image but icons, logos and data: the caption of the figure around it, else the nearest text that begins with Figure or Fig. and a number within NEAR characters."""
    images = all_nodes.filter((F.col("tag") == "img") & (F.col("src") != "") & ~F.regexp_like("src", F.lit(NO_IMAGE)))
    images = images.groupBy("doc", "src").agg(F.min_by(F.struct("begin", "end", "at", "alt"), "begin").alias("m")).select("doc", "src", "m.*")
    texts = audible(all_nodes)
    figures = all_nodes.filter("tag = 'figure'")
    inside = nearest(images, figures)
    captions = nearest(contents(all_nodes.filter("tag = 'figcaption'"), texts), figures).filter("container is not null and content <> ''")
    captions = captions.groupBy(F.col("doc").alias("f_doc"), F.col("container").alias("f_at")).agg(F.min_by("content", "begin").alias("own"))
    rows = inside.join(captions, F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("container") == F.col("f_at")), "left")
    said = texts.filter(F.regexp_like(F.trim("text"), F.lit(r"^Fig(?:ure|\.)\s*[0-9]+"))).select(F.col("doc").alias("s_doc"), F.col("at").alias("s_at"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("said"))
    near = images.join(said, F.col("doc").eqNullSafe(F.col("s_doc")) & F.col("s_at").between(F.col("at") - NEAR, F.col("at") + NEAR))
    near = near.groupBy(F.col("doc").alias("n_doc"), F.col("src").alias("n_src")).agg(F.min_by("said", F.struct(F.abs(F.col("s_at") - F.col("at")), F.col("s_at"))).alias("near"))
    rows = rows.join(near, F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("src") == F.col("n_src")), "left")
    return rows.select("doc", "src", "alt", F.coalesce("own", "near").alias("caption"))
