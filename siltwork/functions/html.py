"""HTML, table and JSON functions as column expressions, and element parsers as Arrow-batched maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


TAG_END = r"""(?:[^>"']|"[^"]*"|'[^']*')*>"""


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value, in double, single or no quotes; null without it."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))
    return F.when(F.regexp_like(tag, F.lit(pattern)), unescape(value))


def meta_values(html: Column, name: str) -> Column:
    """Contents of the <meta> tags of a name, attributes in any order and quoting, trimmed, empty ones left out."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b" + TAG_END), F.lit(0))
    mine = F.filter(tags, lambda t: F.lower(attribute(t, "name")) == name.lower())
    return F.filter(F.transform(mine, lambda t: F.trim(attribute(t, "content"))), lambda c: c.isNotNull() & (c != ""))


def json_ld(html: Column, schema: str) -> Column:
    """The page's JSON-LD block, parsed; null without one."""
    return F.from_json(F.nullif(F.regexp_extract(html, '(?is)<script type="application/ld\\+json">(.*?)</script>', 1), F.lit("")), schema)


def free_pdf(url: Column, html: Column) -> Column:
    """The arXiv copy where the page names one (an arXiv address or arxiv: before the id), else its first link to a PDF as an absolute address; null for none."""
    arxiv = F.nullif(F.regexp_extract(html, r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|arxiv:\s*)([0-9]{4}\.[0-9]{4,6})", 1), F.lit(""))
    link = F.nullif(F.regexp_extract(html, r"""(?i)<a[^>]*href=["']([^"']*?\.pdf[^"']*)["']""", 1), F.lit(""))
    scheme, site, folder = (F.regexp_extract(url, p, 1) for p in ("^([a-zA-Z]+:)//", "^([a-zA-Z]+://[^/?#]*)", "^([a-zA-Z]+://[^?#]*/)"))
    absolute = (
        F.when(F.regexp_like(link, F.lit("^[a-zA-Z]+://")), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link)).otherwise(F.concat(F.when(folder == F.concat(scheme, F.lit("//")), F.concat(site, F.lit("/"))).otherwise(folder), link))
    )
    return F.coalesce(F.concat(F.lit("https://arxiv.org/pdf/"), arxiv), absolute)


def headings_to_markdown(html: Column) -> Column:
    """<h1> to <h6> as lines with at most four signs."""
    for level in range(1, 7):
        html = F.regexp_replace(html, f"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * min(level, 4) + " $1\n")
    return html


def inline_math(html: Column) -> Column:
    """<math> as $tex$ from its annotation, else from alttext; an image of a formula by its alt text."""
    html = F.regexp_replace(html, r'(?is)<math[^>]*>.*?<annotation[^>]*tex"[^>]*>(.*?)</annotation>.*?</math>', r"\$$1\$")
    html = F.regexp_replace(html, r'(?is)<math[^>]*?alttext="([^"]*)"[^>]*>.*?</math>', r"\$$1\$")
    return F.regexp_replace(html, r'(?is)<img[^>]*?class="[^"]*math[^"]*"[^>]*?alt="([^"]*)"[^>]*>', r"\$$1\$")


def images(html: Column) -> Column:
    """Distinct sources of images but icons, logos and data URLs, in order."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<img[^>]*?src="([^"]+)"'), F.lit(1)))
    return F.filter(found, lambda s: ~F.regexp_like(F.lower(s), F.lit("^data:|icon|logo|pixel|\\.svg$")))


def main_text(html: Column) -> Column:
    """Readable text: scripts, styles, navigation, footers and comments go, block ends become line ends, entities are read."""
    for tag in ("script", "style", "nav", "footer", "head"):
        html = F.regexp_replace(html, f"(?is)<{tag}[ >].*?</{tag}>", "")
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    html = F.regexp_replace(html, "(?i)<br[^>]*>|</(p|div|h[1-6]|li|article|section|tr)>", "\n")
    text = unescape(F.regexp_replace(html, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ?\n[ \n]*", "\n"))


def table_rows(html: Column) -> Column:
    """Cells of each row of a table, tags dropped."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit("(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", "")))
    return F.transform(rows, cells)


def table_to_markdown(html: Column) -> Column:
    """A GFM table; short rows are padded to the longest."""
    rows = table_rows(html)
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")


def json_salvage(raw: Column, schema: str) -> Column:
    """The text as JSON, else what stands between its outermost braces (brackets, for an array) as JSON, else null."""
    body = F.nullif(F.regexp_extract(raw, r"(?s)\[.*\]" if schema.strip().lower().startswith("array") else r"(?s)\{.*\}", 0), F.lit(""))
    strict = F.when(F.get_json_object(F.trim(raw), "$").isNotNull(), F.from_json(F.trim(raw), schema))
    return F.coalesce(strict, F.from_json(body, schema))


def elements_to_markdown(elements: Column) -> Column:
    """array<struct<type, text, text_level, table_caption, table_body>> as markdown."""

    def one(e: Column) -> Column:
        level = F.least(e["text_level"], F.lit(4))
        table = F.concat_ws("\n", F.nullif(e["table_caption"], F.lit("")), e["table_body"])
        return F.when(e["type"] == "table", table).when(e["text_level"] > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), e["text"])).when(e["type"] == "equation", F.concat(F.lit("$$\n"), e["text"], F.lit("\n$$"))).otherwise(e["text"])

    return F.array_join(F.transform(elements, one), "\n\n")


ELEMENT = "pos int, type string, text string, text_level int"


def markdown_elements(df: DataFrame, key: str, text: str) -> DataFrame:
    """Elements of each row's markdown: headings, tables, lists, block math, fenced code and paragraphs, in order."""
    import pandas as pd

    def parse(source: str):
        block, kind = [], None

        def close():
            nonlocal block, kind
            out = [(kind, "\n".join(block), 0)] if block else []
            block, kind = [], None
            return out

        for line in (source or "").split("\n"):
            bare = line.strip()
            if kind in ("code", "equation"):
                if bare == ("```" if kind == "code" else "$$"):
                    yield from close()
                    kind = None
                else:
                    block.append(line)
                continue
            if bare.startswith("```") or bare == "$$":
                yield from close()
                kind = "code" if bare != "$$" else "equation"
                continue
            level = len(bare) - len(bare.lstrip("#"))
            if 1 <= level <= 6 and bare[level : level + 1] == " ":
                yield from close()
                yield "heading", bare[level:].strip(), min(level, 4)
                continue
            now = None if not bare else "table" if bare.startswith("|") else "list" if bare[:2] in ("- ", "* ") else "text"
            if now != kind:
                yield from close()
                kind = now
            if now:
                block.append(line)
        yield from close()

    def run(frames):
        for pdf in frames:
            rows = [(k, i, t, x, n) for k, s in zip(pdf[key], pdf[text]) for i, (t, x, n) in enumerate(parse(s))]
            yield pd.DataFrame(rows, columns=[key, "pos", "type", "text", "text_level"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {ELEMENT}")


def table_bands(df: DataFrame, key: str, table: str, budget: int) -> DataFrame:
    """Markdown tables as bands of rows within a budget of characters, the two header lines repeated; a longer row is cut."""
    import pandas as pd

    def bands(md: str):
        head, body = md.split("\n")[:2], md.split("\n")[2:]
        room = max(1, budget - sum(len(h) + 1 for h in head))
        rows = [r[i : i + room] for r in body for i in range(0, max(1, len(r)), room)]
        held, used = [], 0
        for r in rows:
            if held and used + len(r) + 1 > room + 1:
                yield "\n".join(head + held)
                held, used = [], 0
            held.append(r)
            used += len(r) + 1
        yield "\n".join(head + held)

    def run(frames):
        for pdf in frames:
            rows = [(k, i, b) for k, md in zip(pdf[key], pdf[table]) for i, b in enumerate(bands(md))]
            yield pd.DataFrame(rows, columns=[key, "band", "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, table).mapInPandas(run, f"{key} {kind}, band int, text string")


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def gfm_to_html(table: Column) -> Column:
    """A Markdown table as HTML: cells of the first line as th, the line of dashes dropped, cells of others as td."""
    lines = F.filter(F.split(table, "\n"), lambda x: (F.trim(x) != "") & ~F.regexp_like(x, F.lit(r"^[\s|:-]*-[\s|:-]*$")))

    def row(line: Column, i: Column) -> Column:
        cells = F.transform(F.split(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""), r"\|"), lambda c: escaped(F.trim(c)))
        tag = F.when(i == 0, "th").otherwise("td")
        opened, closed = F.concat(F.lit("<"), tag, F.lit(">")), F.concat(F.lit("</"), tag, F.lit(">"))
        return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(opened, c, closed)), ""), F.lit("</tr>"))

    return F.when(F.size(lines) > 0, F.concat(F.lit("<table>"), F.array_join(F.transform(lines, row), ""), F.lit("</table>"))).otherwise("")


#: Fixed value: an image that a wiki wraps in a span
SPAN_IMAGE = r"(?i)<span\s+class=[\"']mw-default-size[\"'][^>]*>\s*<a\s+[^>]*>\s*<img\s+[^>]*>\s*</a>\s*</span>"


def span_image_markers(html: Column, registry: Column) -> Column:
    """Span-wrapped images of the registry (an array of struct(n, url, label)) as text markers __IMG_n__; others stay.

    http and https are the same address here.
    """
    spans = F.array_distinct(F.regexp_extract_all(html, F.lit(SPAN_IMAGE), F.lit(0)))
    bare = lambda u: F.regexp_replace(unescape(u), "^https?://", "")

    def marked(text: Column, span: Column) -> Column:
        src = bare(F.regexp_extract(span, r"(?i)src=[\"']([^\"']+)[\"']", 1))
        n = F.try_element_at(F.filter(registry, lambda r: bare(r["url"]) == src), F.lit(1))["n"]
        return F.when(n.isNull() | (src == ""), text).otherwise(F.replace(text, span, F.concat(F.lit(" __IMG_"), n.cast("string"), F.lit("__ "))))

    return F.reduce(spans, html, marked)


def image_links(markdown: Column, registry: Column) -> Column:
    """Markers and Markdown images of the registry as ![label](img:n); brackets in labels are escaped. Images whose size a wiki put in the path count as the original."""

    def linked(text: Column, r: Column) -> Column:
        n = r["n"].cast("string")
        label = F.replace(F.replace(F.coalesce(r["label"], F.concat(F.lit("Image "), n)), F.lit("["), F.lit("&#91;")), F.lit("]"), F.lit("&#93;"))
        link = F.concat(F.lit("!["), label, F.lit("](img:"), n, F.lit(")"))
        return F.replace(text, F.concat(F.lit("__IMG_"), n, F.lit("__")), link)

    def image(text: Column, found: Column) -> Column:
        url = F.regexp_extract(found, r"\]\(([^)]+)\)$", 1)
        small = F.regexp_replace(url, r"/\d+px-", "/")
        bare = lambda u: F.regexp_replace(u, "^https?://", "")
        number = lambda u: F.try_element_at(F.filter(registry, lambda r: bare(r["url"]) == bare(u)), F.lit(1))["n"]
        n = F.coalesce(number(url), number(small))
        return F.when(n.isNull(), text).otherwise(F.replace(text, found, F.concat(F.lit("__IMG_"), n.cast("string"), F.lit("__"))))

    images = F.array_distinct(F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\([^)]+\)"), F.lit(0)))
    return F.reduce(registry, F.reduce(images, markdown, image), linked)


def merged_metadata(harvested: dict[str, Column], author: Column, general: dict[str, Column]) -> dict[str, Column]:
    """Harvested columns (authors, doi and others) with what a general extractor found: its author string, split, and its other texts win where they aren't blank; the DOI is the harvested one."""
    from .text import split_author_string

    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    out = dict(harvested)
    out["authors"] = F.coalesce(F.when(some(author).isNotNull(), split_author_string(author)), harvested.get("authors", F.lit(None)))
    for name, value in general.items():
        if name != "doi":
            out[name] = F.coalesce(some(value), harvested.get(name, F.lit(None)))
    return out
