"""Web pages to titles, main-text blocks, tables and links, with regular expressions inside the JVM."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import collapse
from attestra.sources.blocks import with_sections

# fixed values: parts of a page that are not main text, and tags that start a new block
DROPPED = ["script", "style", "nav", "footer", "aside", "noscript", "template", "svg", "form"]
BLOCK_TAGS = "p|div|br|section|article|main|header|ul|ol|table|thead|tbody|blockquote|pre|hr|dl|dt|dd|figure"
NAMES = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
MARK = "\x01"


def unescape(c: Column) -> Column:
    """Numeric character references and the named ones of HTML; unknown names stay as they are."""
    rx = r"&#(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});"
    codes = F.regexp_extract_all(c, F.lit(rx), F.lit(1))
    char = lambda n: F.when(
        n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    ).otherwise("")
    number = lambda x: F.when(x.startswith("x"), F.conv(F.substring(x, 2, 6), 16, 10)).otherwise(x).cast("long")
    chars = F.transform(codes, lambda x: char(number(x)))
    joined = F.array_join(
        F.flatten(F.zip_with(F.split(c, rx), chars, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), ""
    )
    out = F.when(c.contains("&#"), joined).otherwise(c)
    named = r"&([A-Za-z][A-Za-z0-9]{1,30});"
    known = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    shown = F.transform(F.regexp_extract_all(out, F.lit(named), F.lit(1)), lambda n: F.coalesce(F.try_element_at(known, n), F.concat(F.lit("&"), n, F.lit(";"))))
    words = F.array_join(F.flatten(F.zip_with(F.split(out, named), shown, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(out.rlike(named), words).otherwise(out)


def html_title(html: Column) -> Column:
    return collapse(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def main_html(html: Column) -> Column:
    """The page without comments, advertisement boxes and everything that is not main text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<head\b.*?</head>", " ")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    return F.regexp_replace(out, r"""(?is)<div[^>]*class=["'][^"']*\b(?:ad|ads|cookie|banner)\b[^"']*["'][^>]*>.*?</div>""", " ")


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """doc_id, seq, kind, level, text: one row per heading, paragraph, list item or table row. No shuffle."""
    flat = F.regexp_replace(main_html(F.col(html)), r"\s+", " ")
    flat = F.regexp_replace(flat, r"(?i)<h([1-6])\b[^>]*>", f"{MARK}h$1:")
    flat = F.regexp_replace(flat, r"(?i)<li\b[^>]*>", f"{MARK}li:")
    flat = F.regexp_replace(flat, r"(?i)<tr\b[^>]*>", f"{MARK}tr:")
    flat = F.regexp_replace(flat, r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>", " | ")
    flat = F.regexp_replace(flat, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>|</(?:h[1-6]|li|tr)>", f"{MARK}pp:")
    flat = F.regexp_replace(flat, r"<[^>]*>", "")
    parts = pages.select(F.col(key).alias("doc_id"), F.posexplode(F.split(flat, MARK)).alias("seq", "part"))
    tag = F.regexp_extract("part", r"^(h[1-6]|li|tr|pp):", 1)
    body = F.regexp_replace("part", r"^(?:h[1-6]|li|tr|pp):", "")
    kind = (
        F.when(tag.startswith("h"), "heading").when(tag == "li", "list").when(tag == "tr", "table_row").otherwise("para")
    )
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
    return parts.select(
        "doc_id", "seq", kind.alias("kind"), level.alias("level"), collapse(unescape(body)).alias("text")
    ).filter("text != ''")


def html_sections(blocks: DataFrame) -> DataFrame:
    titled = blocks.withColumn("title", F.when(F.col("level").isNotNull(), F.col("text")))
    return with_sections(titled, "doc_id", "seq", "level", "title").drop("title")


def empty_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Pages where nothing is left as main text."""
    bare = F.regexp_replace(main_html(F.col(html)), r"<[^>]*>", " ")
    return pages.filter(collapse(unescape(bare)) == "").select(
        F.col(key).alias("doc_id"), F.lit("no main text found in HTML").alias("warning")
    )


def html_table_cells(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Tables of a page as cells, numbered by table, row and column from 1."""
    tables = F.regexp_extract_all(main_html(F.col(html)), F.lit(r"(?is)<table\b[^>]*>(.*?)</table>"), F.lit(1))
    t = pages.select(F.col(key).alias("doc_id"), F.posexplode(tables).alias("t", "body"))
    rows = F.regexp_extract_all(F.col("body"), F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|$)"), F.lit(1))
    r = t.select("doc_id", "t", F.posexplode(rows).alias("r", "row"))
    cells = F.regexp_extract_all(F.col("row"), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|$)"), F.lit(1))
    c = r.select("doc_id", "t", "r", F.posexplode(cells).alias("c", "v"))
    text = collapse(unescape(F.regexp_replace("v", r"<[^>]*>", " ")))
    return c.select("doc_id", (F.col("t") + 1).alias("t"), (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), text.alias("v"))


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` seen from ``base``: absolute, scheme-relative, root-relative, query-only or relative to the folder."""
    clean = F.regexp_replace(base, r"#.*$", "")
    scheme = F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(clean, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    no_query = F.regexp_replace(clean, r"\?.*$", "")
    path = F.regexp_replace(F.regexp_replace(no_query, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", ""), r"[^/]*$", "")
    path = F.when(path == "", "/").otherwise(path)
    target, query = F.regexp_extract(href, r"^([^?]*)", 1), F.regexp_extract(href, r"(\?.*)$", 1)
    joined = F.when(target.startswith("/"), target).otherwise(F.concat(path, target))
    steps = F.split(joined, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(joined.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    tidy = F.when(joined.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.array_join(kept, "/"), tail)).otherwise(joined)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(target == "", F.concat(no_query, query))
        .otherwise(F.concat(root, tidy, query))
    )


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """doc_id, pos, url: distinct same-host http links of each page in order of appearance. No shuffle."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), F.lit(1))
    full = F.array_distinct(F.transform(hrefs, lambda h: absolute_url(F.col(url), h)))
    same = F.filter(full, lambda u: (host(u) == host(F.col(url))) & u.startswith("http"))
    return pages.select(F.col(key).alias("doc_id"), F.posexplode(same).alias("pos", "url"))
