"""Choosing what to read: file filters, export markers, crawl planning, robots rules, naming of fetched content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.text import glob_to_regex, slugify
from attestra.scale import rank_within

# fixed values
EXTENSIONS = [".docx", ".xlsx", ".xlsm", ".pptx", ".pdf", ".md", ".txt", ".csv", ".html", ".htm"]
MAX_BYTES = 30 * 1024 * 1024
SUFFIX_OF_TYPE = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
    "text/csv": ".csv",
}


def _matches_any(c: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | c.rlike(glob_to_regex(g))
    return hit


def select_sources(
    files: DataFrame, path: str = "path", exts: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """Files with a known extension, outside hidden and excluded folders."""
    exclude = exclude or []
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    above = F.transform(folders, lambda _, i: F.concat(F.array_join(F.slice(folders, F.lit(1), i + 1), "/"), F.lit("/")))
    suffix = F.lower(F.regexp_extract(F.element_at(parts, -1), r"^.+(\.[^.]+)$", 1))
    keep = suffix.isin([e.lower() for e in (exts or EXTENSIONS)])
    keep = keep & ~F.exists(folders, lambda x: x.startswith("."))
    if exclude:
        keep = keep & ~_matches_any(F.col(path), exclude) & ~F.exists(above, lambda x: _matches_any(x, exclude))
    return files.filter(keep)


def drop_by_head(df: DataFrame, text: str, must: str, any_of: list[str], n: int = 600, path: str | None = None) -> DataFrame:
    """Drop texts whose first ``n`` bytes carry ``must`` and one of ``any_of``: exported chats are not sources."""
    head = F.make_valid_utf8(F.substring(F.col(text).cast("binary"), 1, n).cast("string"))
    any_hit = F.lit(False)
    for marker in any_of:
        any_hit = any_hit | head.contains(marker)
    marked = head.contains(must) & any_hit
    if path is not None:
        marked = marked & F.lower(F.col(path)).rlike(r"\.(txt|md)$")
    return df.filter(~marked)


def plan_frontier(seeds: DataFrame, links: DataFrame, budget: int) -> DataFrame:
    """url, depth, ord: the seeds, then up to ``budget`` of their links in order of discovery.

    ``seeds`` holds (pos, url), ``links`` (from_pos, link_pos, url). A link to a page already read
    when its page is read is skipped; a link queued twice uses the budget twice but is read once.
    """
    first = seeds.groupBy("url").agg(F.min("pos").alias("pos"))
    read = first.select(F.col("url").alias("read_url"), F.col("pos").alias("read_pos"))
    # only pages that were themselves read hand on links
    pages = links.join(first.select(F.col("pos").alias("from_pos")), "from_pos", "left_semi")
    fresh = pages.join(read, F.col("url") == F.col("read_url"), "left").filter(
        F.col("read_pos").isNull() | (F.col("read_pos") > F.col("from_pos"))
    )
    queued = fresh.orderBy("from_pos", "link_pos", "url").limit(budget)
    once = queued.groupBy("url").agg(F.min(F.struct("from_pos", "link_pos")).alias("at"))
    extra = once.join(first, "url", "left_anti")
    return first.select("url", F.lit(0).alias("depth"), "pos", F.lit(-1).cast("int").alias("link_pos")).unionByName(
        extra.select("url", F.lit(1).alias("depth"), F.col("at.from_pos").alias("pos"), F.col("at.link_pos").alias("link_pos"))
    )


def robots_filter(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``allowed``: the first rule of the host whose path prefix fits decides, no rule means yes.

    The rules of one host come from one robots file, so they fit one array; each url meets one row.
    """
    per_host = rules.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("ord", "path_prefix", "allow"))).alias("rs"))
    at = urls.withColumn("host", F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)).withColumn(
        "_path", F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    )
    path = F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))
    joined = at.join(per_host, "host", "left")
    hit = F.get(F.filter("rs", lambda r: path.startswith(r["path_prefix"]) & (r["path_prefix"] != "")), F.lit(0))
    return joined.withColumn("allowed", F.coalesce(hit["allow"], F.lit(True))).drop("rs", "_path")


def route_content(fetched: DataFrame, order: str) -> DataFrame:
    """Suffix, digest and a unique file name for fetched content (url, content_type, body).

    Names clash on hot stems (every index page), so they are numbered with ``rank_within``.
    """
    kind = F.lower(F.trim(F.substring_index("content_type", ";", 1)))
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIX_OF_TYPE.items() for x in kv]), kind)
    place = F.regexp_replace(F.regexp_replace("url", r"#.*$", ""), r"\?.*$", "")
    path = F.regexp_replace(place, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    by_path = F.coalesce(*[F.when(F.lower(path).endswith(s), s) for s in SUFFIX_OF_TYPE.values()])
    site = F.regexp_extract(place, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/]*)", 1)
    suffix = F.coalesce(by_type, by_path)
    routed = fetched.withColumns(
        {
            "error": F.when(
                F.octet_length("body") > MAX_BYTES, F.lit(f"larger than {MAX_BYTES // 1048576} MB")
            ),
            "is_page": suffix.isNull(),
            "suffix": F.coalesce(suffix, F.lit(".md")),
            "digest": F.sha2(F.col("body").cast("binary"), 256),
            "stem": slugify(F.concat(site, F.lit("-"), path), "-", 70),
        }
    )
    kept = rank_within(routed.filter("error is null").drop("body"), ["stem", "suffix"], [order], "nth")
    number = F.when(F.col("nth") > 1, F.concat(F.lit("-"), F.col("nth").cast("string"))).otherwise("")
    named = kept.withColumn("name", F.concat("stem", number, "suffix")).drop("nth")
    return named.unionByName(routed.filter("error is not null").drop("body").withColumn("name", F.lit(None).cast("string")))
