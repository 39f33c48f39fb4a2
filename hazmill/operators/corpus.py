"""Preparing a corpus: page budgets, running headers, sections, copies, links.

Pages are (doc_id, page_no, text); documents carry a name or id and a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazmill.functions import text as T
from hazmill.functions.scoring import let


def apply_page_budget(pages: DataFrame, max_pages: int = 60, max_chars: int = 200_000) -> DataFrame:
    """The first max_pages pages, up to and with the one on which the characters reach max_chars."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ranked alone first: so each task passes on only so many pages of a document, however many it has
    first = pages.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= max_pages)
    return first.withColumn("__before", before).where(F.col("__before") < max_chars).drop("__nth", "__before")


def readable_documents(pages: DataFrame, min_chars: int = 200, alt_pages: DataFrame | None = None) -> DataFrame:
    """doc_id, chars, source ('extracted', 'alternative' or 'rejected')."""
    total = lambda p, name: p.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias(name))
    own = total(pages, "own")
    other = total(alt_pages, "other") if alt_pages is not None else own.select("doc_id", F.lit(0).cast("long").alias("other"))
    both = own.join(other, "doc_id", "left").withColumn("other", F.coalesce("other", F.lit(0)))
    source = F.when(F.col("own") >= min_chars, "extracted").when(F.col("other") > F.col("own"), "alternative").when(F.col("own") > 0, "extracted").otherwise("rejected")
    return both.withColumn("source", source).select("doc_id", F.when(F.col("source") == "alternative", F.col("other")).otherwise(F.col("own")).cast("long").alias("chars"), "source")


def repeated_lines(pages: DataFrame, share: float = 0.5, min_pages: int = 3, max_length: int = 120) -> DataFrame:
    """doc_id, line: short lines on more than the share of a document's pages, each page counted once."""
    line = F.explode(F.array_distinct(F.filter(F.transform(T.lines(F.col("text")), T.strip), lambda x: (x != "") & (F.length(x) < max_length))))
    seen = pages.select("doc_id", line.alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))
    size = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return seen.join(size, "doc_id").where((F.col("n_pages") >= min_pages) & (F.col("n") > F.col("n_pages") * share)).select("doc_id", "line", "n", "n_pages")


def clean_pages(pages: DataFrame) -> DataFrame:
    """doc_id, page_no, text: each page in its own row without its document's repeated lines, for documents of any size."""
    furniture = repeated_lines(pages).groupBy("doc_id").agg(F.collect_set("line").alias("furniture"))
    kept = F.array_join(F.filter(T.lines(F.col("text")), lambda x: ~F.array_contains(F.coalesce("furniture", F.array().cast("array<string>")), T.strip(x))), "\n")
    return pages.join(furniture, "doc_id", "left").select("doc_id", "page_no", kept.alias("text"))


def remove_furniture(pages: DataFrame) -> DataFrame:
    """doc_id, text: the pages of each document without their repeated lines, joined by blank lines.

    A document is one row of the result, so its pages must fit one; clean_pages has no such bound.
    """
    page = clean_pages(pages).select("doc_id", F.struct("page_no", F.col("text").alias("kept")).alias("page"))
    joined = page.groupBy("doc_id").agg(F.array_sort(F.collect_list("page")).alias("pages"))
    return joined.select("doc_id", F.array_join("pages.kept", "\n\n").alias("text"))


def clean_documents(pages: DataFrame) -> DataFrame:
    """remove_furniture, then normalised text."""
    return remove_furniture(pages).withColumn("text", T.normalize_text(F.col("text")))


def sections_of(text: Column) -> Column:
    """Array of (section_no, heading, body): lines under the nearest heading before them, inside a text's row; empty bodies go."""

    def cut(x: Column) -> Column:
        until = lambda i: F.coalesce(F.try_element_at(x["at"], i + 2), F.size(x["lines"]) + 1)
        body = lambda at, i: T.strip(F.array_join(F.slice(x["lines"], at + 1, until(i) - at - 1), "\n"))
        heading = lambda at: F.when(at > 0, T.strip(F.element_at(x["lines"], F.greatest(at, F.lit(1))))).otherwise("")
        return F.transform(x["at"], lambda at, i: F.struct(i.alias("section_no"), heading(at).alias("heading"), body(at, i).alias("body")))

    # the places of headings, from 1, after a place before the first line
    at = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(T.HEADING), i + 1)), lambda i: i.isNotNull())
    placed = let(T.lines(F.coalesce(text, F.lit(""))), lambda lines: F.struct(lines.alias("lines"), F.concat(F.array(F.lit(0)), at(lines)).alias("at")))
    none = F.array().cast("array<struct<section_no:int,heading:string,body:string>>")
    return F.filter(F.coalesce(let(placed, lambda x: F.when(F.size(x["lines"]) > 0, cut(x))), none), lambda s: s["body"] != "")


def split_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, heading, body: lines under the nearest heading before them; empty bodies go."""
    return docs.select("doc_id", F.inline(sections_of(F.col("text"))))


def dedupe_corpus(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """name, sha256 of documents whose content no earlier name has; the first of them, if a limit is given."""
    seen = docs.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")).agg(F.min("name").alias("name"))
    return seen if limit is None else seen.orderBy("name").limit(limit)


def extract_links(pages: DataFrame, pattern: str = r'href="(/[^"/]{3,})"', skip: tuple[str, ...] = ()) -> DataFrame:
    """page_id, place, slug: the first place of each slug on a page, without the skipped ones."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("place", "href"))
    slug = F.regexp_replace("href", "^/+|/+$", "")
    return found.withColumn("slug", slug).where(~F.col("slug").isin(*skip) if skip else F.lit(True)).groupBy("page_id", "slug").agg(F.min("place").alias("place"))


def report_link(pages: DataFrame, root: str, ending: str = "pdf") -> DataFrame:
    """page_id, link: the page's main document link, preferring one that says 'report', never a recommendation."""
    links = F.regexp_extract_all("html", F.lit(rf'(?i)href="([^"]+\.{ending}[^"]*)"'), 1)
    fit = F.filter(links, lambda h: ~F.lower(h).contains("/recommendation"))
    best = F.coalesce(F.try_element_at(F.filter(fit, lambda h: F.lower(h).contains("report")), F.lit(1)), F.try_element_at(fit, F.lit(1)))
    return pages.select("page_id", best.alias("link")).where("link is not null").withColumn("link", F.when(F.col("link").startswith("http"), F.col("link")).otherwise(F.concat(F.lit(root), "link")))
