"""Links on listing pages, and the releases among them that are newer than the loaded ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import fixed


def fold_dots(path: Column) -> Column:
    """An absolute path without its `.` and `..` segments."""
    parts = F.slice(F.split(path, "/", -1), F.lit(2), F.size(F.split(path, "/", -1)))
    last = F.element_at(parts, -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        start,
        lambda done, p: F.when(p == ".", done)
        .when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, p)),
    )
    # A path that ends in a dot segment names a folder.
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), tail)


def _with_folded_path(url: Column) -> Column:
    place = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)(/[^?#]*)?(.*)$"
    path = F.regexp_extract(url, place, 2)
    folded = F.concat(F.regexp_extract(url, place, 1), fold_dots(path), F.regexp_extract(url, place, 3))
    return F.when(path.rlike(r"/\.\.?(/|$)"), folded).otherwise(url)


def resolve_link(link: Column, base: Column) -> Column:
    """Absolute form of a link on the page `base`, dot segments folded."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, "[^/]*$", ""))
    page = F.regexp_replace(base, "#.*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), _with_folded_path(F.concat(origin, link)))
        .when(link.startswith("#"), F.concat(page, link))
        .when(link.startswith("?"), F.concat(F.regexp_replace(page, r"\?.*$", ""), link))
        .otherwise(_with_folded_path(F.concat(origin, folder, link)))
    )


def page_links(pages: DataFrame, html: str = "html", base: str = "url") -> DataFrame:
    """Distinct absolute links of a table of pages."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit('(?i)href="([^"]+)"'), 1))
    return (
        pages.select(F.col(base).alias("_base"), found.alias("_link"))
        .select(resolve_link(F.col("_link"), F.col("_base")).alias("url"))
        .distinct()
    )


def newer_releases(urls: DataFrame, releases: DataFrame) -> DataFrame:
    """(file, url) of releases later than the latest loaded of their kind and year, or of a
    later year than any loaded; years before the first loaded one are ignored."""
    name = "(?i)" + fixed.RELEASE_NAME
    seen = urls.where(F.col("url").rlike(name)).select(
        "url",
        F.regexp_extract("url", name, 1).alias("file"),
        F.regexp_extract("url", name, 2).cast("int").alias("fiscal_year"),
        F.regexp_extract("url", name, 3).cast("int").alias("quarter"),
    )
    kind = F.when(F.col("file").contains("Disclosure"), "lca").otherwise("lca_worksites")
    loaded = releases.groupBy("kind", "fiscal_year").agg(F.max("quarter").alias("_have"))
    span = releases.agg(F.min("fiscal_year").alias("_first"), F.max("fiscal_year").alias("_last"))
    later_year = F.col("_have").isNull() & (F.col("fiscal_year") > F.col("_last"))
    return (
        seen.withColumn("kind", kind)
        .join(loaded, ["kind", "fiscal_year"], "left")
        .crossJoin(F.broadcast(span))  # one row
        .where((F.col("fiscal_year") >= F.col("_first")) & (later_year | (F.col("quarter") > F.col("_have"))))
        .groupBy("file")
        .agg(F.max("url").alias("url"))
    )


def newer_registry_files(urls: DataFrame, loaded_years: DataFrame) -> DataFrame:
    """(file, url) of registry archive files of a later year than any loaded."""
    name = "(?i)" + fixed.REGISTRY_RELEASE_NAME
    last = loaded_years.agg(F.max("fiscal_year").alias("_last"))
    return (
        urls.where(F.col("url").rlike(name))
        .select("url", F.regexp_extract("url", name, 1).alias("file"), F.regexp_extract("url", name, 2).cast("int").alias("_y"))
        .crossJoin(F.broadcast(last))  # one row
        .where(F.col("_y") > F.col("_last"))
        .groupBy("file")
        .agg(F.max("url").alias("url"))
    )
