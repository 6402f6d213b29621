"""Boilerplate lines of a site: those on more than a given share of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hinloom.runtime import broadcast_if_small, materialize

# Share of a site's pages above which a line is boilerplate.  The pages a line was seen on are taken less `MARGIN` times
# their square root, about what chance adds to a count, so that a few pages do not prove a share.
RATIO = 0.005
MARGIN = 1.5

# Least hashes per page that tell copies, and the whole of a page's weight in integer parts.
COORDINATES = 5
WHOLE = 1 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _of_page() -> Column:
    """The different lines of a page that are not blank."""
    return F.array_distinct(F.filter(F.transform(_lines(F.col("text")), _bare), lambda line: line != ""))


def _sketch() -> Column:
    """The least hash of a page's lines for each coordinate; null without lines."""
    hashes = F.transform(_of_page(), lambda line: F.xxhash64(line))

    def least_of(number: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(number))))

    least = [least_of(number) for number in range(COORDINATES)]
    return F.when(F.size(hashes) > 0, F.array(*least))


def page_weights(docs: DataFrame, host: str = "source") -> DataFrame:
    """``site, sketch, weight`` for the pages that share most of their lines with others of their site.

    A page's lines are reduced to `COORDINATES` least hashes.  Two pages agree in one with the share of lines they have in
    common, so for a page the middle one of its numbers of agreeing pages tells how many copies it has, whatever
    single lines they differ in and whatever single lines it shares with other pages.  ``weight`` is `WHOLE` divided
    by that number: a group of copies weighs about one page.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    sketched = docs.select(site.alias("site"), F.col("text").cast("string").alias("text"))
    pages = sketched.select("site", _sketch().alias("sketch")).where("sketch is not null")
    classes = materialize(pages.groupBy("site", "sketch").agg(F.count(F.lit(1)).alias("n")), "page-classes")
    each = classes.select("site", "sketch", "n", F.posexplode("sketch").alias("at", "value"))
    agreeing = each.groupBy("site", "at", "value").agg(F.sum("n").alias("pages")).where("pages > 1")
    known = each.join(broadcast_if_small(materialize(agreeing, "agreeing-pages")), ["site", "at", "value"], "left")
    counts = known.groupBy("site", "sketch").agg(
        F.sort_array(F.collect_list(F.coalesce("pages", F.lit(1).cast("long")))).alias("counts")  # one per coordinate
    )
    middle = F.element_at("counts", COORDINATES // 2 + 1)
    weights = counts.where(middle > 1).select("site", "sketch", F.floor(F.lit(WHOLE) / middle).cast("long").alias("weight"))
    return materialize(weights, "page-weights")


def boilerplate(
    docs: DataFrame,
    host: str = "source",
    ratio: float = RATIO,
    margin: float = MARGIN,
    weights: DataFrame | None = None,
) -> DataFrame:
    """``site, line`` for the lines on more than ``ratio`` of the pages of their site.

    ``margin`` times its square root is taken off a line's number of pages first, so a line on one or two pages
    never goes.  With ``weights`` of `page_weights` copies of a page count as one, for their lines and for the site's
    total.

    Lines are counted by hash first, with map-side sums, so that only two numbers per line are shuffled; the few
    hashes that pass are counted again by the lines themselves, so equal hashes of different lines do no harm.
    A site has at most (mean lines per page) / ratio such lines.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    pages = docs.select(site.alias("site"), F.col("text").cast("string").alias("text"))
    if weights is None:
        pages = pages.withColumn("weight", F.lit(WHOLE).cast("long"))
    else:
        of_page = broadcast_if_small(weights)
        pages = pages.withColumn("sketch", _sketch()).join(of_page, ["site", "sketch"], "left").drop("sketch")
        pages = pages.withColumn("weight", F.coalesce("weight", F.lit(WHOLE).cast("long")))
    lines = pages.select("site", "weight", F.explode(_of_page()).alias("line"))
    totals = pages.groupBy("site").agg((F.sum("weight") / WHOLE).alias("total"))
    if weights is not None:
        totals = materialize(totals, "site-totals")  # counted twice below, and the sketches are not cheap

    def frequent(counted: DataFrame) -> DataFrame:
        sure = F.col("pages") - F.lit(margin) * F.sqrt("pages")
        return counted.join(totals, "site").where(sure > F.col("total") * F.lit(ratio))

    seen = (F.sum("weight") / WHOLE).alias("pages")
    hashed = lines.groupBy("site", F.xxhash64("line").alias("hash")).agg(seen)
    likely = materialize(frequent(hashed).select("site", "hash"), "frequent-hashes")
    again = lines.withColumn("hash", F.xxhash64("line")).join(broadcast_if_small(likely), ["site", "hash"])
    counted = again.groupBy("site", "line").agg(seen)
    return materialize(frequent(counted).select("site", "line"), "boilerplate-lines")


def drop_boilerplate(
    docs: DataFrame,
    host: str = "source",
    ratio: float = RATIO,
    margin: float = MARGIN,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Texts without the boilerplate lines of their site.

    Returns all columns of ``docs`` with ``text`` cut, and ``n_lines``, ``n_dropped``.  Lines end at a line feed
    and are compared without blanks, tabs and carriage returns at their ends; blank lines stay; a text may end up
    empty.  A null text stays null with 0 lines; a null site is the site named by the empty string; a repeated row
    is a page of its own unless ``weights`` of `boilerplate` says otherwise; columns of ``docs`` with the names of the
    results are replaced.
    """
    of_site = boilerplate(docs, host, ratio, margin, weights).groupBy("site").agg(F.collect_set("line").alias("lines"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    others = [c for c in columns if c != "text"]
    pages = docs.select([F.col(f"`{c}`") for c in columns]).alias("page")
    at_site = F.coalesce(F.col(f"page.`{host}`").cast("string"), F.lit("")) == F.col("of_site.site")
    bad = F.col("of_site.lines")
    lines = _lines(F.col("page.text").cast("string"))
    kept = F.when(bad.isNull(), lines).otherwise(F.filter(lines, lambda line: ~F.array_contains(bad, _bare(line))))
    cut = pages.join(broadcast_if_small(of_site).alias("of_site"), at_site, "left").select(
        F.struct([F.col(f"page.`{c}`") for c in others]).alias("page"), lines.alias("lines"), kept.alias("kept")
    )
    return cut.select(
        *[F.col(f"page.`{c}`") for c in others],
        F.array_join("kept", "\n").alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("kept"), F.lit(0)).alias("n_dropped"),
    )
