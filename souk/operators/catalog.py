"""Catalogue: sellable offers, search, paging, images, categories, ads.

Images per offer are few by the write rule (at most 8), so per-offer image
arrays are built with ``collect_list`` + ``array_sort`` after a
``row_number`` has fixed each image's position; flat variants (one row per
offer x image) skip the array and are what the SQL oracle compares.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import date_spine
from ..functions.exprs import as_of_ts, contains_pattern, js_trim
from .common import Key, asc, desc
from .common import page as take_page

DEFAULT_IMAGE = "default.png"
OFFER_COLUMNS = ["id", "reference", "product_name", "category", "description", "old_price",
                 "discount", "new_price", "wholesale_price", "quantity", "status", "created_at"]
SEARCH_COLUMNS = ["product_name", "category", "description"]


def _present(df: DataFrame, cols: list[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def sellable(offers: DataFrame) -> DataFrame:
    """``status = 'active' AND quantity > 0`` (raw, case-sensitive)."""
    return offers.where((F.col("status") == F.lit("active")) & (F.col("quantity") > 0))


def search_condition(pattern: Column, columns=SEARCH_COLUMNS) -> Column:
    """Any of the columns ILIKE the pattern (NULL columns do not match)."""
    cond = None
    for c in columns:
        m = F.coalesce(F.ilike(F.col(c), pattern), F.lit(False))
        cond = m if cond is None else (cond | m)
    return cond


def _term_matches(pattern: Column, plain: Column, columns=SEARCH_COLUMNS) -> Column:
    """ILIKE '%term%' on any column; a term without wildcard or escape
    characters is the same test as a lower-cased substring search, which
    needs no per-row pattern compilation."""
    fast = None
    for c in columns:
        m = F.coalesce(F.contains(F.lower(F.col(c)), plain), F.lit(False))
        fast = m if fast is None else (fast | m)
    return F.when(plain.isNotNull(), fast).otherwise(search_condition(pattern, columns))


def offers_filter(offers: DataFrame, category: str | None = None,
                  search: str | None = None) -> DataFrame:
    """P7 + P8 + P9: sellable offers, optional category and text search."""
    out = sellable(offers)
    category = (category or "").strip()
    search = (search or "").strip()
    if category and category != "all":
        out = out.where(F.col("category") == F.lit(category))
    if search:
        out = out.where(search_condition(contains_pattern(search)))
    return out


def sort_keys(sort: str | None) -> list[Key]:
    """O1: whitelisted sort modes, unknown -> newest; PostgreSQL null placement."""
    modes = {
        "newest": [desc("created_at"), desc("id")],
        "price-low": [asc("new_price"), desc("id")],
        "price-high": [desc("new_price"), desc("id")],
        "discount": [desc("discount", nulls_first=False), desc("created_at"), desc("id")],
    }
    return modes.get(sort or "newest", modes["newest"])


def paging_args(page_no=None, limit=None) -> tuple[int, int]:
    """O2: page >= 1 (default 1), limit >= 1 (default 1,000,000).

    JavaScript's ``Math.max(1, parseInt(v, 10) || default)``: leading white
    space, a sign and the leading digits count, anything after them does not.
    """
    def parse(v, default):
        m = re.match(r"\s*([+-]?\d+)", "" if v is None else str(v))
        return max(1, (int(m.group(1)) if m else 0) or default)
    return parse(page_no, 1), parse(limit, 1_000_000)


# ---------------------------------------------------------------------------
# Images
# ---------------------------------------------------------------------------
def ranked_images(images: DataFrame, main_first: bool = False) -> DataFrame:
    """Images with their position ``pos`` (0-based) inside their offer's array.

    Array order is ``sort_order`` (favourites: ``is_main DESC`` first); the
    image id breaks ties so the position is deterministic.
    """
    order = [F.col("sort_order").asc_nulls_last(), F.col("id").asc()]
    if main_first:
        order = [F.col("is_main").desc_nulls_first()] + order
    return images.withColumn("pos", F.row_number().over(W.partitionBy("offer_id").orderBy(*order)) - 1)


def image_arrays(images: DataFrame, main_first: bool = False) -> DataFrame:
    """``offer_id -> images`` array of structs, ordered; offers w/o image absent."""
    r = ranked_images(images, main_first)
    return (r.groupBy("offer_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                "pos", "id", "image_url", "is_main", "sort_order"))).alias("_imgs"))
            .select("offer_id", F.transform("_imgs", lambda x: x.dropFields("pos")).alias("images")))


def with_images(offers: DataFrame, images: DataFrame, nested: bool = True,
                main_first: bool = False, key: str = "id") -> DataFrame:
    """Attach images to each row of ``offers`` (joined on ``key`` = offer id).

    nested: an ``images`` array column, ``[]`` when there is none.
    flat: one row per image (``image_pos``, ``image_id``, ``image_url``,
    ``is_main``, ``sort_order``), a single row of NULLs when there is none.
    """
    if nested:
        arr = image_arrays(images, main_first).withColumnRenamed("offer_id", "_oid")
        out = offers.join(arr, offers[key] == arr["_oid"], "left").drop("_oid")
        return out.withColumn("images", F.coalesce("images", F.array().cast(arr.schema["images"].dataType)))
    r = ranked_images(images, main_first).select(
        F.col("offer_id").alias("_oid"), F.col("pos").alias("image_pos"),
        F.col("id").alias("image_id"), "image_url", "is_main", "sort_order")
    return offers.join(r, offers[key] == r["_oid"], "left").drop("_oid")


def main_image(offers: DataFrame, images: DataFrame, default: str = DEFAULT_IMAGE) -> DataFrame:
    """Each offer's main image url (``is_main DESC, sort_order ASC``)."""
    w = W.partitionBy("offer_id").orderBy(F.col("is_main").desc_nulls_first(),
                                           F.col("sort_order").asc_nulls_last(), F.col("id").asc())
    top = (images.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
           .select(F.col("offer_id"), F.col("image_url").alias("_url")))
    return (offers.select(F.col("id").alias("offer_id"))
            .join(top, "offer_id", "left")
            .select("offer_id", F.coalesce("_url", F.lit(default)).alias("image_url")))


def images_per_offer(offers: DataFrame, images: DataFrame) -> DataFrame:
    """Number of images of every offer (int, 0 when none)."""
    n = images.groupBy("offer_id").agg(F.count(F.lit(1)).alias("_n"))
    return (offers.select(F.col("id").alias("offer_id")).join(n, "offer_id", "left")
            .select("offer_id", F.coalesce("_n", F.lit(0)).cast("int").alias("images")))


# ---------------------------------------------------------------------------
# Listing, detail, categories
# ---------------------------------------------------------------------------
def offers_page(offers: DataFrame, images: DataFrame, page=None, limit=None, search=None,
                category=None, sort=None, nested: bool = True) -> DataFrame:
    """One page of the catalogue in order, images attached after the page is cut.

    Late materialisation: positions are found on narrow rows (id and sort
    keys), the page's ids then fetch their rows and images.  ``position`` is the
    0-based place in the whole listing; rows come back in that order.
    """
    p, l = paging_args(page, limit)
    rows = offers_filter(offers, category, search).select(*_present(offers, OFFER_COLUMNS))
    keys = sort_keys(sort)
    ids = take_page(rows.select(*dict.fromkeys(k.name for k in keys)), keys, p, l).select("id", "position")
    out = with_images(rows.join(ids, "id"), images, nested=nested)
    return out.orderBy("position") if nested else out.orderBy("position", "image_pos")


def offers_page_info(offers: DataFrame, page=None, limit=None, search=None,
                     category=None) -> DataFrame:
    """A15 + O2: page, limit, total matching rows and ``has_more`` (one row)."""
    p, l = paging_args(page, limit)
    offset = (p - 1) * l
    total = offers_filter(offers, category, search).agg(F.count(F.lit(1)).alias("total"))
    shown = F.least(F.lit(l).cast("bigint"), F.greatest(F.col("total") - offset, F.lit(0)))
    return total.select(F.lit(p).alias("page"), F.lit(l).alias("limit"), "total",
                        ((F.lit(offset) + shown) < F.col("total")).alias("has_more"))


def offer_detail(offers: DataFrame, images: DataFrame, ids: DataFrame | None = None,
                 nested: bool = True) -> DataFrame:
    """Sellable offers (optionally only those in ``ids.id``) with images."""
    rows = sellable(offers).select(*_present(offers, OFFER_COLUMNS))
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    return with_images(rows, images, nested=nested)


def categories_distinct(offers: DataFrame, trim_check: bool = True) -> DataFrame:
    """Distinct non-blank categories (kept untrimmed), sorted."""
    cond = F.col("category").isNotNull()
    cond = cond & ((F.trim("category") != F.lit("")) if trim_check else (F.col("category") != F.lit("")))
    return offers.where(cond).select("category").distinct().orderBy(F.col("category").asc_nulls_last())


# ---------------------------------------------------------------------------
# Search by many terms (R13): exact n-gram candidate join + ILIKE check
# ---------------------------------------------------------------------------
def clean_terms(df: DataFrame, name_col="product_name", category_col="category",
                terms_col="search_terms", max_terms: int = 10) -> DataFrame:
    """[name, category, *terms] -> drop falsy -> JS trim -> length >= 2 -> first 10."""
    parts = [F.array(F.col(name_col), F.col(category_col))]
    if terms_col in df.columns:
        parts.append(F.coalesce(F.col(terms_col), F.array().cast("array<string>")))
    arr = F.concat(*parts)
    arr = F.filter(arr, lambda x: x.isNotNull() & (x != F.lit("")))
    arr = F.transform(arr, lambda x: js_trim(x))
    arr = F.filter(arr, lambda x: F.length(x) >= 2)
    return df.withColumn("terms", F.slice(arr, 1, max_terms))


_NGRAM_CAP = 64


def _literal_tokens(pattern_lower: Column) -> Column:
    """The pattern's characters, NULL for a wildcard, escapes resolved."""
    toks = F.regexp_extract_all(pattern_lower, F.lit(r"(\\[\s\S]|[\s\S])"), 1)
    return F.transform(toks, lambda x: F.when(x.isin("%", "_"), F.lit(None))
                       .when(F.length(x) == 2, F.substring(x, 2, 1)).otherwise(x))


GRAM_LENGTHS = (8, 4, 2, 1)


def _grams(s: Column, n: int) -> Column:
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)),
                                                lambda i: F.substring(s, i, n)))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _tagged(grams: Column, n: int) -> Column:
    return F.transform(F.coalesce(grams, _no_strings()), lambda g: F.concat(F.lit(f"{n}:"), g))


def _literal_grams(tokens: Column, n: int) -> Column:
    """(n, pos, g) of every run of ``n`` literal characters of a term."""
    def at(i):
        part = F.slice(tokens, i + F.lit(1), F.lit(n))
        return F.struct(F.lit(n).alias("n"), i.alias("pos"),
                        F.when(F.forall(part, lambda x: x.isNotNull()), F.array_join(part, "")).alias("g"))
    found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(tokens) - n, F.lit(0))), at)
    return F.when(F.size(tokens) >= n, F.filter(found, lambda x: x["g"].isNotNull())).otherwise(
        F.array().cast("array<struct<n:int,pos:int,g:string>>"))


def _postings(offers: DataFrame) -> DataFrame:
    """(key, offer_id) of the q-grams of every length in the search columns."""
    low = [F.coalesce(F.lower(F.col(c)), F.lit("")) for c in SEARCH_COLUMNS]
    every = [_tagged(_grams(x, n), n) for n in GRAM_LENGTHS for x in low]
    length = F.array(F.concat(F.lit("0:"), F.least(F.greatest(*[F.length(x) for x in low]), F.lit(_NGRAM_CAP)).cast("string")))
    # explode_outer: an inner explode lets the optimizer evaluate the whole array once more as a filter
    return offers.select(F.col("id").alias("offer_id"), F.explode_outer(F.array_distinct(F.concat(*every, length))).alias("key"))


def term_candidates(terms: DataFrame, offers: DataFrame) -> DataFrame:
    """(term, offer_id): pairs that may match, found without touching texts pair by pair.

    A variable-length q-gram index.  Every text that matches a term holds all
    of the term's literal runs, so all its q-grams; a term looks at its grams of
    the two greatest lengths it has (of 8, 4, 2, 1 characters), takes the one with the fewest
    offers and the rarest other one that does not overlap it, and intersects
    their posting lists.  Terms of wildcards only demand a minimum length, which
    is a key of its own (lengths up to the cap).

    Grams come out of ``explode`` and compressed files, so Spark's size estimates fall short of
    them by far: the joins here and in :func:`term_search` are hinted to shuffle, else the driver is
    sent the postings or the terms of all queries as a broadcast.  Hashed sides are bounded by the distinct terms.
    """
    # max(term) is the term, but a filter on it cannot move below the aggregate to every row of ``terms``
    t = (terms.groupBy(F.col("term").alias("_by")).agg(F.max("term").alias("term")).drop("_by")
         .withColumn("pat", contains_pattern(F.col("term")))
         .withColumn("_lt", _literal_tokens(F.lower(F.col("pat")))))
    t = t.withColumns({f"_g{n}": _literal_grams(F.col("_lt"), n) for n in GRAM_LENGTHS})
    best = F.coalesce(*[F.when(F.size(f"_g{n}") > 0, F.concat(F.col(f"_g{n}"), F.col(f"_g{m}")))
                        for n, m in zip(GRAM_LENGTHS, (*GRAM_LENGTHS[1:], GRAM_LENGTHS[-1]))])
    t = t.select("term", "pat", best.alias("_best"))
    grams = (t.select("term", F.explode_outer("_best").alias("x")).where(F.col("x").isNotNull())
             .select("term", F.concat(F.col("x.n").cast("string"), F.lit(":"), F.col("x.g")).alias("key"), "x.n", "x.pos"))
    freq = _postings(offers).groupBy("key").agg(F.count(F.lit(1)).alias("df"))  # counted in the tasks before anything is shuffled
    ranked = (grams.join(freq.hint("merge"), "key", "left")
              .groupBy("term").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), (-F.col("n")).alias("o"), "key", "n", "pos"))).alias("gs")))
    first = F.col("gs")[0]
    apart = F.filter("gs", lambda x: (x["key"] != first["key"]) & ((x["pos"] >= first["pos"] + first["n"]) | (x["pos"] + x["n"] <= first["pos"])))
    probes = (ranked.select("term", F.concat(F.array(first["key"]), F.slice(F.transform(apart, lambda x: x["key"]), 1, 1)).alias("ks"))
              .select("term", F.size("ks").alias("need"), F.explode("ks").alias("key")))
    # wildcard-only terms: a text matches only if it is at least as long as the term has '_'
    n_under = F.least(F.size(F.filter(F.regexp_extract_all(F.col("pat"), F.lit(r"(\\[\s\S]|[\s\S])"), 1), lambda x: x == F.lit("_"))),
                      F.lit(_NGRAM_CAP))
    lengths = F.transform(F.sequence(n_under, F.lit(_NGRAM_CAP)), lambda k: F.concat(F.lit("0:"), k.cast("string")))
    probes = probes.unionByName(t.where(F.col("_best").isNull()).select("term", F.lit(1).alias("need"), F.explode(lengths).alias("key")))
    return (probes.hint("shuffle_hash").join(_postings(offers), "key").groupBy("term", "offer_id", "need").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == F.col("need")).select("term", "offer_id"))


def term_search(terms: DataFrame, offers: DataFrame, top: int = 20, salt: int = 16) -> DataFrame:
    """For each ``query_id``, the newest ``top`` sellable offers
    matching any of its terms (ILIKE '%term%' on name, category, description).

    Exact without a nested-loop join: candidates come from the q-gram index
    (:func:`term_candidates`, once per distinct term), the ILIKE condition then decides.
    The newest ``top`` offers of a query are among the newest ``top`` of its terms, since
    whatever precedes an offer in a term's list precedes it in the query's: lists are cut per
    distinct term first (per term and salt, then per term, so a term
    matching a huge share of offers never lands in one task whole), and a query
    merges one such list per term, however many offers the terms match.
    """
    offers = sellable(offers).select("id", "created_at", *SEARCH_COLUMNS)
    plain = F.when(~F.col("term").rlike(r"[%_\\]"), F.lower(F.col("term")))
    newest = F.max(F.struct(F.col("created_at").isNull().alias("open"), "created_at")).alias("at")
    order = [F.col("at").desc(), F.col("offer_id").desc()]
    asked = terms.select("query_id", "term").distinct().withColumn("_salt", F.pmod(F.xxhash64("query_id"), F.lit(salt)))
    found = (term_candidates(terms, offers).join(offers.withColumnRenamed("id", "offer_id").hint("merge"), "offer_id")
             .where(_term_matches(contains_pattern(F.col("term")), plain)).groupBy("term", "offer_id").agg(newest))
    part = (found.withColumn("_salt", F.xxhash64("offer_id") % salt)
            .withColumn("_r", F.row_number().over(W.partitionBy("term", "_salt").orderBy(*order)))
            .where(F.col("_r") <= top))
    lists = (part.withColumn("_r", F.row_number().over(W.partitionBy("term").orderBy(*order)))
             .where(F.col("_r") <= top).select("term", "offer_id", "at.created_at"))
    # a term that every query asks for: its list goes to the salts its queries fall into, so no task gets them all
    dealt = asked.select("term", "_salt").distinct().join(lists.hint("shuffle_hash"), "term")
    hits = (asked.join(dealt.hint("shuffle_hash"), ["term", "_salt"]).repartition("query_id")
            .groupBy("query_id", "offer_id").agg(newest))
    best = (hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
            .where(F.col("rank") <= top))
    return best.select("query_id", "offer_id", "rank")


def term_search_results(terms: DataFrame, offers: DataFrame, images: DataFrame | None = None,
                        top: int = 20, nested: bool = True) -> DataFrame:
    """Matched offers with their columns (and images) per query."""
    cols = _present(offers, ["id", "reference", "product_name", "category", "description",
                             "new_price", "old_price", "discount", "quantity"])
    hits = term_search(terms, offers, top)
    out = hits.join(offers.select(*cols).withColumnRenamed("id", "offer_id").hint("merge"), "offer_id")
    if images is not None:
        out = with_images(out, images, nested=nested, key="offer_id")
    return out


def image_search(analyses: DataFrame, offers: DataFrame, images: DataFrame | None = None, top: int = 20,
                 nested: bool = True) -> DataFrame:
    """R13 from the analysis of a picture on: (query_id, product_name, category, search_terms) -> terms
    cleaned and cut to ten (:func:`clean_terms`), then the matched offers by rank."""
    terms = clean_terms(analyses).select("query_id", F.explode("terms").alias("term"))
    out = term_search_results(terms, offers, images, top, nested)
    return out.orderBy("query_id", "rank", *([] if nested or images is None else ["image_pos"]))


# ---------------------------------------------------------------------------
# Site ads
# ---------------------------------------------------------------------------
def _ad_order():
    return [F.col("display_order").asc_nulls_last(), F.col("created_at").desc_nulls_first(),
            F.col("id").asc()]


def _ad_active(now: Column) -> Column:
    return (F.coalesce(F.col("is_active"), F.lit(False))
            & (F.col("starts_at").isNull() | (F.col("starts_at") <= now))
            & (F.col("ends_at").isNull() | (F.col("ends_at") >= now)))


def ads_list(ads: DataFrame) -> DataFrame:
    """All ads by display order, newest first within an order."""
    return ads.orderBy(*_ad_order())


def ads_active(ads: DataFrame, now) -> DataFrame:
    """Ads active at ``now`` (both interval ends inclusive, open ends)."""
    cols = _present(ads, ["id", "title", "image_url", "link_url", "width", "height",
                          "display_order", "created_at"])
    return ads.where(_ad_active(as_of_ts(now))).select(*cols).orderBy(*_ad_order())


def ads_active_daily(spark: SparkSession, ads: DataFrame, as_of, days: int) -> DataFrame:
    """P12 over a date spine: which ads are active at the start of each day.

    The spine has at most ``days`` rows, so it is the broadcast side of the
    range join; the ads table streams through it.
    """
    spine = date_spine(spark, as_of, days).withColumn("_now", F.col("date").cast("timestamp_ntz"))
    return (ads.join(F.broadcast(spine), _ad_active(F.col("_now")))
            .select("date", F.col("id").alias("ad_id"), "display_order"))
