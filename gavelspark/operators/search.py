"""Search over items: filters, relevance tiers, semantic ranking and their fusion."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import shown_price, sort_rate
from ..functions.regex import any_term, like_escape, matches, query_words, unicode_words, word_start
from ..functions.text import location_pattern
from ..functions.vectors import dot
from ..rules.tables import CONDITION_NEW, CONDITION_UNTESTED

KEY = ["house", "external_id"]
#: Candidates that the lexical side of a fused search may rank beyond the page.
LEXICAL_MARGIN = 400
SEMANTIC_LIMIT, SEMANTIC_FLOOR, SEMANTIC_Z, SEMANTIC_ROWS = 300, 0.74, 4.0, 50


@dataclass(frozen=True)
class Filters:
    """Only what is set takes part in the plan."""

    as_of: Column | None = None
    hidden: tuple[str, ...] = ()
    houses: tuple[str, ...] = ()
    seller: str | None = None
    category: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    ends_before: Column | None = None
    place: str | None = None
    min_deal: float | None = None
    include_ended: bool = False
    reserve: str | None = None
    insolvency: bool | None = None
    #: 'ny' or 'otestad', as the description tells.
    condition: str | None = None
    extra: tuple[Column, ...] = field(default=())

    def predicates(self, df: DataFrame) -> list[Column]:
        c, out = F.col, []
        if not self.include_ended:
            out.append(c("status") == "active")
            if self.as_of is not None:
                out.append(c("ends_at").isNull() | (c("ends_at") > self.as_of))
        if self.hidden:
            out.append(~c("house").isin(*self.hidden))
        if self.houses:
            out.append(c("house").isin(*self.houses))
        if self.seller is not None:
            out.append(c("seller") == self.seller)
        if self.category is not None:
            out.append((c("category") == self.category) | c("category").startswith(self.category + "/"))
        price = F.coalesce(*[c(x) for x in ("total_price", "current_bid", "min_bid") if x in df.columns])
        if self.min_price is not None:
            out.append(price >= self.min_price)
        if self.max_price is not None:
            out.append(price <= self.max_price)
        if self.ends_before is not None:
            out.append(c("ends_at") <= self.ends_before)
        if self.place is not None:
            out.append(c("location").rlike(location_pattern(self.place)))
        if self.min_deal is not None:
            out.append(c("deal_percent") >= self.min_deal)
        if self.reserve is not None:
            out.append(c("reserve_status") == self.reserve)
        if self.insolvency is not None:
            out.append(c("insolvency") == self.insolvency)
        if self.condition is not None:
            out.append(matches("description", unicode_words({"ny": CONDITION_NEW, "otestad": CONDITION_UNTESTED}[self.condition])))
        return [*out, *self.extra]

    def apply(self, df: DataFrame) -> DataFrame:
        return reduce(DataFrame.filter, self.predicates(df), df)


def order_for(sort: str, include_ended: bool = False) -> list[Column]:
    """Sort keys of a listing, with the item key as the last resort."""
    ends = F.col("ends_at").desc_nulls_last() if include_ended else F.col("ends_at").asc_nulls_last()
    price = shown_price(F.coalesce("total_price", "current_bid"), F.col("min_bid"), F.col("currency"))
    keys = {
        "ending": [ends],
        "newest": [F.coalesce("listed_at", "first_seen").desc_nulls_last()],
        "price_high": [price.desc_nulls_last()],
        "price_low": [price.asc_nulls_last()],
        "bids": [F.col("bid_count").desc_nulls_last(), ends],
        "fewest": [F.col("bid_count").asc_nulls_last(), ends],
        "deal": [F.col("deal_percent").desc_nulls_last(), ends],
    }[sort]
    return [*keys, *[F.col(k) for k in KEY]]


def list_items(items: DataFrame, filters: Filters, sort: str = "ending", limit: int = 48, offset: int = 0) -> DataFrame:
    """A page of a listing; the limit is part of the feature (200 rows at most)."""
    return filters.apply(items).orderBy(*order_for(sort, filters.include_ended)).offset(max(offset, 0)).limit(min(limit, 200))


def tier(query: str, synonyms: list[str] | None = None, literal: bool = False, text_cols: tuple[str, ...] = ("description", "ocr_text")) -> Column:
    """1 phrase in the title, 2 all words at word starts, 3 phrase in the text, 4 a synonym at a word start, 5 all words
    anywhere in the title, null otherwise. ``literal`` takes % and _ in the phrase as they are."""
    phrase = f"%{like_escape(query) if literal else query}%"
    words = query_words(query)
    title = F.col("title")
    all_of = lambda tests: reduce(lambda a, b: a & b, tests) if tests else F.lit(False)
    out = F.when(title.ilike(phrase), 1)
    if len(words) > 1:
        out = out.when(all_of([matches(title, word_start(w)) for w in words]), 2)
    if text_cols:
        out = out.when(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(phrase), F.lit(False)) for c in text_cols]), 3)
    if synonyms:
        out = out.when(matches(title, any_term(synonyms)), 4)
    return out.when(all_of([title.ilike(f"%{like_escape(w)}%") for w in words]), 5)


def lexical(items: DataFrame, query: str, filters: Filters, synonyms: list[str] | None = None, text_cols: tuple[str, ...] = ("description", "ocr_text"), literal: bool = False) -> DataFrame:
    """Items that match, with their ``tier``."""
    return filters.apply(items).withColumn("tier", tier(query, synonyms, literal, text_cols)).filter(F.col("tier").isNotNull())


def search(items: DataFrame, query: str, filters: Filters, sort: str = "ending", limit: int = 48, offset: int = 0, **kw) -> DataFrame:
    """A page of the lexical search: tier first, then the sort."""
    return lexical(items, query, filters, **kw).orderBy("tier", *order_for(sort, filters.include_ended)).offset(offset).limit(limit)


def scored(vectors: DataFrame, query: list[float], col: str = "embedding") -> DataFrame:
    """``vectors`` with ``score``, the dot product with one query vector of fixed size."""
    return vectors.withColumn("score", dot(F.col(col), F.array(*[F.lit(float(x)) for x in query])))


def semantic_top(vectors: DataFrame, query: list[float], key: list[str], limit: int = SEMANTIC_LIMIT, floor: float = SEMANTIC_FLOOR, z: float = SEMANTIC_Z, least_rows: int = SEMANTIC_ROWS) -> DataFrame:
    """(key, score, srank) of the rows whose score stands out: at least ``floor`` and ``z`` deviations over the mean;
    nothing when there are too few rows to tell."""
    all_scores = scored(vectors.filter(F.size("embedding") > 0), query).select(*key, "score")
    gate = all_scores.agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("dev"))
    kept = all_scores.join(F.broadcast(gate)).filter((F.col("n") >= least_rows) & (F.col("score") >= F.greatest(F.lit(floor), F.col("mean") + z * F.col("dev"))))
    top = kept.orderBy(F.desc("score"), *key).limit(limit).select(*key, "score")
    return top.withColumn("srank", F.row_number().over(Window.orderBy(F.desc("score"), *key)))


def neighbours(vectors: DataFrame, key: str, value, limit: int = 12, least: float = 0.45, col: str = "embedding") -> DataFrame:
    """The vectors most like that of one row, itself left out."""
    target = vectors.filter(F.col(key) == value).select(F.col(col).alias("__t")).limit(1)
    rows = vectors.filter(F.col(key) != value).join(F.broadcast(target)).withColumn("score", dot(F.col(col), F.col("__t")))
    return rows.filter(F.col("score") >= least).orderBy(F.desc("score"), key).limit(min(limit, 40)).drop("__t")


def fuse(lexical_hits: DataFrame, semantic_hits: DataFrame, key: list[str], k: int = 60, weight: float = 0.5) -> DataFrame:
    """(key, lrank, srank, rrf, bucket) by reciprocal ranks over a full outer join. Bucket 0: lexical with tier 1 or 2,
    1: other lexical hits, 2: semantic only."""
    rows = lexical_hits.join(semantic_hits, key, "full")
    rrf = F.coalesce(1.0 / (k + F.col("lrank")), F.lit(0.0)) + F.coalesce(weight / (k + F.col("srank")), F.lit(0.0))
    return rows.withColumn("rrf", rrf).withColumn("bucket", F.when(F.col("tier") <= 2, 0).when(F.col("tier").isNotNull(), 1).otherwise(2))


def ranked(hits: DataFrame, key: list[str], limit: int) -> DataFrame:
    """The first ``limit`` hits by tier and end, numbered from 1. The cut comes before the numbering, so that the one
    task that numbers sees ``limit`` rows only."""
    order = [F.col("tier"), F.col("ends_at").asc_nulls_last(), *[F.col(x) for x in key]]
    return hits.orderBy(*order).limit(limit).withColumn("lrank", F.row_number().over(Window.orderBy(*order)))


def hybrid(items: DataFrame, query: str, filters: Filters, semantic: DataFrame | None, sort: str | None = None, limit: int = 48, offset: int = 0, **kw) -> DataFrame:
    """A page of the fused search; semantic-only hits pass the same filters. Without a sort the fused rank orders; with
    one, the bucket comes first and the rank last. Without semantic hits it is the plain search."""
    if semantic is None or semantic.isEmpty():
        return search(items, query, filters, sort or "ending", limit, offset, **kw)
    lex = ranked(lexical(items, query, filters, **kw), KEY, offset + limit + LEXICAL_MARGIN).select(*KEY, "tier", "lrank")
    both = fuse(lex, semantic.select(*KEY, "srank"), KEY)
    rows = filters.apply(items).join(both, KEY)
    order = [F.desc("rrf"), *[F.col(k) for k in KEY]] if sort is None else [F.col("bucket"), *order_for(sort, filters.include_ended)[: -len(KEY)], F.desc("rrf"), *[F.col(k) for k in KEY]]
    return rows.orderBy(*order).offset(offset).limit(limit)


def without(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key is not among those seen."""
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def among(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` whose key is among those wanted."""
    return rows.join(wanted.select(*key), key, "left_semi")


def marked(rows: DataFrame, those: DataFrame, key: list[str], flag: str) -> DataFrame:
    """``rows`` with a flag that says whether their key is among those."""
    return rows.join(those.select(*key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def rate(currency: str = "currency") -> Column:
    return sort_rate(F.col(currency))


def details(items: DataFrame, bids: DataFrame, media: DataFrame, vehicles: DataFrame, plate: Column, most: int = 100, salts: int = 16) -> DataFrame:
    """``items`` with what is shown of each: ``bids``, the ``most`` highest of them (value, bid_id), highest first;
    ``media``, the addresses by their order; ``vehicle``, the data of ``plate`` for lots under 'fordon' only.
    ``bids``: KEY, bid_id, value; ``media``: KEY, url, sort; ``vehicles``: plate, vehicle. Bids are cut in parts first,
    so a lot that everybody bids on is not one task's work."""
    best = [F.desc("value"), F.col("bid_id")]
    top = bids.join(items.select(*KEY).distinct(), KEY, "left_semi").withColumn("__salt", F.pmod(F.xxhash64("bid_id"), F.lit(salts)))
    for by in ([*KEY, "__salt"], KEY):
        top = top.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("__r") <= most)
    listed = top.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("__r", "value", "bid_id"))).alias("bids"))
    shown = media.join(items.select(*KEY).distinct(), KEY, "left_semi").groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("sort", "url"))), lambda m: m["url"]).alias("media"))
    of = F.when(F.col("category").startswith("fordon"), plate)
    rows = items.withColumn("plate", of).join(vehicles.select("plate", "vehicle"), "plate", "left").join(listed, KEY, "left").join(shown, KEY, "left")
    return rows.withColumns({"bids": F.transform(F.coalesce("bids", F.array()), lambda b: F.struct(b["value"].alias("value"), b["bid_id"].alias("bid_id"))), "media": F.coalesce("media", F.array().cast("array<string>"))})
