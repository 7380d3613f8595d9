"""Comparable sales, price statistics and deals, for all targets in one job."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.regex import like_escape, matches, word_start
from ..functions.text import lot_count, main_category, quoted_models, telling_words
from ..rules import classify
from .facets import index_percentiles
from .fuzzy import similar_pairs, word_pairs
from .stable import pinned

MOST, LEAST, SAMPLES = 250, 3, 15
SIMILARITY = 0.45


def verified_sold(bid: Column, reserve: Column, reserve_status: Column) -> Column:
    """Sold for sure: the reserve is not unmet, and the bid reaches it where it is known."""
    return ~reserve_status.eqNullSafe(F.lit("not_met")) & F.coalesce(bid >= reserve, F.lit(True))


def attributes_agree(a: dict[str, Column], b: dict[str, Column], year_a: Column, year_b: Column, gap: int = 20) -> Column:
    """False only on a proven mismatch: both known, neither holding the other, or years too far apart."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    ok = F.coalesce(F.abs(year_a - year_b) <= gap, F.lit(True))
    for name in a:
        x, y = squeeze(a[name]), squeeze(b[name])
        ok = ok & F.coalesce(x.contains(y) | y.contains(x), F.lit(True))
    return ok


def counts_agree(target: Column, sample: Column) -> Column:
    """A plural target wants the same number; any other refuses a plural sample."""
    return F.when(target > 1, F.coalesce(sample == target, F.lit(False))).otherwise(F.coalesce(sample <= 1, F.lit(True)))


def model_agrees(models: Column, title: Column) -> Column:
    """Whether a title holds one of the quoted models: the whole phrase, a token with a digit, or three fifths of its
    words of three letters or more. True when nothing is quoted."""
    low = F.lower(title)
    tokens = lambda p: F.filter(F.split(F.lower(p), "[^a-z0-9åäöé]+"), lambda t: F.length(t) >= 3)
    digit = lambda p: F.filter(tokens(p), lambda t: t.rlike("[0-9]"))
    alpha = lambda p: F.filter(tokens(p), lambda t: ~t.rlike("[0-9]"))
    held = lambda p: (
        low.contains(F.lower(p))
        | F.exists(digit(p), lambda t: low.contains(t))
        | ((F.size(alpha(p)) > 0) & (F.size(F.filter(alpha(p), lambda t: low.contains(t))) >= F.ceil(F.size(alpha(p)) * 0.6)))
    )
    return (F.size(models) == 0) | F.exists(models, held)


def overlap_ok(target: Column, sample: Column, similarity: Column, threshold: float = SIMILARITY) -> Column:
    """Two telling words of the target start words of the sample, unless it is similar enough or has under two."""
    words = telling_words(target)
    tokens = F.split(F.lower(sample), "[^a-z0-9åäöéü]+")
    shared = F.size(F.filter(words, lambda w: F.exists(tokens, lambda t: t.startswith(w))))
    return (similarity >= threshold) | (F.size(words) < 2) | (shared >= 2)


def title_pairs(targets: DataFrame, history: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): title pairs that may compare, by similarity or by the most telling word."""
    similar = similar_pairs(targets, "title", history, "title", threshold)
    within = ("main", "s_main") if "main" in targets.columns and "s_main" in history.columns else None
    by_word = word_pairs(targets, "title", history, "title", within).withColumn("similarity", F.lit(0.0))
    return similar.unionByName(by_word).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def verified(history: DataFrame) -> DataFrame:
    """Sales sold for sure; a history without reserves has nothing against them."""
    of = lambda name, kind: F.col(name) if name in history.columns else F.lit(None).cast(kind)
    return history.filter("sold").filter(verified_sold(F.col("final_bid"), of("reserve_price", "double"), of("reserve_status", "string")))


def sale_mains(sales: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``sales`` with ``s_main``: of a trusted category, else by the lexicon, else as stored, else by the title's words."""
    stored = main_category(F.col("category"))
    trusted = F.when(F.col("category_conf").isin("human", "llm", "learned"), stored) if "category_conf" in sales.columns else F.lit(None).cast("string")
    if lexicon is None:
        voted = F.lit(None).cast("string")
    else:
        won = classify.vote(sales.select("title").distinct(), "title", "title", lexicon).select(F.col("title").alias("__title"), F.col("category").alias("__voted"))
        sales, voted = sales.join(won, sales.title == won["__title"], "left"), main_category(F.col("__voted"))
    known = F.coalesce(trusted, voted, stored)
    by_words = main_category(F.when(known.isNull(), classify.by_text(F.col("title"))))  # the rules are costly
    return sales.withColumn("s_main", F.coalesce(known, by_words)).drop("__title", "__voted")


#: Facts of a lot that must not clash, and its year (fixed names).
ATTRIBUTES, YEAR = ("b", "m", "d", "t"), "y"


def _class_columns(targets: DataFrame) -> list[str]:
    """What makes two targets alike: the title, the main category and, where they are known, count and facts."""
    return ["title", "main", *[c for c in ("lot_count", "attrs") if c in targets.columns]]


def _classes(targets: DataFrame) -> DataFrame:
    """``targets`` with ``main`` and ``class``, a key of the columns that make them alike."""
    rows = targets.withColumn("main", main_category(F.col("category")))
    return rows.withColumn("class", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in _class_columns(targets)]))


def _candidates(classes: DataFrame, history: DataFrame, threshold: float, lexicon: DataFrame | None) -> DataFrame:
    """Gated sales of each class of targets. Sales that are alike to every target (of one title, main, count and facts)
    are cut to their newest, one more than a target can take, and groups of them that lie behind that many more similar
    sales are left out, however many a hot title or word has."""
    known = lambda name, kind: F.col(name) if name in history.columns else F.lit(None).cast(kind)
    sold = sale_mains(verified(history), lexicon).withColumns({"s_count": F.coalesce(known("lot_count", "long").cast("long"), lot_count(F.col("title"))), "s_attrs": known("attrs", "string")})
    keys = [c for c in ("house", "external_id") if c in history.columns]
    alike = ["b", "s_main", "s_count", "s_attrs"]
    sold = sold.select(F.col("title").alias("b"), *alike[1:], F.col("final_total").alias("price"), *[F.col(k).alias("s_" + k) for k in keys], "ended_at").filter("price > 0")
    newest = Window.partitionBy(*alike).orderBy(F.desc("ended_at"), "s_external_id", *[f"s_{k}" for k in keys if k == "house"])
    recent = sold.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= MOST + 1).drop("__r")
    recent = pinned(recent.withColumn("__alike", F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in alike])))
    groups = pinned(recent.groupBy("__alike", *alike).agg(F.count(F.lit(1)).alias("__n")))
    # classes are read several times below, so each is made once
    classes = pinned(classes)
    pairs = title_pairs(classes, groups.select(F.col("b").alias("title"), "s_main"), threshold)
    pairs = pairs.filter(overlap_ok(F.col("a"), F.col("b"), F.col("similarity"), threshold))
    pairs = pairs.withColumn("strict", model_agrees(quoted_models(F.col("a")), F.col("b")))
    # every gate looks only at what makes sales alike, so groups pass them, not sales
    rows = classes.join(pairs, classes.title == pairs.a).join(groups, "b")
    rows = rows.filter(F.coalesce(F.col("main") == F.col("s_main"), F.col("main").isNull()))
    own_count = F.coalesce(F.col("lot_count").cast("long"), lot_count(F.col("title"))) if "lot_count" in classes.columns else lot_count(F.col("title"))
    rows = rows.filter(counts_agree(own_count, F.col("s_count")))
    if "attrs" in classes.columns and "attrs" in history.columns:
        facts = lambda c: {name: F.col(c)[name] for name in ATTRIBUTES}
        rows = rows.filter(attributes_agree(facts("attrs"), facts("s_attrs"), F.col("attrs")[YEAR], F.col("s_attrs")[YEAR]))
    # groups behind enough more similar sales can never be among a class's most similar
    ahead = Window.partitionBy("class").orderBy(F.desc("similarity")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    nearer = F.sum("__n").over(ahead) - F.sum("__n").over(Window.partitionBy("class", "similarity"))
    rows = rows.withColumn("__nearer", nearer).filter(F.col("__nearer") <= MOST)
    rows = rows.select(*classes.columns, "strict", "similarity", "__alike").join(recent.select("__alike", "price", *["s_" + k for k in keys], "ended_at"), "__alike")
    return rows.select(*classes.columns, "strict", "similarity", "price", *["s_" + k for k in keys], "ended_at")


def _ranked(rows: DataFrame, by: list[str], most: int = MOST) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("similarity"), F.desc("ended_at"), "s_external_id", *[c for c in ("s_house",) if c in rows.columns]))
    return rows.withColumn("place", place).filter(F.col("place") <= most)


def comparables(targets: DataFrame, history: DataFrame, threshold: float = SIMILARITY, lexicon: DataFrame | None = None) -> DataFrame:
    """Gated comparable sales per class of alike targets: one row each with ``strict``, ``similarity`` and ``price``. A
    class has at most ``MOST``, the most similar and then the newest; the cut is the feature's own."""
    columns = _class_columns(targets)
    classes = _classes(targets).select(*columns, "class").distinct()
    rows = _ranked(_candidates(classes, history, threshold, lexicon), ["class"])
    return rows.select(*columns, "strict", "similarity", "price", F.col("s_external_id").alias("external_id"), "place")


def _chosen(found: DataFrame, by: list[str]) -> DataFrame:
    """The strict rows of a group, or all of them where fewer than ``LEAST`` are strict (``loose``)."""
    strict = F.count_if("strict").over(Window.partitionBy(*by))
    return found.withColumn("loose", strict < LEAST).filter(F.col("strict") | F.col("loose"))


def _used(targets: DataFrame, history: DataFrame, threshold: float, lexicon: DataFrame | None) -> DataFrame:
    return _chosen(comparables(targets, history, threshold, lexicon), _class_columns(targets))


def price_stats(targets: DataFrame, history: DataFrame, threshold: float = SIMILARITY, lexicon: DataFrame | None = None, loose: bool = False) -> DataFrame:
    """Per class of alike targets: statistics over the strict comparables, or over all when the strict are too few; none
    under three. With ``loose`` also whether they were too few."""
    by = [*_class_columns(targets), *(["loose"] if loose else [])]
    return index_percentiles(_used(targets, history, threshold, lexicon), by, "price").filter(F.col("n") >= LEAST)


def price_samples(targets: DataFrame, history: DataFrame, threshold: float = SIMILARITY, lexicon: DataFrame | None = None) -> DataFrame:
    """The comparables behind ``price_stats``, the ``SAMPLES`` most similar of each class, numbered from 1."""
    columns = _class_columns(targets)
    by = Window.partitionBy(*columns)
    rows = _used(targets, history, threshold, lexicon).withColumns({"n": F.count("price").over(by), "sample": F.row_number().over(by.orderBy("place"))})
    return rows.filter((F.col("n") >= LEAST) & (F.col("sample") <= SAMPLES)).select(*columns, "sample", "external_id", "similarity", "price")


def estimates(targets: DataFrame, history: DataFrame, rejected: DataFrame | None = None, threshold: float = SIMILARITY, lexicon: DataFrame | None = None) -> DataFrame:
    """(house, external_id, loose, statistics) per target; targets without an estimate have ``n`` 0.

    A target's own sale never counts, nor do sales that a person rejected for it (``rejected``: house, external_id,
    cmp_house, cmp_external_id). Targets that neither touches share the statistics of their class. A class ranks its
    sales alike for all its targets, so its first ones, one more than a target takes, are all that a touched target
    needs: they come as one array of bounded size, and what is not the target's is left out inside its row.
    """
    key = ["house", "external_id"]
    members = _classes(targets).select(*key, "class")
    classes = _classes(targets).select(*_class_columns(targets), "class").distinct()
    found = _candidates(classes, history, threshold, lexicon).select("class", "strict", "similarity", "price", "s_house", "s_external_id", "ended_at")
    found = pinned(_ranked(found, ["class"], MOST + 1))
    own = members.join(found.select("class", F.col("s_house").alias("house"), F.col("s_external_id").alias("external_id")), ["class", *key], "left_semi").select(*key)
    touched = own if rejected is None else own.union(rejected.select(*key)).distinct()
    lists = found.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("place", "strict", "price", "s_house", "s_external_id"))).alias("sales"))
    alone = members.join(touched, key, "left_semi").join(lists, "class")
    used = F.slice(F.filter("sales", lambda x: (x["s_house"] != F.col("house")) | (x["s_external_id"] != F.col("external_id"))), 1, MOST)
    if rejected is not None:
        refused = rejected.groupBy(*key).agg(F.collect_set(F.struct(F.col("cmp_house").alias("s_house"), F.col("cmp_external_id").alias("s_external_id"))).alias("refused"))
        alone = alone.join(refused, key, "left")
        used = F.filter(used, lambda x: ~F.coalesce(F.array_contains("refused", F.struct(x["s_house"], x["s_external_id"])), F.lit(False)))
    alone = alone.withColumn("used", used).withColumn("loose", F.size(F.filter("used", lambda x: x["strict"])) < LEAST)
    prices = F.array_sort(F.transform(F.filter("used", lambda x: x["strict"] | F.col("loose")), lambda x: x["price"]))
    alone = alone.select(*key, "loose", prices.alias("prices")).withColumn("n", F.size("prices").cast("long")).filter(F.col("n") >= LEAST)
    at = lambda q: F.element_at("prices", (F.least(F.floor(F.col("n") * q), F.col("n") - 1) + 1).cast("int"))
    mean = F.floor(F.aggregate("prices", F.lit(0.0), lambda t, p: t + p) / F.col("n") + 0.5)
    special = alone.select(*key, "loose", "n", at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.0).alias("low"), at(1.0).alias("high"), mean.alias("mean"))
    shared = index_percentiles(_chosen(found.filter(F.col("place") <= MOST), ["class"]), ["class", "loose"], "price").filter(F.col("n") >= LEAST)
    shared = members.join(touched, key, "left_anti").join(shared, "class").select(*special.columns)
    return members.select(*key).join(shared.union(special), key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def lookup(history: DataFrame, words: list[str], since: Column, as_of: Column) -> DataFrame:
    """Sales since a day whose title has all words, each at the start of a word."""
    rows = history.filter("sold").filter(F.coalesce(F.col("ended_at") <= as_of, F.lit(True))).filter(F.col("ended_at") >= since)
    for w in words:
        rows = rows.filter(F.col("title").ilike(f"%{like_escape(w)}%") & matches("title", word_start(w)))
    return rows


def public(stats: DataFrame) -> DataFrame:
    """Statistics without the sales behind them."""
    return stats.drop("samples", "sample", "external_id")


def next_cards(samples: DataFrame, verdicts: DataFrame, images: DataFrame, target: str = "target") -> DataFrame:
    """(target, sample columns) of the next pair to judge: the first sample of each target that has a picture and no
    verdict yet. ``samples``: (target, sample, cmp); ``verdicts``: (target, cmp); ``images``: (cmp, image)."""
    open_ = samples.join(verdicts.select(target, "cmp").distinct(), [target, "cmp"], "left_anti").join(images.select("cmp", "image"), "cmp")
    first = open_.groupBy(target).agg(F.min(F.struct("sample", "cmp", "image")).alias("f"))
    return first.select(target, "f.sample", "f.cmp", "f.image")


def with_items(history: DataFrame, items: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    """Sales with what is known of their lot; a sale whose lot is gone stays."""
    return history.join(items, list(key), "left")


def price_model(rows: DataFrame, by: list[str], y: str, features: list[str], least: int = 30) -> DataFrame:
    """(by, n, intercept, slopes, r2): ordinary least squares of ``y`` on the features within each group of at least
    ``least`` complete rows. Only each group's covariances leave the aggregation; the small system of each is solved in
    one batch of groups. Features that do not vary, or follow from others, get the slopes of least norm."""
    full = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (y, *features)]))
    k = len(features)
    cov = [F.covar_pop(a, b) for a in features for b in features] + [F.covar_pop(a, y) for a in features]
    sums = full.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*cov).alias("cov"), F.array(*[F.avg(c) for c in (*features, y)]).alias("mean"), F.var_pop(y).alias("var")).filter(F.col("n") >= least)

    @F.pandas_udf("slopes array<double>, intercept double, r2 double")
    def solve(cov: pd.Series, mean: pd.Series, var: pd.Series) -> pd.DataFrame:
        out = []
        for c, m, v in zip(cov, mean, var):
            square, right = np.array(c[: k * k]).reshape(k, k), np.array(c[k * k :])
            slopes = np.linalg.lstsq(square, right, rcond=1e-12)[0]
            out.append((slopes.tolist(), float(m[-1] - slopes @ np.array(m[:-1])), float(slopes @ right / v) if v else None))
        return pd.DataFrame(out, columns=["slopes", "intercept", "r2"])

    return sums.withColumn("fit", solve("cov", "mean", "var")).select(*by, "n", "fit.intercept", "fit.slopes", "fit.r2")
