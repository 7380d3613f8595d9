"""Rule-based and learned classification of lots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.regex import found_ascii_words
from ..functions.text import once, title_tokens, top_level
from .tables import CATCH_ALL, CONFIDENCE_RANK, HOUSE_KEYS, LABEL_RULES, MIXED, MIXED_SIGNAL, NAME_RULES, TITLE_RULES, UNSORTED

MIN_EVIDENCE, MIN_SHARE = 12, 0.75


def padded(*texts: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.regexp_replace(F.concat_ws(" ", *texts), r"\s+", " ")), F.lit(" "))


def by_text(title: Column, description: Column | None = None, rules: tuple[tuple[str, str], ...] = TITLE_RULES) -> Column:
    """The category that the ordered rules give a text. Rules of three or more mains at once mean a mixed lot, and so
    does a mixed-lot word when no rule holds; null if nothing holds."""

    def judged(text: Column) -> Column:
        def chosen(found: Column) -> Column:
            mains = F.size(F.array_distinct(F.transform(found, lambda k: F.substring_index(k, "/", 1))))
            return F.when(mains >= 3, MIXED).when(mains > 0, F.get(found, F.lit(0))).when(text.rlike(found_ascii_words(MIXED_SIGNAL)), MIXED)

        return once(F.array_compact(F.array(*[F.when(text.rlike(found_ascii_words(p)), key) for p, key in rules])), chosen)

    return once(padded(title) if description is None else padded(title, description), judged)


def by_name(name: Column, rules: tuple[tuple[str, str], ...] = NAME_RULES) -> Column:
    """The category a source's own category name stands for; null if it is ambiguous."""
    text = F.concat(F.lit(" "), F.lower(F.coalesce(name, F.lit(""))), F.lit(" "))
    return F.coalesce(*[F.when(text.rlike(found_ascii_words(p)), key) for p, key in rules])


def by_label(label: Column) -> Column:
    """The category a source's label stands for: as a title would, else by the label patterns; null if unknown."""
    as_title = by_text(label)
    text = F.concat(F.lit(" "), F.lower(label), F.lit(" "))
    known = once(text, lambda t: F.coalesce(*[F.when(t.rlike(found_ascii_words(p)), key) for p, key in LABEL_RULES]))
    return F.when(F.length(label) >= 2, once(as_title, lambda key: F.coalesce(F.when(key != MIXED, key), known)))


def house_category(house: Column, raw: Column, ids: Column | None = None) -> Column:
    """Struct (key, label): a source's own category of a lot from its raw payload, as one of the taxonomy. ``ids`` is the
    key of the source that numbers its categories, looked up by the caller; sources without a use for theirs give nulls."""
    field = lambda name: F.nullif(F.coalesce(F.get_json_object(raw, f"$.item.{name}"), F.get_json_object(raw, f"$.{name}")), F.lit(""))
    keys = F.create_map(*[F.lit(v) for pair in HOUSE_KEYS.items() for v in pair])
    pair = lambda key, label: F.struct(key.alias("key"), label.alias("label"))
    own, fine, top, name = field("category"), F.coalesce(field("subcategory"), field("category")), field("categoryNameLevel1"), field("categoryName")
    none = F.lit(None).cast("string")
    return (
        F.when(house == "auctionet", pair(none if ids is None else ids, field("category_id")))
        .when(house == "budi", pair(F.coalesce(keys[own], by_label(own)), own))
        .when(house == "vaxxa", pair(by_label(fine), fine))
        .when(house == "klaravik", pair(by_label(top), top))
        .when(house == "tradera", pair(by_name(name), name))
        .when(house == "pantbanken", pair(F.when(raw.isNotNull(), "smycken/smycken-sub"), F.when(raw.isNotNull(), "pantbank")))
        .otherwise(pair(none, none))
    )


def classified(text_key: Column, house_key: Column, house_name: Column) -> Column:
    """Struct (category, confidence): mixed lots first, then the house's category unless it says nothing, then text."""
    usable = house_key.isNotNull() & ~F.coalesce(F.lower(house_name).rlike(CATCH_ALL), F.lit(False))
    pair = lambda k, c: F.struct(k.alias("category"), F.lit(c).alias("confidence"))
    return F.when(text_key == MIXED, pair(F.lit(MIXED), "mixed")).when(usable, pair(house_key, "house")).when(text_key.isNotNull(), pair(text_key, "text")).otherwise(pair(F.lit(UNSORTED), "none"))


def confidence_rank(confidence: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair])
    return F.coalesce(ranks[confidence], F.lit(0))


def conflict(text_key: Column, confidence: Column, house_key: Column) -> Column:
    """True when a sure text category and the house's own have different mains."""
    return F.coalesce((confidence == "text") & (top_level(text_key) != top_level(house_key)), F.lit(False))


def train_lexicon(rows: DataFrame, title: str, category: str) -> DataFrame:
    """(token, category, seen) counts over titles with a known, sorted category."""
    known = rows.filter(F.col(category).isNotNull() & ~F.col(category).startswith("ovrigt"))
    return known.select(F.explode(title_tokens(F.col(title))).alias("token"), F.col(category).alias("category")).groupBy("token", "category").agg(F.count(F.lit(1)).alias("seen"))


def merge_lexicon(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts add up."""
    return old.unionByName(new).groupBy("token", "category").agg(F.sum("seen").alias("seen"))


def vote(titles: DataFrame, key: str, title: str, lexicon: DataFrame, min_evidence: int = MIN_EVIDENCE, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, category, evidence, share) for the rows whose tokens agree. A token's votes weigh by how concentrated it
    is; ties go to the category that sorts first. Equal titles vote once."""
    weight = lexicon.groupBy("token").agg((F.max("seen") / F.sum("seen")).alias("conc"))
    votes = lexicon.join(weight, "token").select("token", "category", "seen", (F.col("seen") * F.col("conc")).alias("w"))
    distinct = titles.select(F.col(title).alias("__title")).distinct().select("__title", F.explode(title_tokens(F.col("__title"))).alias("token"))
    sums = distinct.join(votes, "token").groupBy("__title", "category").agg(F.sum("w").alias("w"), F.sum("seen").alias("evidence"))
    best = sums.groupBy("__title").agg(F.sum("w").alias("total"), F.min(F.struct((-F.col("w")).alias("n"), "category", "evidence")).alias("top"))
    won = best.select("__title", "top.category", "top.evidence", (-F.col("top.n") / F.col("total")).alias("share")).filter((F.col("evidence") >= min_evidence) & (F.col("share") >= min_share))
    return titles.join(won, titles[title] == won["__title"]).select(titles[key], "category", "evidence", "share")


def learned_or_ask(rows: DataFrame, key: str, title: str, lexicon: DataFrame, min_evidence: int = MIN_EVIDENCE, min_share: float = MIN_SHARE) -> DataFrame:
    """``rows`` with the ``category`` that the lexicon is sure of and the ``way`` it is found: 'learned', or 'ask' for
    those that a service has to be asked about."""
    won = vote(rows, key, title, lexicon, min_evidence, min_share).select(F.col(key).alias("__key"), "category")
    found = rows.drop("category").join(won, rows[key] == won["__key"], "left").drop("__key")
    return found.withColumn("way", F.when(F.col("category").isNull(), "ask").otherwise("learned"))
