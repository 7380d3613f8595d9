"""Answers of classification and query-expansion services, taken as text columns and turned into checked rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import normalise_query, plate
from ..rules.classify import confidence_rank
from ..rules.tables import TAXONOMY

MAINS = sorted({m for m, _, _, _ in TAXONOMY})
KEYS = sorted({f"{m}/{s}" for m, _, s, _ in TAXONOMY})
#: Most synonyms, related terms and categories of an expansion.
MOST = {"synonyms": 8, "related": 14, "categories": 3}
_FENCE = r"(?i)```(?:json)?"
_FIELDS = {"b": 60, "m": 60, "d": 60, "t": 40, "mat": 40}
_ATTRS = "b:string,m:string,d:string,t:string,mat:string,y:int,reg:string"


def checked_key(key: Column) -> Column:
    """A known category; the main of one whose sub is unknown; null for anything else."""
    main = F.substring_index(key, "/", 1)
    return F.when(key.isin(*KEYS, *MAINS), key).when(main.isin(*MAINS), main)


def whole(text: Column, low: int, high: int) -> Column:
    """A whole number from ``low`` to ``high``, else null."""
    x = text.try_cast("double")
    return F.when((x == F.floor(x)) & x.between(low, high), x.cast("int"))


def clean_attributes(answer: Column) -> Column:
    """Attributes of an answer (a map of strings): squeezed, cut, of two characters at least, years from 1000 to 2100,
    plates only if they are some; null when nothing is left."""
    text = lambda k: F.left(F.trim(F.regexp_replace(answer[k], r"\s+", " ")), F.lit(_FIELDS[k]))
    parts = [F.when(F.length(text(k)) >= 2, text(k)).alias(k) for k in _FIELDS]
    parts += [whole(answer["y"], 1000, 2100).alias("y"), plate(answer["reg"]).alias("reg")]
    return F.when(reduce(lambda a, b: a | b, [p.isNotNull() for p in parts]), F.struct(*parts))


def verdicts(answers: DataFrame, key: str, col: str, count: str) -> DataFrame:
    """(key, i, category, n, attrs) for every readable object of an answer: even a cut-off answer gives its whole
    objects. Indexes outside 0..count-1 and unknown categories are dropped; of equal indexes the first stays."""
    objects = F.regexp_extract_all(F.regexp_replace(col, _FENCE, ""), F.lit(r"\{[^{}]*\}"), F.lit(0))
    rows = answers.select(key, count, F.posexplode(objects).alias("at", "o")).withColumn("m", F.from_json("o", "map<string,string>"))
    rows = rows.select(key, "at", F.col("m"), whole(F.col("m.i"), 0, (1 << 31) - 1).alias("i"), checked_key(F.col("m.k")).alias("category"), count)
    fine = rows.filter((F.col("i") < F.col(count)) & F.col("category").isNotNull())
    out = fine.groupBy(key, "i").agg(F.min_by(F.struct("category", whole(F.col("m.n"), 1, 10_000).alias("n"), clean_attributes(F.col("m")).alias("attrs")), "at").alias("v"))
    return out.select(key, "i", "v.category", "v.n", "v.attrs")


def expansion(answer: Column, query: Column) -> Column:
    """Struct of synonyms, related terms and categories of an answer, or null if it is no JSON object. Terms are
    normalised, distinct, of 2 to 40 characters, and neither the query nor a bare word of it."""
    parsed = F.from_json(F.regexp_extract(F.regexp_replace(answer, _FENCE, ""), r"(?s)\{.*\}", 0), "synonyms array<string>, related array<string>, categories array<string>")
    asked = normalise_query(query)
    words = F.filter(F.split(asked, " "), lambda w: F.length(w) >= 2)
    bare = lambda t: (F.size(words) > 1) & F.array_contains(words, t)

    def terms(name: str) -> Column:
        found = F.transform(F.coalesce(parsed[name], F.array().cast("array<string>")), normalise_query)
        return F.slice(F.array_distinct(F.filter(found, lambda t: F.length(t).between(2, 40) & (t != asked) & ~bare(t))), 1, MOST[name])

    categories = F.slice(F.filter(F.coalesce(parsed["categories"], F.array().cast("array<string>")), lambda c: c.isin(*KEYS, *MAINS)), 1, MOST["categories"])
    return F.when(parsed.isNotNull() & F.coalesce(parsed["synonyms"], parsed["related"], parsed["categories"]).isNotNull(), F.struct(terms("synonyms").alias("synonyms"), terms("related").alias("related"), categories.alias("categories")))


def apply_verdicts(items: DataFrame, found: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next items, rows for the lexicon). A verdict counts where the present confidence ranks lower; the lot count is
    kept where the verdict has none; attributes are merged field by field, new ones first."""
    v = found.select(*key, *[F.col(c).alias("v_" + c) for c in ("category", "n", "attrs")])
    rows = items.join(v, key, "left")
    takes = F.col("v_category").isNotNull() & (confidence_rank(F.col("category_conf")) < confidence_rank(F.lit("llm")))
    merged = F.struct(*[F.coalesce(F.col(f"v_attrs.{f}"), F.col(f"attrs.{f}")).alias(f) for f in [x.split(":")[0] for x in _ATTRS.split(",")]])
    new = {"category": F.col("v_category"), "category_conf": F.lit("llm"), "category_conflict": F.lit(False), "lot_count": F.coalesce("v_n", "lot_count"), "attrs": F.when(F.col("v_attrs").isNotNull(), merged).otherwise(F.col("attrs"))}
    after = rows.select(*[F.when(takes, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])
    learn = rows.filter(takes & ~F.col("v_category").isin("ovrigt/diverse", "ovrigt/partier")).select("title", F.col("v_category").alias("category"))
    return after, learn
