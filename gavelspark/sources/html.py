"""Fields from pages: label and value pairs, tables as series, and the CSV export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.money import nice_ceiling
from ..functions.text import digits, number, once, strip_html, unescape
from ..rules.tables import MONTH_LABEL, PRICE_RANGE, VEHICLE

_PAIRS = (
    r"(?is)<t[hd][^>]*>\s*([^<>:]{2,60}?)\s*:?\s*</t[hd]>\s*<td[^>]*>(.*?)</td>",
    r"(?is)<dt[^>]*>\s*([^<>:]{2,60}?)\s*:?\s*</dt>\s*<dd[^>]*>(.*?)</dd>",
)


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a name that holds text only; '' if there is none."""
    return F.regexp_extract(html, rf"(?i)<{tag}>([^<]*)</{tag}>", 1)


def link_count(html: Column) -> Column:
    return F.size(F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long")


def raw_field(raw: Column, path: str, kind: str = "string") -> Column:
    """A field of a raw payload; ``path`` is dotted. Null where the payload or the field is missing."""
    return F.get_json_object(raw, f"$.{path}").try_cast(kind)


def label_values(html: Column) -> Column:
    """Map from labels to texts, over table and definition-list markup; the first of equal labels wins."""
    pairs = []
    for pattern in _PAIRS:
        keys, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(i)) for i in (1, 2))
        pairs.append(F.arrays_zip(keys.alias("k"), values.alias("v")))
    both = F.transform(F.concat(*pairs), lambda p: F.struct(p["k"].alias("k"), strip_html(p["v"]).alias("v")))
    empty = F.array().cast("array<struct<k:string,v:string>>")
    first = F.aggregate(both, empty, lambda seen, p: F.when(F.exists(seen, lambda s: s["k"] == p["k"]), seen).otherwise(F.concat(seen, F.array(p))))
    return F.map_from_entries(first)


def table_series(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, place, label, value) from the first two cells of each table row whose second is a number."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))).alias("place", "row"))
    cells = rows.select(key, "place", F.regexp_extract_all("row", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)).alias("c")).filter(F.size("c") >= 2)
    text = lambda i: strip_html(F.get(F.col("c"), F.lit(i)))
    return cells.select(key, "place", text(0).alias("label"), number(F.regexp_replace(text(1), r"(?i)\s*(kr|sek|%|st)\.?$", "")).alias("value")).filter("value IS NOT NULL")


def _amount(text: Column) -> Column:
    return F.when(digits(text) > 0, digits(text))


def price_range(html: Column, label: str) -> Column:
    """Struct (low, high) of the price after a heading; one number is both; null if there is none."""
    told = F.regexp_extract(html, PRICE_RANGE.format(label=label), 1)
    numbers = F.filter(F.transform(F.regexp_extract_all(unescape(told), F.lit(r"([\d \u00a0]{2,})"), F.lit(1)), _amount), lambda n: n.isNotNull())
    low = F.get(numbers, F.lit(0))
    return F.when(low.isNotNull(), F.struct(low.alias("low"), F.coalesce(F.get(numbers, F.lit(1)), low).alias("high")))


def vehicle(html: Column, plate: Column) -> Column:
    """The typed record of a vehicle's page, from its labels; null for a page of another vehicle."""
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)

    def record(labels: Column) -> Column:
        told = lambda name: F.try_element_at(labels, F.lit(VEHICLE[name]))
        day = lambda name: F.regexp_extract(told(name), r"\d{4}-\d{2}-\d{2}", 0).try_cast("date")
        yes = lambda name: F.when(told(name).rlike("(?i)^ja"), True).when(told(name).rlike("(?i)^nej"), False)
        kinds = {"status": told, "registered": day, "owners": lambda n: _amount(told(n)), "inspected": day, "odometer": lambda n: _amount(told(n)), "tax": lambda n: _amount(told(n)), "on_credit": yes, "imported": yes, "horsepower": lambda n: _amount(told(n))}
        fuel = F.coalesce(told("fuel"), told("other_fuel"))
        return F.struct(F.upper(plate).alias("plate"), *[kind(name).alias(name) for name, kind in kinds.items()], fuel.alias("fuel"))

    return F.when(F.upper(title).contains(F.upper(plate)), once(label_values(html), record))


def chart_kind(n: Column, shares: Column, dated: Column) -> Column:
    """'line' for dated labels, 'pie' for up to six parts of a whole, else 'bar'."""
    return F.when(dated, "line").when((n <= 6) & F.abs(shares - 100).between(0, 1), "pie").otherwise("bar")


def series_kind(rows: DataFrame, key: str) -> DataFrame:
    """(key, kind, top) for each series of ``table_series``: 'pie' for parts that make about a hundred, 'line' when every
    label is a year or a month, else 'bar'; ``top`` is where its axis ends."""
    label, value = F.trim("label"), F.col("value")
    sums = rows.groupBy(key).agg(F.sum("value").alias("sum"), F.max("value").alias("high"), F.min("value").alias("low"), F.bool_and(label.rlike(r"^\d{4}$")).alias("years"), F.bool_and(label.rlike(MONTH_LABEL)).alias("months"))
    kind = F.when((F.col("low") >= 0) & (F.col("high") <= 100) & F.col("sum").between(95, 100.5), "pie").when(F.col("years") | F.col("months"), "line").otherwise("bar")
    return sums.select(key, kind.alias("kind"), F.when(F.col("high") > 0, nice_ceiling(F.col("high"))).alias("top"))


#: Columns of the price export (fixed values).
EXPORT = ("titel", "hus", "datum", "bud_kr", "total_kr")


def export_prices(sales: DataFrame, path: str) -> None:
    """Sales as quoted CSV under the export's column names, with a byte order mark in front of each file's header, so
    that a spreadsheet reads it as UTF-8."""
    bom = "\ufeff" + EXPORT[0]
    rows = sales.select(F.col("title").alias(bom), F.col("house").alias("hus"), F.to_date("ended_at").cast("string").alias("datum"), F.col("final_bid").alias("bud_kr"), F.coalesce("final_total", "final_bid").alias("total_kr"))
    write_csv(rows, path)


def write_pages(rows: DataFrame, path: str) -> None:
    """Rows numbered by ``numbered_pages`` as one folder of Parquet for each page."""
    rows.write.partitionBy("page").mode("overwrite").parquet(path)


def addressed(blobs: DataFrame, content: str, url: str) -> DataFrame:
    """One row for each distinct content: its SHA-256, the least address it came from, and the place it is kept at."""
    sha = F.sha2(F.col(content).cast("binary"), 256)
    ending = F.nullif(F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{2,4})(?:[?#].*)?$", 1)), F.lit(""))
    found = blobs.filter(F.col(content).isNotNull()).select(sha.alias("sha256"), F.col(url).alias("url"), F.coalesce(ending, F.lit("jpg")).alias("ending"))
    one = found.groupBy("sha256").agg(F.min(F.struct("url", "ending")).alias("f"), F.count(F.lit(1)).alias("copies"))
    return one.select("sha256", "f.url", F.concat(F.left("sha256", F.lit(2)), F.lit("/"), "sha256", F.lit("."), "f.ending").alias("path"), "copies")


def url_batch(pending: DataFrame, sent: DataFrame, limit: int = 3000, kept: int = 50_000) -> DataFrame:
    """The next addresses to tell, each once, oldest first: of the ``kept`` oldest that were not told, ``limit``; the
    limits are the service's own. ``pending``: (url, seen)."""
    fresh = pending.groupBy("url").agg(F.min("seen").alias("seen")).join(sent.select("url"), "url", "left_anti")
    return fresh.orderBy("seen", "url").limit(min(limit, kept))


def write_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV with a header, a file for each partition."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').mode("overwrite").csv(path)
