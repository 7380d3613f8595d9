"""Text functions as column expressions. All of them take and return columns; null in means null out unless said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..rules.tables import BRAND, CITY_NAMES, CONDITION_NEW, CONDITION_UNTESTED, ENTITIES, LOT_COUNT, LOT_PAIR, NEW_THING, PLATE, STOP_WORDS
from .regex import ascii_words, escape, unicode_words

QUOTES = "\"”“„"


def normalise_location(col: Column) -> Column:
    """Without the leading postcode, up to the first comma, trimmed, lower case; null gives ''."""
    return F.lower(F.trim(F.split_part(F.regexp_replace(F.coalesce(col, F.lit("")), "^[0-9 ]+", ""), F.lit(","), F.lit(1))))


def city_name(col: Column) -> Column:
    """The home spelling of a city known under a foreign one; others as they are."""
    known = F.create_map(*[F.lit(x) for pair in CITY_NAMES.items() for x in pair])
    return F.coalesce(known[F.lower(F.trim(col))], col)


def location_pattern(place: str) -> str:
    """A pattern for a place under any of its spellings."""
    return "(?iu)" + "|".join(escape(v) for v in [place, *(k for k, v in CITY_NAMES.items() if v == place)])


def condition_badge(col: Column) -> Column:
    """'ny', 'otestad' or null from a description."""
    return F.when(col.rlike(unicode_words(CONDITION_NEW)), "ny").when(col.rlike(unicode_words(CONDITION_UNTESTED)), "otestad")


def lot_count(title: Column) -> Column:
    """Number of pieces a title states: 'N st', a pair is 2, else null."""
    stated = F.nullif(F.regexp_extract(title, ascii_words(LOT_COUNT), 1), F.lit("")).cast("long")
    pair = title.rlike(ascii_words(LOT_PAIR))
    return F.coalesce(F.when(stated > 0, stated), F.when(pair, F.lit(2).cast("long")))


def quoted_models(title: Column) -> Column:
    """Names of 2 to 40 characters between double quotes, as an array."""
    found = F.regexp_extract_all(title, F.lit(f"[{QUOTES}]([^{QUOTES}]{{2,40}})[{QUOTES}]"), F.lit(1))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.length(s) >= 2)


def title_tokens(title: Column) -> Column:
    """Up to 12 distinct telling words of a title, in order."""
    words = F.split(F.lower(title), "[^a-zåäöéü]+")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))), 1, 12)


def telling_words(title: Column, most: int = 5) -> Column:
    """Up to ``most`` distinct words of four letters or more, longest first, earlier first among equals."""
    words = F.array_distinct(F.filter(F.split(F.lower(title), "[^a-z0-9åäöéü]+"), lambda w: (F.length(w) >= 4) & ~w.rlike("^[0-9]+$")))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(ranked, lambda s: s["w"]), 1, most)


def top_level(key: Column) -> Column:
    return F.substring_index(F.nullif(key, F.lit("")), "/", 1)


def main_category(key: Column) -> Column:
    """The main part of a key; null for the unsorted main."""
    return F.nullif(top_level(key), F.lit("ovrigt"))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is costly and used more than once, so that it is computed once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def plate(text: Column) -> Column:
    """A registration plate in a text, without look-alikes such as AAA000."""
    # letter by letter, as the other engine does: F.upper makes two letters of some and so finds ASS 123 in "aß 123"
    upper = F.translate(text, "abcdefghijklmnopqrstuvwxyzıſ", "ABCDEFGHIJKLMNOPQRSTUVWXYZIS")
    pattern = ascii_words(PLATE).replace(r"\s", r"[\t\n\f\r ]")
    found = F.concat(F.regexp_extract(upper, pattern, 1), F.regexp_extract(upper, pattern, 2))
    sample = found.rlike(r"^(.)\1\1") & found.contains("000")
    return F.when((found != "") & ~sample, found)


def number(text: Column) -> Column:
    """A number written with space or dot thousands and a decimal comma, as a double; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(text, "[\\s ]", ""), r"\.(?=\d{3}(\D|$))", "")
    return F.regexp_replace(bare, ",", ".").try_cast("double")


def digits(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit("")).try_cast("long")


def unescape(text: Column) -> Column:
    """Common character references; the ampersand last."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_html(html: Column) -> Column:
    """Text on one line: no scripts, styles or tags, references decoded, white space squeezed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, "<[^>]*>", " ")), r"\s+", " "))


def strip_html_lines(html: Column) -> Column:
    """Text that keeps line breaks where blocks end."""
    broken = F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", "\n"), r"(?i)</(p|div|li|h[1-6]|tr)>", "\n")
    bare = unescape(F.regexp_replace(broken, "<[^>]*>", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\n\s*\n+", "\n"))


#: A tag with its attributes; a mark inside a quoted value does not end it.
_TAG_REST = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
#: Tags that may stay (fixed values).
SAFE_TAGS = ("p", "br", "ul", "ol", "li", "strong", "b", "em", "i", "h2", "h3", "h4", "div", "span")


def allow_tags(html: Column, tags: tuple[str, ...] = SAFE_TAGS) -> Column:
    """Markup with only the named tags and no attributes; scripts, styles and comments go with their content, other tags
    leave a space, and a mark that is no part of a tag is written as a reference."""
    bare = F.regexp_replace(F.translate(html, "\u0001\u0002", ""), r"(?is)<(script|style)[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    known = "|".join(tags)
    bare = F.regexp_replace(bare, rf"(?i)<(/?)({known})(?![a-z0-9-]){_TAG_REST}", "\u0001$1$2\u0002")
    bare = F.regexp_replace(bare, rf"(?i)</?[a-z!?]{_TAG_REST}", " ")
    bare = F.replace(F.replace(bare, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lowered = F.transform(F.split(bare, "\u0001"), lambda p, i: F.when(i > 0, F.concat(F.lit("<"), F.lower(F.substring_index(p, "\u0002", 1)), F.lit(">"), F.substring(p, F.length(F.substring_index(p, "\u0002", 1)) + 2, F.length(p)))).otherwise(p))
    return F.array_join(lowered, "")


def slug(text: Column) -> Column:
    folded = F.translate(F.lower(text), "åäöéèüàçñóíêß", "aaoeeuacnoies")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def item_text(title: Column, description: Column, most: int = 400) -> Column:
    """Title and the squeezed start of the description, as one text."""
    body = F.left(F.trim(F.regexp_replace(F.coalesce(description, F.lit("")), r"\s+", " ")), F.lit(most))
    return F.when(body == "", title).otherwise(F.concat(title, F.lit(". "), body))


def preview(description: Column, most: int = 160) -> Column:
    return F.left(F.trim(F.regexp_replace(description, r"\s+", " ")), F.lit(most))


def fitted(text: Column, most: int) -> Column:
    """The text if it fits, else cut with an ellipsis."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.rtrim(F.left(text, F.lit(most - 1))), F.lit("…")))


def image_url(url: Column) -> Column:
    """An image address without the suffix for its size."""
    return F.regexp_replace(url, r"(?i)([_-](thumb|small|mid|large|\d+x\d+))(?=\.(jpe?g|png|webp))", "")


def normalise_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def worth_expanding(query: Column) -> Column:
    """Long enough, with four letters in a row, and not a sentence."""
    q = normalise_query(query)
    return (F.length(q) >= 4) & (F.length(q) <= 60) & q.rlike(r"\p{L}{4,}")


def label_value(text: Column, label: str, following: tuple[str, ...], most: int = 80) -> Column:
    """The value after 'label:' up to the next known label, at most ``most`` characters; null if none."""
    stop = "|".join(escape(x) for x in following)
    found = F.regexp_extract(text, rf"(?is)(?<![\p{{L}}]){escape(label)}\s*:\s*(.*?)(?=\s*(?:(?:{stop})\s*:|[\n;]|$))", 1)
    return F.nullif(F.trim(F.left(found, F.lit(most))), F.lit(""))


def brand(title: Column) -> Column:
    """The first word of a title when it starts upper case and is no number."""
    first = F.split(F.trim(title), r"\s+").getItem(0)
    return F.when(first.rlike(r"^\p{Lu}[\p{L}&.-]+$"), first)


def condition(description: Column, title: Column | None = None) -> Column:
    """'new' when a text says that a thing is new or unused, else 'used'."""
    text = F.lower(description if title is None else F.concat_ws(" ", description, title))
    return F.when(text.rlike(ascii_words(NEW_THING)), "new").otherwise("used")


def stated_brand(description: Column) -> Column:
    """The first word behind 'Märke', 'Fabrikat' or 'Tillverkare' in a description; null if none is stated."""
    found = F.trim(F.regexp_extract(strip_html_lines(description), BRAND, 1))
    return F.nullif(F.substring_index(found, " ", 1), F.lit(""))


def text_key(*columns: Column) -> Column:
    """One text for a key of several columns."""
    return F.concat_ws("/", *columns)
