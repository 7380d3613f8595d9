"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is walked once on the driver to derive a Boolean trigram query: the alternatives of the
pattern become conjunctions of the trigrams that any match must hold (case folded). The index is the table of postings
(trigram, document) over the trigrams that some rule asks for; a rule's candidates are the documents in the
intersection of one conjunction's postings. Candidates' texts are then verified with the expression itself. Rules
without a mandatory trigram scan every text.

Spans come from one pass of the expression that puts a mark around each match: the pieces between marks are numbered,
and a running sum of their code points gives starts and ends. Postings carry keys only; a bitmap of the candidates'
keys, of bounded size, keeps most other texts out of the join that brings candidates their text.
Masking replaces the spans that were found, whatever rule gave them.

Edge cases: null and empty texts have no spans; the mark character inside a text is replaced by another that no rule
can match, so offsets never move; overlapping spans of different kinds all stay; rows equal in id and text share their
spans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ID, PROBE, RK, ascii_lower, aside, durable, key_bitmap, keyed, maybe_among

SPANS = "__spans"
MARK, STAND_IN = "\u0001", "�"
MASK = "[REDACTED]"
#: Classes of more characters than this end a literal run instead of branching it.
BRANCH = 8
STATES = 256


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    any_case: bool = False
    #: Group whose text must have ``at_least`` characters for a match to count; 0 is the whole match.
    group: int = 0
    at_least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, at_least=6),
    Rule("access", "AKIA[A-Z0-9]+", at_least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: A private key is one secret from its first line to its last; where the last is missing, the lines of key material.
_KEY_END = r"[A-Za-z0-9+/=:,.\x20\x09-\x0D\\-]*?-----END [A-Z ]*PRIVATE KEY-----"
_KEY_LINES = r"(?:[\x20\x09-\x0D]+[A-Za-z0-9+/=]{16,})*+"
ADDED = (
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_END}|{_KEY_LINES})"),
    Rule("github", "gh[opsu]_[A-Za-z0-9]{36}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: Parts of a pattern: ("char", c), ("any", characters or None), ("one of", branches), ("times", low, high, part), ("none",).
Part = tuple
State = tuple[str, frozenset[str]]
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}
_UNBOUNDED = 1 << 30


class _Reader:
    """Reads the expressions that rules are written in: literals, escapes, classes, groups, alternatives, counts."""

    def __init__(self, pattern: str) -> None:
        self.rest = pattern

    def take(self, start: str) -> bool:
        if not self.rest.startswith(start):
            return False
        self.rest = self.rest[len(start) :]
        return True

    def next(self) -> str:
        char, self.rest = self.rest[0], self.rest[1:]
        return char

    def branches(self) -> list[list[Part]]:
        out: list[list[Part]] = [[]]
        while self.rest and self.rest[0] != ")":
            if self.take("|"):
                out.append([])
            else:
                out[-1].append(self.counted(self.part()))
        return out

    def part(self) -> Part:
        char = self.next()
        if char == "(":
            looks = any(self.take(x) for x in ("?=", "?!", "?<=", "?<!"))
            if not looks and self.take("?") and not self.take(":"):
                raise ValueError("flags and names are not read")
            inner = self.branches()
            self.take(")")
            return ("none",) if looks else ("one of", inner)
        if char == "[":
            return ("any", self.members())
        if char == "\\":
            return self.escape()
        return ("none",) if char in "^$" else ("any", None) if char == "." else ("char", char)

    def escape(self) -> Part:
        char = self.next()
        if char == "x":
            return ("char", chr(int(self.next() + self.next(), 16)))
        if char in "bBAzZ":
            return ("none",)
        return ("any", None) if char in "dDsSwW" or char.isdigit() else ("char", _ESCAPED.get(char, char))

    def members(self) -> frozenset[str] | None:
        """Characters of a class; nothing for one that is negated or has a class inside."""
        known, chars = not self.take("^"), set()
        while True:
            char = self.next()
            if char == "]":
                return frozenset(chars) if known else None
            part = self.escape() if char == "\\" else ("char", char)
            if part[0] != "char":
                known = False
            elif self.rest[0] == "-" and self.rest[1] != "]":
                self.next()
                chars |= {chr(c) for c in range(ord(part[1]), ord(self.next()) + 1)}
            else:
                chars.add(part[1])

    def counted(self, part: Part) -> Part:
        if self.take("*"):
            part = ("times", 0, _UNBOUNDED, part)
        elif self.take("+"):
            part = ("times", 1, _UNBOUNDED, part)
        elif self.take("?"):
            part = ("times", 0, 1, part)
        elif self.take("{"):
            bounds, self.rest = self.rest.split("}", 1)
            low, _, high = bounds.partition(",")
            part = ("times", int(low), int(high) if high else _UNBOUNDED if "," in bounds else int(low), part)
        else:
            return part
        self.take("?") or self.take("+")
        return part


def _low(char: str) -> str:
    return char.lower() if char.isascii() else char


def _put(states: set[State], char: str) -> set[State]:
    out = set()
    for tail, grams in states:
        run = (tail + char)[-3:]
        out.add((run, grams | {run} if len(run) == 3 else grams))
    return out


def _cut(states: set[State]) -> set[State]:
    return {("", grams) for _, grams in states}


def _after(states: set[State], part: Part) -> set[State]:
    kind = part[0]
    if kind == "char":
        return _put(states, _low(part[1]))
    if kind == "any":
        chars = {_low(c) for c in part[1] or ()}
        return set().union(*(_put(states, c) for c in chars)) if 0 < len(chars) <= BRANCH else _cut(states)
    if kind == "one of":
        return set().union(*(_walk(states, branch) for branch in part[1]))
    if kind == "times":
        _, low, high, inner = part
        done = states
        for _ in range(min(low, 3)):
            done = _after(done, inner)
        if (low, high) == (0, 1):
            return states | _after(states, inner)
        return _cut(done) if low > 3 or high > max(low, 1) else done
    return states


def _walk(states: set[State], parts: list[Part]) -> set[State]:
    for part in parts:
        states = _after(states, part)
        if len(states) > STATES:  # what all share still is mandatory
            states = {("", frozenset.intersection(*(g for _, g in states)))}
    return states


def trigram_query(pattern: str) -> set[frozenset[str]]:
    """Alternatives of which one must hold, each a set of trigrams that must all occur; empty: no mandatory trigram."""
    found = {grams for _, grams in _after({("", frozenset())}, ("one of", _Reader(pattern).branches()))}
    if frozenset() in found:
        return set()
    return {g for g in found if not any(h < g for h in found)}


def postings(texts: DataFrame, grams: list[str], text_col: str = "text") -> DataFrame:
    """The inverted index (gram, __id, __rk) over the given trigrams."""
    low = ascii_lower(F.col(text_col))
    held = F.array(*[F.when(F.contains(F.col("__low"), F.lit(g)), F.lit(g)) for g in grams])
    return texts.select(ID, RK, low.alias("__low")).select(ID, RK, F.explode(F.array_compact(held)).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, set[frozenset[str]]]) -> DataFrame:
    """(kind, __id, __rk): documents in the intersection of the postings of one alternative of a rule."""
    terms = [(kind, n, len(grams), g) for kind, alternatives in queries.items() for n, grams in enumerate(sorted(alternatives, key=sorted)) for g in sorted(grams)]
    asked = index.sparkSession.createDataFrame(terms, "kind string, alternative int, need int, gram string")
    met = index.join(F.broadcast(asked), "gram").groupBy(ID, RK, "kind", "alternative", "need").agg(F.countDistinct("gram").alias("have"))
    return met.filter("have = need").select("kind", ID, RK).distinct()


def _matches(texts: DataFrame, rule: Rule) -> DataFrame:
    """(__id, __rk, kind, start, end) of the rule's matches that count; texts: (__id, __rk, text)."""
    marked = F.regexp_replace(F.translate("text", MARK, STAND_IN), F.lit(rule.java), F.lit(f"{MARK}$0{MARK}"))
    pieces = texts.filter(F.col("text").rlike(rule.java)).withColumn("row", F.monotonically_increasing_id()).select(ID, RK, "row", F.posexplode(F.split(marked, MARK, -1)).alias("n", "piece"))
    order = Window.partitionBy("row", ID, RK).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = pieces.withColumn("end", F.sum(F.char_length("piece")).over(order)).filter("n % 2 = 1")
    counted = F.col("piece") if not rule.group else F.regexp_extract("piece", rule.java, rule.group)
    return placed.filter(F.char_length(counted) >= rule.at_least).select(ID, RK, F.lit(rule.kind).alias("kind"), (F.col("end") - F.char_length("piece")).alias("start"), "end")


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__id, __rk, kind, start, end) of every secret in ``docs``; offsets in code points, end exclusive."""
    texts = keyed(docs, id_col, text_col).select(ID, RK, F.col(text_col).alias("text")).filter("text IS NOT NULL AND text != ''")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    found = None
    chosen = None
    if indexed:
        grams = sorted(set().union(*(g for q in indexed.values() for g in q)))
        index = durable(postings(texts, grams), "postings")
        kinds = durable(candidates(index, indexed).groupBy(ID, RK).agg(F.collect_set("kind").alias("kinds")), "kinds")
        likely, _ = maybe_among(texts, key_bitmap(kinds))
        chosen = durable(likely.join(kinds, [ID, RK]), "candidates")
    for rule in rules:
        source = chosen.filter(F.array_contains("kinds", rule.kind)) if rule.kind in indexed else texts
        spans = _matches(source.select(ID, RK, "text"), rule)
        found = spans if found is None else found.union(spans)
    return found.distinct()


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<base kind>..., base_sha256, spans) per row."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = find_spans(docs, rules, id_col, text_col).select(ID, RK, F.struct("start", F.array_position(kinds, F.col("kind")).alias("turn"), "kind", "end").alias("span"))
    grouped = spans.groupBy(ID, RK).agg(F.array_sort(F.collect_list("span")).alias("all_spans"))
    rows = keyed(docs, id_col, text_col).select(id_col, ID, RK).join(grouped, [ID, RK], "left")
    rows = rows.withColumn("all_spans", F.coalesce("all_spans", F.array().cast("array<struct<start:bigint,turn:bigint,kind:string,end:bigint>>")))
    rows = rows.withColumn("base_spans", F.filter("all_spans", lambda s: s["turn"] <= len(base)))

    def of_kind(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of_kind(r.kind) for r in base]
    return rows.select(id_col, *counts, F.sha2(_listed("base_spans"), 256).alias("base_sha256"), _listed("all_spans").alias("spans"))


def masked_text(text: Column, spans: Column, mask: str = MASK, step: int = 4096) -> Column:
    """``text`` with each span of ``spans`` (ascending structs of start and end in code points) replaced by ``mask``,
    overlapping ones by a single one. The text is cut into pieces of ``step`` code points first, so that the work does
    not grow with the product of its length and its spans."""

    def piece_without(piece: Column, number: Column) -> Column:
        base = number.cast("long") * step
        local = F.filter(spans, lambda s: (s["end"] > base) & (s["start"] < base + step))
        part = lambda start, end: F.substring(piece, (start - base + 1).cast("int"), (end - start).cast("int"))

        def add(done: Column, span: Column) -> Column:
            opens = F.when((span["start"] >= done["at"]) & (span["start"] >= base), mask).otherwise("")
            kept = F.when(span["start"] > done["at"], part(done["at"], span["start"])).otherwise("")
            return F.struct(F.concat(done["out"], kept, opens).alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

        nothing = F.struct(F.lit("").alias("out"), base.alias("at"))
        return F.aggregate(local, nothing, add, lambda done: F.concat(done["out"], F.when(done["at"] < base + step, part(done["at"], base + step)).otherwise("")))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), piece_without), "")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span that ``find_spans`` gives replaced by ``MASK``; texts without one stay as they were."""
    docs, back = aside(docs, ID, RK, SPANS, *PROBE)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    spans = find_spans(docs, rules, id_col, text_col).groupBy(ID, RK).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(SPANS))
    spans = durable(spans, "spans")
    likely, quiet = maybe_among(keyed(docs, id_col, text_col), key_bitmap(spans))
    masked = F.when(F.col(SPANS).isNotNull(), masked_text(F.col(text_col), F.col(SPANS))).otherwise(F.col(text_col))
    return back(quiet.select(*columns).union(likely.join(spans, [ID, RK], "left").withColumn(text_col, masked).select(*columns)))
