"""Spans: what rules find in a text, and the algebra on what they found.

A span is STRUCT<entity_type, start, end, score, ord, tier>, half-open, counted in code points from 0; a text has an ARRAY of
them.  Everything here is a Column over built-in functions, so it runs in the JVM, row by row, with no shuffle.

Patterns have the flags (?U): classes are Unicode's.  A rule looks at a text only if a necessary condition holds, such as a
digit being there; conditions are cheap scans, and `when` keeps the patterns from running on the other texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import KEYWORD_SCORE, NEXT_LABEL, PATTERN_RULES, PERSON_VALUE, TIER_OF, TRAILING_LABEL, Rule, keyword_rules

SPAN = "struct<entity_type:string,start:int,end:int,score:double,ord:int,tier:int>"
SPANS = f"array<{SPAN}>"
#: Texts up to this many code points get the model pass, if there is one.
FAST_PATH_CHARS = 2000


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def tier(entity: Column) -> Column:
    """How specific a type is: 3, 2 or 0 by the table, else 1."""
    known = F.create_map(*[F.lit(x) for pair in TIER_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, entity), F.lit(1))


def span(entity, start: Column, end: Column, score, order=0, rank: Column | None = None) -> Column:
    e = F.lit(entity) if isinstance(entity, str) else entity
    rank = rank if rank is not None else F.lit(TIER_OF.get(entity, 1)) if isinstance(entity, str) else tier(e)
    o = F.lit(order) if isinstance(order, int) else order
    return F.struct(e.alias("entity_type"), start.cast("int").alias("start"), end.cast("int").alias("end"), (F.lit(score) if isinstance(score, float) else score).cast("double").alias("score"), o.cast("int").alias("ord"), rank.cast("int").alias("tier"))


def hits(text: Column, regex: str) -> Column:
    """ARRAY<STRUCT<start, end>> of all matches, left to right: the lengths of matches and of the gaps between them add up."""
    places = "array<struct<start:int,end:int>>"

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(found))
        step = F.zip_with(gaps, found, lambda g, h: F.struct(F.length(g).alias("gap"), F.length(h).alias("hit")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(places).alias("out"))

        def add(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + x["hit"]
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

        return F.aggregate(step, zero, add, lambda acc: acc["out"])

    return let(F.regexp_extract_all(text, F.lit(f"({regex})"), F.lit(1)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(F.array().cast(places)))


def has_digit(text: Column) -> Column:
    return text.rlike(r"(?U)\d")


def _possible(text: Column, rule: Rule, digit: Column | None) -> Column:
    """A necessary condition for a match of a pattern rule."""
    digit = has_digit(text) if digit is None else digit
    conditions = [digit if n == r"\d" else text.contains(n) if n.replace("-", "").replace("_", "").isalpha() or n in "@-" else text.rlike(n) for n in rule.needs]
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def match_spans(text: Column, rule: Rule, order: int = 0, digit: Column | None = None) -> Column:
    """Spans of a pattern rule, case-sensitive, non-overlapping, left to right."""
    found = F.transform(hits(text, f"(?U){rule.regex}"), lambda h: span(rule.entity, h["start"], h["end"], rule.score, order))
    return F.when(_possible(text, rule, digit), found).otherwise(no_spans()) if rule.needs else found


def folded(text: Column) -> Column:
    """Lower case, with the letters that match an ASCII letter in any case; for conditions only."""
    return F.lower(F.translate(text, "İıſK", "iisk"))


def keyword_spans(text: Column, rule: Rule, order: int = 0, fold: Column | None = None) -> Column:
    """Spans of the values behind a label: to the end of the line or the next label on it.

    A person's value is one to four capitalised words at its beginning, and nothing else is; other values need two characters.
    """

    def value(h: Column) -> Column:
        line = F.regexp_extract(F.substr(text, h["end"] + 1), r"^[^\n]*", 0)
        segment = F.split(line, f"(?iU){NEXT_LABEL}", 2)[0]
        if rule.entity == "PERSON":
            def person(s: Column) -> Column:
                name = F.regexp_extract(s, rf"(?U)^\s*({PERSON_VALUE})", 1)
                lead = F.length(F.regexp_extract(s, r"(?U)^\s*", 0))
                return F.when(name != "", span("PERSON", h["end"] + lead, h["end"] + lead + F.length(name), KEYWORD_SCORE, order))
            return let(segment, person)

        def other(s: Column) -> Column:
            kept = F.regexp_replace(s, r"(?U)\s+$", "")
            inner = F.length(F.regexp_replace(kept, r"(?U)^\s+", ""))
            return F.when(inner > 1, span(rule.entity, h["end"], h["end"] + F.length(kept), rule.score, order))

        return let(segment, other)

    found = F.filter(F.transform(hits(text, f"(?iU){rule.regex}"), value), lambda s: s.isNotNull())
    if not rule.needs:
        return found
    fold = folded(text) if fold is None else fold
    possible = fold.contains(rule.needs[0])
    for n in rule.needs[1:]:
        possible = possible | fold.contains(n)
    if "[:=]\\s*" in rule.regex and "[:=]?" not in rule.regex:
        possible = (text.contains(":") | text.contains("=")) & possible
    elif rule.regex.startswith("(?:mr"):
        possible = possible & text.rlike(r"(?iU)(?:mr|mrs|ms|dr|prof)\.?\s+[A-Z]")
    return F.when(possible, found).otherwise(no_spans())


def keyword_scan(text: Column, rules: list[Rule] | None = None, first: int = 100, fold: Column | None = None) -> Column:
    """Spans of all labels, in order of the rules."""
    rules = keyword_rules() if rules is None else rules
    return F.concat(*[keyword_spans(text, r, first + k, fold) for k, r in enumerate(rules)]) if rules else no_spans()


def pattern_scan(text: Column, rules: list[Rule] | None = None, digit: Column | None = None) -> Column:
    """Spans of all pattern rules, in order of the rules."""
    rules = PATTERN_RULES if rules is None else rules
    return F.concat(*[match_spans(text, r, k, digit) for k, r in enumerate(rules)]) if rules else no_spans()


def piece(text: Column, s: Column) -> Column:
    return F.substr(text, s["start"] + 1, s["end"] - s["start"])


def _ending(s: Column, end: Column) -> Column:
    return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), end.cast("int").alias("end"), s["score"].alias("score"), s["ord"].alias("ord"), s["tier"].alias("tier"))


def clip_at_newline(spans: Column, text: Column) -> Column:
    """Spans end before their first line break; one with nothing but blanks before it goes."""

    def clip(s: Column) -> Column:
        return let(F.split(piece(text, s), "\n", 2)[0], lambda head: F.when(F.length(head) == s["end"] - s["start"], s).when(head.rlike(r"(?U)\S"), _ending(s, s["start"] + F.length(head))))

    return F.when(F.instr(text, "\n") == 0, spans).otherwise(F.filter(F.transform(spans, clip), lambda s: s.isNotNull()))


def trim_trailing_labels(spans: Column, text: Column) -> Column:
    """Persons end before a field label at their end; one that is nothing else goes."""

    def trim(s: Column) -> Column:
        head = F.split(piece(text, s), f"(?iUd){TRAILING_LABEL}", 2)[0]
        return F.when(~s["entity_type"].isin("PERSON", "NAME"), s).otherwise(let(F.length(head), lambda n: F.when(n == s["end"] - s["start"], s).when(n > 0, _ending(s, s["start"] + n))))

    return F.filter(F.transform(spans, trim), lambda s: s.isNotNull())


def _before(a: Column, b: Column) -> Column:
    """Order of spans: start, longer first, higher score first, then order of the source."""

    def by(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x > y, F.lit(1)).otherwise(rest)

    last = by(a["ord"], b["ord"], F.lit(0))
    return by(a["start"], b["start"], by(b["end"] - b["start"], a["end"] - a["start"], by(b["score"], a["score"], last)))


def _replaced(acc: Column, s: Column) -> Column:
    return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(s))


def resolve(spans: Column) -> Column:
    """Disjoint spans, from left to right, by a fold: each span meets the last one kept.

    No overlap: it is kept too.  Equal lengths: the more specific type stays, then the higher score, then the first.  Else the longer
    one stays, even if the shorter reaches beyond it.
    """

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        size, kept = s["end"] - s["start"], last["end"] - last["start"]
        better = (s["tier"] > last["tier"]) | ((s["tier"] == last["tier"]) & (s["score"] > last["score"]))
        wins = (size > kept) | ((size == kept) & better)
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] >= last["end"], F.concat(acc, F.array(s))).when(wins, _replaced(acc, s)).otherwise(acc)

    folded_spans = F.aggregate(F.array_sort(spans, _before), no_spans(), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(fold(acc, s)))
    return F.when(F.size(spans) > 1, folded_spans).otherwise(spans)


def window_dedup(spans: Column) -> Column:
    """Disjoint spans of overlapping windows: by start, longer first; an overlap keeps the longer one, the first if equal."""

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = s["end"] - s["start"] > last["end"] - last["start"]
        return F.when(s["start"] >= last["end"], F.concat(acc, F.array(s))).when(longer, _replaced(acc, s)).otherwise(acc)

    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum((b["end"] - b["start"]) - (a["end"] - a["start"])).cast("int")))
    return F.aggregate(ordered, no_spans(), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(fold(acc, s)))


def merge_adjacent(spans: Column, gap: int = 1) -> Column:
    """Neighbours of one type at most `gap` characters apart become one; spans are in order."""

    def fold(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (last["entity_type"] == s["entity_type"]) & (s["start"] - last["end"] <= gap)
        return F.when(joins, _replaced(acc, _ending(last, s["end"]))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, no_spans(), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(fold(acc, s)))


def trim_leading_space(spans: Column, text: Column) -> Column:
    """Spans begin at their first character that is not blank."""

    def trim(s: Column) -> Column:
        lead = F.length(F.regexp_extract(piece(text, s), r"(?U)^\s*", 0))
        return F.struct(s["entity_type"].alias("entity_type"), (s["start"] + lead).cast("int").alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["ord"].alias("ord"), s["tier"].alias("tier"))

    return F.transform(spans, trim)


def shift(spans: Column, by: Column) -> Column:
    """Spans of a window in positions of the whole text."""
    return F.transform(spans, lambda s: F.struct(s["entity_type"].alias("entity_type"), (s["start"] + by).cast("int").alias("start"), (s["end"] + by).cast("int").alias("end"), s["score"].alias("score"), s["ord"].alias("ord"), s["tier"].alias("tier")))


def candidates(text: Column, patterns: list[Rule] | None = None, labels: list[Rule] | None = None, digit: Column | None = None, fold: Column | None = None) -> Column:
    """All spans of patterns and labels.  digit, fold: columns with has_digit(text) and folded(text), if there are any."""
    return F.concat(pattern_scan(text, patterns, digit), keyword_scan(text, labels, fold=fold))


def detect(text: Column, patterns: list[Rule] | None = None, labels: list[Rule] | None = None) -> Column:
    """Disjoint spans of a text: patterns and labels, clipped at line breaks, resolved.  Null or blank text has none."""
    found = F.when(is_blank(text), no_spans()).otherwise(candidates(text, patterns, labels))
    return let(found, lambda s: F.when(F.size(s) == 0, s).otherwise(resolve(clip_at_newline(s, text))))


def detect_with_model(text: Column, model_spans: Column, patterns: list[Rule] | None = None, labels: list[Rule] | None = None) -> Column:
    """As detect, with the spans of a model pass for texts of up to FAST_PATH_CHARS.

    There, spans of patterns are clipped and persons lose trailing labels; labels' values are taken as they are.
    """
    rules = trim_trailing_labels(clip_at_newline(pattern_scan(text, patterns), text), text)
    full = resolve(F.concat(rules, keyword_scan(text, labels), clip_at_newline(F.coalesce(model_spans, no_spans()), text)))
    return F.when(is_blank(text), no_spans()).when(F.length(text) <= FAST_PATH_CHARS, full).otherwise(detect(text, patterns, labels))
