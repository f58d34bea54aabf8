"""For SQL users: a table function `detect_spans(text)`."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import rules

#: Rules without groups that begin with a word boundary: the class of their first character, what has to follow it, names.  A rule that is not here is looked for in the whole text.
_FIRST = [
    (r"[\d+]", "", ("in_phone", "in_aadhaar", "ipv4", "bank_acct", "credit_card", "imei", "dob_dmy", "dob_iso")),
    ("[A-Z]", "[A-Z]{0,4}[0-9]", ("in_pan", "in_passport", "ifsc")),
    ("[A-F0-9]", "[A-F0-9]{7}-", ("ios_id",)),
    ("[af]", "n|p_|a", ("android_id", "fp_hash", "face_tmp")),
    ("[a-f0-9]", "[a-f0-9]{31}", ("sha256", "md5")),
]
#: Rules whose matches have an @ and no blank, so stand on a line that has one.
_ON_LINES = ("upi", "email")
#: Characters that match an ASCII letter in any case, besides those that lower() gives; each stays one character.
_FOLD = str.maketrans("İıſK", "iisk")


class Scan:
    """The catalogue's rules, compiled once for many texts.

    Python's `re` tries a pattern at every character unless it begins with a class or, case-sensitive, with a literal.  So patterns are tried together
    where a class and a word boundary are, and labels run case-sensitive on the text in lower case.
    """

    def __init__(self) -> None:
        order = {r.name: k for k, r in enumerate(rules.PATTERN_RULES)}
        self.starts = []
        for first, then, names in _FIRST:
            tried = "".join(rf"(?=({rules.PATTERN_RULES[order[n]].regex})?)" for n in names)
            self.starts.append((re.compile(rf"{first}(?<=\b{first})(?={then})"), re.compile(tried), [order[n] for n in names]))
        alone = [(k, re.compile(r.regex), r.name) for k, r in enumerate(rules.PATTERN_RULES) if not any(r.name in names for _, _, names in _FIRST)]
        self.lines = [(k, regex) for k, regex, name in alone if name in _ON_LINES]
        self.rest = [(k, regex) for k, regex, name in alone if name not in _ON_LINES]
        self.labels = [(r, re.compile(r.regex)) for r in rules.keyword_rules()]
        self.next_label = re.compile(rules.NEXT_LABEL)
        self.person = re.compile(rf"\s*({rules.PERSON_VALUE})")

    def patterns(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number of the rule, start, end) of all matches; those of one rule are left to right and disjoint, as finditer has them."""
        for starts, tried, numbers in self.starts:
            ends = [0] * len(numbers)
            for at in starts.finditer(text):
                m = tried.match(text, at.start())
                if m.lastindex:
                    for j, k in enumerate(numbers):
                        start, end = m.span(j + 1)
                        if start >= ends[j] and end > 0:
                            ends[j] = end
                            yield k, start, end
        at = text.find("@")
        while at >= 0:
            begin, stop = text.rfind("\n", 0, at) + 1, text.find("\n", at)
            stop = stop if stop >= 0 else len(text)
            for k, regex in self.lines:
                for m in regex.finditer(text, begin, stop):
                    yield k, *m.span()
            at = text.find("@", stop)
        for k, regex in self.rest:
            for m in regex.finditer(text):
                yield k, *m.span()

    def values(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(number of the label, start, end) of the values behind labels."""
        low = text.translate(_FOLD).lower()
        for k, (rule, regex) in enumerate(self.labels):
            if rule.needs and not any(n in low for n in rule.needs):
                continue
            for m in regex.finditer(low):
                begin = m.end()
                stop = text.find("\n", begin)
                stop = stop if stop >= 0 else len(text)
                if label := self.next_label.search(low, begin, stop):
                    stop = label.start()
                if rule.entity == "PERSON":
                    if person := self.person.match(text, begin, stop):
                        yield k, *person.span(1)
                elif len((segment := text[begin:stop]).strip()) > 1:
                    yield k, begin, begin + len(segment.rstrip())


def plain_spans(text: str | None, scan: Scan | None = None) -> list[tuple[str, int, int, float]]:
    """Disjoint spans (entity_type, start, end, score) of one text, as `spans.detect` has them.  scan: kept by callers with many texts."""
    if not text or not text.strip():
        return []
    found: list[tuple[int, int, float, int, str]] = []  # (start, end, score, order, entity)
    scan, first = scan or Scan(), len(rules.PATTERN_RULES)

    def add(rule: rules.Rule, order: int, start: int, end: int) -> None:
        line = text.find("\n", start, end)
        end = line if line >= 0 else end
        if line < 0 or text[start:end].strip():
            found.append((start, end, rule.score, order, rule.entity))

    for k, start, end in scan.patterns(text):
        add(rules.PATTERN_RULES[k], k, start, end)
    for k, start, end in scan.values(text):
        add(scan.labels[k][0], first + k, start, end)
    kept: list[tuple[int, int, float, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], s[0] - s[1], -s[2], s[3])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
            continue
        rank = [(x[1] - x[0], rules.TIER_OF.get(x[4], 1), x[2]) for x in (s, kept[-1])]
        if rank[0] > rank[1]:
            kept[-1] = s
    return [(e, a, b, score) for a, b, score, _, e in kept]


class _DetectSpans:
    def __init__(self) -> None:
        self.scan = Scan()  # one a task

    def eval(self, text: str) -> Iterator[tuple[str, int, int, float]]:
        yield from plain_spans(text, self.scan)


def register(spark: SparkSession) -> None:
    """`SELECT ... FROM t, LATERAL detect_spans(t.text)`."""
    spark.udtf.register("detect_spans", udtf(_DetectSpans, returnType="entity_type string, start int, end int, score double"))
