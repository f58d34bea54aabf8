"""The semantics of detection and rewriting in DuckDB's SQL, written apart from the Columns that Spark runs."""

from __future__ import annotations

from ..functions import rules
from .views import TEXTS


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def places(source: str, regex: str) -> str:
    """doc_id, text, hit, s: each match and where it starts."""
    r = quoted(regex)
    start = "list_transform(range(1, len(hits) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))"
    return f"SELECT doc_id, text, unnest(hits) AS hit, unnest({start}) AS s FROM (SELECT doc_id, text, regexp_extract_all(text, {r}) AS hits, regexp_split_to_array(text, {r}) AS gaps FROM {source}) WHERE len(hits) > 0"


def rule_spans(rule: rules.Rule, order: int, source: str = "texts") -> str:
    return f"SELECT doc_id, {order} AS ord, {quoted(rule.entity)} AS typ, s::BIGINT AS s, (s + length(hit))::BIGINT AS e, {rule.score}::DOUBLE AS score FROM ({places(source, rule.regex)})"


def label_spans(rule: rules.Rule, order: int, source: str = "texts") -> str:
    found = f"SELECT doc_id, s + length(hit) AS pos, split_part(substr(text, (s + length(hit) + 1)::BIGINT), chr(10), 1) AS line FROM ({places(source, '(?i)' + rule.regex)})"
    cut = f"SELECT doc_id, pos, regexp_split_to_array(line, {quoted('(?i)' + rules.NEXT_LABEL)})[1] AS seg FROM ({found})"
    if rule.entity == "PERSON":
        value = f"SELECT doc_id, pos + length(regexp_extract(seg, '^\\s*')) AS s, regexp_extract(seg, {quoted(f'^\\s*({rules.PERSON_VALUE})')}, 1) AS v FROM ({cut})"
        keep = "v <> ''"
    else:
        value = f"SELECT doc_id, pos AS s, regexp_replace(seg, '\\s+$', '') AS v FROM ({cut})"
        keep = "length(regexp_replace(v, '^\\s+', '')) > 1"
    return f"SELECT doc_id, {order} AS ord, {quoted(rule.entity)} AS typ, s::BIGINT AS s, (s + length(v))::BIGINT AS e, {rule.score}::DOUBLE AS score FROM ({value}) WHERE {keep}"


def tier(column: str = "typ") -> str:
    cases = " ".join(f"WHEN {column} IN ({', '.join(map(quoted, names))}) THEN {t}" for t, names in rules.TIERS.items())
    return f"CASE {cases} ELSE 1 END"


def folded(source: str) -> str:
    """doc_id, typ, s, e, score of the spans that the fold keeps; source: doc_id, ord, typ, s, e, score."""
    rows = f"SELECT doc_id, list_sort(list({{'s': s, 'n': s - e, 'm': -score, 'ord': ord, 'e': e, 'score': score, 'typ': typ, 't': {tier()}}})) AS l FROM {source} GROUP BY doc_id"
    last = "m[len(m)]"
    wins = f"(r[1].e - r[1].s > {last}.e - {last}.s OR (r[1].e - r[1].s = {last}.e - {last}.s AND (r[1].t > {last}.t OR (r[1].t = {last}.t AND r[1].score > {last}.score))))"
    fold = f"list_reduce(list_transform(l, lambda x: [x]), lambda m, r: CASE WHEN r[1].s >= {last}.e THEN list_concat(m, r) WHEN {wins} THEN list_concat(m[1:len(m) - 1], r) ELSE m END)"
    return f"SELECT doc_id, x.typ AS typ, x.s AS s, x.e AS e, x.score AS score FROM (SELECT doc_id, unnest({fold}) AS x FROM ({rows}))"


def clipped(source: str, texts: str = "texts") -> str:
    """Spans up to their first line break."""
    head = f"SELECT f.*, split_part(substr(text, s + 1, e - s), chr(10), 1) AS head FROM {source} f JOIN {texts} USING (doc_id)"
    return f"SELECT doc_id, ord, typ, s, s + length(head) AS e, score FROM ({head}) WHERE length(head) = e - s OR regexp_matches(head, '\\S')"


def all_rules(source: str = "texts") -> str:
    parts = [rule_spans(r, k, source) for k, r in enumerate(rules.PATTERN_RULES)]
    parts += [label_spans(r, 100 + k, source) for k, r in enumerate(rules.keyword_rules())]
    return " UNION ALL ".join(parts)


def detected(texts: str = TEXTS) -> str:
    """WITH clauses: texts and spans (doc_id, typ, s, e, score)."""
    return f"WITH texts AS ({texts}), cand AS ({all_rules()}), clip AS ({clipped('cand')}), spans AS ({folded('clip')})"


def mask(o: str, t: str) -> str:
    """The mask of a value o of type t."""
    d = f"regexp_replace({o}, '\\D', '', 'g')"
    plain = f"CASE WHEN length({o}) > 1 THEN {o}[1] || repeat('*', length({o}) - 1) ELSE '[REDACTED]' END"
    at = f"strpos({o}, '@')"
    cut = f"{o}[1] || repeat('*', {at} - 2) || substr({o}, {at})"
    return f"""CASE WHEN {t} = 'EMAIL_ADDRESS' AND {at} > 1 AND len(string_split({o}, '@')) = 2 THEN {cut}
      WHEN {t} IN ('IN_PHONE', 'PHONE_NUMBER') AND length({d}) >= 4 THEN left({d}, 2) || repeat('*', length({d}) - 4) || right({d}, 2)
      WHEN {t} = 'IN_AADHAAR' THEN CASE WHEN length({d}) >= 4 THEN 'XXXX XXXX ' || right({d}, 4) ELSE 'XXXX XXXX XXXX' END
      WHEN {t} = 'IN_PAN' AND length({o}) >= 6 THEN {o}[1] || '****' || substr({o}, 6)
      WHEN {t} IN ('PERSON', 'NAME') THEN {o}[1] || repeat('*', length({o}) - 1)
      WHEN {t} = 'IP_ADDRESS' THEN split_part({o}, '.', 1) || '.***.***.***'
      WHEN {t} = 'DATE_OF_BIRTH' THEN '** **** 19**'
      WHEN {t} = 'BANK_ACCOUNT' AND length({o}) >= 4 THEN repeat('*', length({o}) - 4) || right({o}, 4)
      WHEN {t} = 'CREDIT_CARD' AND length({d}) >= 4 THEN repeat('*', length({d}) - 4) || right({d}, 4)
      WHEN {t} = 'UPI_ID' AND {at} > 1 THEN {cut}
      WHEN {t} IN ('DEVICE_ID', 'HASH_VALUE', 'IFSC_CODE', 'BANK_NAME', 'LOCATION') THEN '[REDACTED]'
      ELSE {plain} END"""


def rewritten(replacement: str, texts: str = TEXTS, head: str | None = None) -> str:
    """doc_id, clean, n_spans of every text; replacement: an expression over orig, typ and doc_id."""
    return f"""{head or detected(texts)},
    p AS (SELECT doc_id, typ, s, e, text, substr(text, s + 1, e - s) AS orig, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans JOIN texts USING (doc_id)),
    r AS (SELECT doc_id, string_agg(substr(text, before + 1, s - before) || {replacement}, '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS clean, count(*) AS n FROM p GROUP BY doc_id)
    SELECT doc_id, coalesce(clean, text) AS clean, coalesce(n, 0)::BIGINT AS n_spans FROM texts LEFT JOIN r USING (doc_id)"""


def token(t: str, key: str, salt: str) -> str:
    d = f"sha256(concat_ws(chr(31), {t}, {key}, {quoted(salt)}))"
    return f"'<' || concat_ws('-', substr({d}, 1, 8), substr({d}, 9, 4), substr({d}, 13, 4), substr({d}, 17, 4), substr({d}, 21, 12)) || '>'"
