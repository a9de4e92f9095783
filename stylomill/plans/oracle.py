"""Pieces of DuckDB SQL that the oracles are made of; they restate the rules on their own."""

from __future__ import annotations

from ..functions import constants as C
from ..operators import structure as structure_rules


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def values(rows) -> str:
    def one(x) -> str:
        return "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x)

    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def normal(text: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(coalesce({text}, ''), '<[^>]+>', ' ', 'g')), '[^\\p{{L}}\\p{{M}}]+', ' ', 'g'))"


def content(name: str, columns: str, source: str, text: str = "text") -> str:
    """A CTE `name` with columns and t, the content tokens of a text."""
    spelled = "CASE x " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in C.ARCHAIC_SPELLINGS.items()) + " ELSE x END"
    return f"""{name}_a AS (SELECT {columns}, list_filter(list_transform(string_split({normal(text)}, ' '), lambda x: {spelled}), lambda x: length(x) >= {C.MIN_WORD_CHARS} AND NOT list_contains({listed(C.dropped())}, x)) AS l FROM {source}),
{name} AS (SELECT {columns}, list_filter(l, lambda x, i: NOT (i > 3 AND coalesce(l[i-1] = x AND l[i-2] = x AND l[i-3] = x, false))) AS t FROM {name}_a)"""


def grams(name: str, columns: str, source: str) -> str:
    """A CTE `name` with columns, n, ngram and a row for each bigram and trigram of source's t."""
    return f"""{name} AS (
SELECT {columns}, 2 AS n, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i+1])) AS ngram FROM {source}
UNION ALL
SELECT {columns}, 3 AS n, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i+1] || ' ' || t[i+2])) AS ngram FROM {source})"""


def repeats(tokens: str) -> str:
    """How often the most frequent entry of a list occurs."""
    return f"coalesce(list_max(map_values(histogram_of({tokens}))), 0)"


def occurrences(text: str, phrase: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {phrase}, ''))) // length({phrase}) AS BIGINT)"


def escaped(text: str) -> str:
    """A text escaped for HTML."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {quoted(plain)}, {quoted(coded)})"
    return text


def rounded(top: str, bottom: str, digits: int) -> str:
    """A quotient of whole numbers with so many decimals; halves go to the even digit."""
    a, b = f"(CAST({top} AS HUGEINT) * {10**digits})", f"CAST({bottom} AS HUGEINT)"
    whole, rest = f"({a} // {b})", f"(2 * ({a} % {b}))"
    return f"(CAST({whole} + CASE WHEN {rest} > {b} OR ({rest} = {b} AND {whole} % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / {10**digits})"


#: Decimals of a median's values to the SQL of the median with two, halves to the even digit.
def median(value: str, digits: int) -> str:
    units = f"median(CAST(round({value} * {10**digits}) AS BIGINT))"
    return f"(round_even({units} / {10 ** (digits - 2)}, 0) / 100)" if digits > 2 else f"(round_even({units} * {10 ** (2 - digits)}, 0) / 100)"


def structure(name: str, key: str, source: str) -> str:
    """CTEs that end in `name`: a row for each key with the counters of source(key, text), by the annotation of rules; null
    where no sentence counts."""
    aux = listed(structure_rules.AUXILIARIES)
    infinitive = listed(["haben", "werden", "können", "müssen", "sollen", "wollen", "dürfen"])
    passive = " OR ".join(f"starts_with(low, {quoted(p)})" for p in C.PASSIVE_PREFIXES)
    return rf"""{name}_s AS (SELECT {key}, unnest(l) AS s, unnest(range(len(l))) AS sid FROM (SELECT {key}, string_split(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS l FROM {source})),
{name}_w AS (SELECT {key}, sid, regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]') AS l FROM {name}_s WHERE regexp_matches(s, '\p{{L}}')),
{name}_t AS (SELECT {key}, sid, len(l) AS n, unnest(l) AS w, unnest(range(len(l))) AS i FROM {name}_w),
{name}_p AS (SELECT *, lower(w) AS low, NOT regexp_matches(w, '[\p{{L}}\p{{N}}]') AS punct FROM {name}_t),
{name}_q AS (SELECT *, CASE WHEN punct THEN 'PUNCT' WHEN list_contains({aux}, low) THEN 'AUX' WHEN i > 0 AND regexp_matches(w, '^\p{{Lu}}\p{{Ll}}+') THEN 'NOUN' WHEN regexp_matches(low, '^\p{{L}}{{2,}}(te|ten|st|en|t)$') THEN 'VERB' ELSE 'X' END AS pos, regexp_matches(low, '^ge\p{{L}}{{2,}}(t|en)$') OR low IN ('worden', 'gewesen') AS part FROM {name}_p),
{name}_r AS (SELECT *, CASE WHEN pos NOT IN ('AUX', 'VERB', 'NOUN') THEN NULL WHEN part THEN 'Part' WHEN pos = 'AUX' AND NOT list_contains({infinitive}, low) THEN 'Fin' WHEN pos = 'VERB' AND regexp_matches(low, '(te|st|t)$') THEN 'Fin' END AS form, coalesce(min(i) FILTER (pos IN ('VERB', 'AUX')) OVER (PARTITION BY {key}, sid), 0) AS root FROM {name}_q),
{name}_h AS (SELECT *, CASE WHEN pos IN ('NOUN', 'VERB', 'AUX') OR i = root THEN i END AS held FROM {name}_r),
{name}_n AS (SELECT *, min(held) OVER (PARTITION BY {key}, sid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {name}_h),
{name}_d AS (SELECT *, least(101, CASE WHEN i = root THEN 0 WHEN held IS NOT NULL THEN 1 WHEN nxt IS NULL THEN n - i ELSE nxt - i + CASE WHEN nxt = root THEN 0 ELSE 1 END END) AS depth FROM {name}_n WHERE NOT punct),
{name}_e AS (SELECT {key}, sid, count(*) AS tokens, count_if(pos = 'NOUN') AS noun, count_if(pos IN ('VERB', 'AUX')) AS verb, count_if(pos = 'NOUN' AND regexp_matches(w, '(?i)({'|'.join(C.NOMINAL_SUFFIXES)})$')) AS nominal, count_if(pos IN ('VERB', 'AUX') AND form = 'Fin') AS finite, sum(depth) AS depths, bool_or(pos = 'AUX' AND ({passive})) AND bool_or(coalesce(form = 'Part', false)) AS passive FROM {name}_d GROUP BY {key}, sid HAVING count(*) >= {C.MIN_SENTENCE_TOKENS}),
{name} AS (SELECT {key}, count(*) AS n_sentences, sum(tokens) AS n_tokens, sum(noun) AS n_noun, sum(verb) AS n_verb, sum(nominal) AS n_nominal, sum(finite) AS n_finite, sum(depths) AS depth_sum, sum(tokens) AS depth_n, count_if(passive) AS n_passive FROM {name}_e GROUP BY {key})"""


COUNTERS = ("n_sentences", "n_tokens", "n_noun", "n_verb", "n_nominal", "n_finite", "depth_sum", "depth_n", "n_passive")


def ratios() -> str:
    """The published metrics of the counters in scope."""
    d = C.DECIMALS
    return ", ".join(
        f"{rounded(top, bottom, d[name])} AS {name}"
        for name, top, bottom in (
            ("nominalization_per_100", "100 * n_nominal", "n_tokens"), ("noun_verb_ratio", "n_noun", "greatest(n_verb, 1)"), ("mean_sentence_len", "n_tokens", "n_sentences"),
            ("clauses_per_sentence", "n_finite", "n_sentences"), ("mean_parse_depth", "depth_sum", "depth_n"), ("passive_ratio", "n_passive", "n_sentences"),
        )
    )


def score() -> str:
    """The slop score of the metrics in scope."""
    ref = dict(zip(C.STRUCTURAL_COLUMNS, next(r for r in C.STRUCTURAL_REFERENCE if r[0] == C.LIVELY), strict=True))
    parts = " + ".join(f"({k} - CAST({ref[k]} AS DOUBLE)) / CAST({ref[k]} AS DOUBLE)" for k in C.SCORED_METRICS)
    return f"round_even(100 * (CAST(0 AS DOUBLE) + {parts}) / {len(C.SCORED_METRICS)}, 1)"
