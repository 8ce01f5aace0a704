"""Pieces of SQL shared by the queries' equivalents."""

from __future__ import annotations

import re

from clausemill.functions import tables as T
from clausemill.functions.text import WS

LIVE = """live as (select * exclude (r) from (select *, row_number() over (partition by clause_id order by ingested_at desc) as r from clauses) where r = 1)"""


def TRIM(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def SQUASH(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{WS}+', ' ', 'g'), '^ | $', '', 'g')"


def NORM(x: str) -> str:
    return rf"(' ' || trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ')"


def family(normed: str, families) -> str:
    """The CASE that picks the first family with a keyword."""
    parts = []
    for label, words in families:
        hits = []
        for w in words:
            n = re.sub(r"[\W_]+", " ", w.lower()).strip()
            needle = f" {n}" if len(n.encode()) >= 6 else f" {n} "
            hits.append(f"contains({normed}, '{needle}')")
        parts.append(f"when {' or '.join(hits)} then '{label}'")
    return f"case {' '.join(parts)} end"


FAMILY = family
_SMALL = ", ".join(f"'{w}'" for w in T.SMALL_WORDS)


def TITLE(x: str) -> str:
    """A heading as a label."""
    s = SQUASH(rf"regexp_replace(regexp_replace({TRIM(x)}, '^[.:;]+|[.:;]+\z', '', 'g'), '^[0-9.()]+{WS}+', '')")
    piece = r"(regexp_extract(p, '^([^\p{L}]*)', 1) || upper(p[length(regexp_extract(p, '^([^\p{L}]*)', 1)) + 1]) || p[length(regexp_extract(p, '^([^\p{L}]*)', 1)) + 2:])"
    upper = rf"list_aggregate(list_transform(string_split(regexp_replace(lower(w), '([-/])', '\1' || chr(1), 'g'), chr(1)), lambda p: {piece}), 'string_agg', '')"
    return rf"list_aggregate(list_transform(string_split({s}, ' '), lambda w, i: case when i > 1 and lower(w) in ({_SMALL}) then lower(w) when not regexp_matches(w, '[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') then {upper} else w end), 'string_agg', ' ')"


LABEL = TITLE
