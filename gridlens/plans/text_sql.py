"""SQL spellings of the text functions, for checking them against another engine."""

from __future__ import annotations

from gridlens.functions import lexicon as L


def quoted(items) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def folded(text: str) -> str:
    # The given texts hold composed letters only; sharp s is the one letter whose folding differs from lower case.
    return f"replace(lower({text}), 'ß', 'ss')"


def normalized(text: str) -> str:
    quoted_text = f"replace({folded(text)}, '’', '''')"
    unmarked = f"regexp_replace({quoted_text}, '\\b(?:option|choice|answer)\\s+[a-z]\\b', ' ', 'g')"
    return f"trim(regexp_replace({unmarked}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def raw_tokens(text: str) -> str:
    lexical = f"regexp_replace(translate({folded(text)}, '’‘', ''''''), '[‐‑–—-]', ' ', 'g')"
    found = f"regexp_extract_all({lexical}, {literal(L.TOKEN)})"
    bare = f"list_transform({found}, lambda t: CASE WHEN length(t) > 2 AND t LIKE '%''s' THEN t[:-3] ELSE t END)"
    return f"list_filter({bare}, lambda t: length(t) > 1)"


def canonical(token: str) -> str:
    irregular = " ".join(f"WHEN {token} = '{w}' THEN '{r}'" for w, r in L.IRREGULAR.items())
    return f"""CASE {irregular}
      WHEN length({token}) > 4 AND regexp_matches({token}, '[^aeiou]ies$') THEN {token}[:-4] || 'y'
      WHEN length({token}) > 4 AND regexp_matches({token}, '(xes|zes|ches|shes|sses)$') THEN {token}[:-3]
      WHEN length({token}) > 3 AND regexp_matches({token}, '[^sui]s$') THEN {token}[:-2] ELSE {token} END"""


def term_tokens(text: str) -> str:
    kept = f"list_filter({raw_tokens(text)}, lambda t: t NOT IN ({quoted(L.TERM_STOPWORDS)}))"
    return f"list_transform({kept}, lambda t: {canonical('t')})"


def content_tokens(text: str) -> str:
    return f"list_filter({raw_tokens(text)}, lambda t: t NOT IN ({quoted(L.ANCHOR_STOPWORDS)}))"


def fact_tokens(text: str) -> str:
    found = f"regexp_extract_all({text}, {literal(L.FACT_TOKEN)})"
    lowered = f"list_transform({found}, lambda t: lower(t))"
    return f"list_filter({lowered}, lambda t: length(t) > 1 AND t NOT IN ({quoted(L.FACT_STOPWORDS)}))"


def measurement_stem(text: str) -> str:
    return f"regexp_replace({text}, '^\\s*\\p{{Nd}}+\\s*[.)][\\s\\x{{200b}}]*', '')"
