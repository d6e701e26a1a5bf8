"""Recovery of the eight protocol roles from free-form responses.

Headings and tags are marked in the text by regular expressions.  Choosing which marks form the response's ordered
trajectory is a small dynamic programme over a handful of marks per response; it is the one step done by a vectorised
helper.  Section text, options, decisions and all role criteria are column expressions again.  Responses never leave
their row, so recovering sections needs no shuffle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.functions import fragments
from gridlens.functions import text as X
from gridlens.functions.roles import (
    GUIDANCE, NUMBERED_CHANGE_HEADING, OPTION_ATTRIBUTE, ROLES, START_TAG, heading, option_in, decision_in, labels_of,
)

_OPEN, _NAME, _CLOSE = "\x01", "\x02", "\x03"
_ROLE_COUNT = len(ROLES)


def _marked(document: Column) -> Column:
    """Document with every role marker wrapped as OPEN role NAME marker CLOSE.

    The three control characters have no meaning in a response and become spaces, so they can serve as marks.
    """
    document = F.translate(document, f"{_OPEN}{_NAME}{_CLOSE}", "   ")
    result = F.regexp_replace(document, START_TAG, f"{_OPEN}$1{_NAME}$0{_CLOSE}")
    result = F.regexp_replace(result, rf"(?i)</\s*({'|'.join(ROLES)})\b[^<>]*>", f"{_OPEN}$1{_NAME}$0{_CLOSE}")
    for role in ROLES:
        result = F.regexp_replace(result, heading(role), f"{_OPEN}{role}{_NAME}$0{_CLOSE}")
    return F.regexp_replace(result, NUMBERED_CHANGE_HEADING, f"{_OPEN}answer_changing_change{_NAME}$0{_CLOSE}")


_LAYOUT = T.StructType([
    T.StructField("role_counts", T.ArrayType(T.IntegerType())),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("markers", T.ArrayType(T.StringType())),
    T.StructField("bodies", T.ArrayType(T.StringType())),
])
_NUMBERED = re.compile(r"\b(?:step[ \t]*)?\d+[.:)\-]", re.IGNORECASE)
_ANSWER_FIELD = re.compile("|".join(f"(?:{rule})" for rule in (
    r"\b(?:option|choice)\s*[\"'(]*[A-Z]\b", r"\boption\s*=\s*['\"]", r"^\s*(?:[-+*]\s+)?(?:\*\*|__|`)?\s*[A-Z]\s*[.):\-]",
    r"\banswer\s*(?:is|=|:)\s*[\"'(]*[A-Z]\b", r"\\boxed")), re.IGNORECASE | re.MULTILINE)
_DECISION_FIELD = re.compile(r"\b(?:retain|revis|keep|maintain|switch|chang|unchanged|stands)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>]*>")


def _strength(marker: str, body: str) -> int:
    """How much a marker looks like a boundary: tags, then numbers, emphasis alone, a line of its own, the rest."""
    if marker.startswith("</"):
        return 0
    alone = not body.split("\n", 1)[0].strip()
    if marker.lstrip().startswith("<"):
        return 6
    if "#" in marker or _NUMBERED.search(marker):
        return 5
    if alone:
        return 4 if "**" in marker or "__" in marker else 3
    return 1


def _boundary_score(role: int, strength: int, body: str, start: int, size: int) -> float:
    """Boundary strength, owned content and a recoverable answer field of one mark."""
    words = len(_WORD.findall(_TAG.sub(" ", body)))
    field = {2: _ANSWER_FIELD, 3: _ANSWER_FIELD, 7: _ANSWER_FIELD, 6: _DECISION_FIELD}.get(role)
    recoverable = field is not None and field.search(body) is not None
    return 10.0 * strength + min(30.0, words) + 8.0 * (words >= 3) + 12.0 * recoverable + 0.001 * start / max(1, size)


def _ascending(marks, size: int):
    """Best ascending sequence with one mark per role, or None; marks come in document order."""
    best: list = [(0.0, ())] + [None] * len(ROLES)
    for place, (role, strength, _, body, start) in enumerate(marks):
        if best[role] is None:
            continue
        score = best[role][0] + _boundary_score(role, strength, body, start, size)
        if best[role + 1] is None or score > best[role + 1][0]:
            best[role + 1] = (score, (*best[role][1], place))
    return best[-1][1] if best[-1] else None


def _layout(marked: str):
    """Role counts and, per role, the start, marker and text of the chosen mark."""
    head, *parts = marked.split(_OPEN)
    found, start = [], len(head)
    for part in parts:
        name, _, rest = part.partition(_NAME)
        marker, _, body = rest.partition(_CLOSE)
        found.append((ROLES.index(name.lower()), _strength(marker, body), marker, body, start))
        start += len(marker) + len(body)
    top, seen, marks = {}, set(), []
    for role, strength, *_ in found:
        top[role] = max(top.get(role, 0), strength)
    for role, strength, marker, body, place in found:
        # Weaker marks belong to the text before them; a closing tag only stands in for a missing marker, once.
        if strength == top[role] and (strength > 0 or role not in seen):
            seen.add(role)
            marks.append([role, strength, marker, body, place])
        elif marks:
            marks[-1][3] += marker + body
    counts = [sum(m[0] == role for m in marks) for role in range(len(ROLES))]
    chosen = _ascending(marks, start) if all(counts) else None
    if chosen is None:
        chosen = [next((i for i, m in enumerate(marks) if m[0] == role), None) for role in range(len(ROLES))]
    starts, markers, bodies = [], [], []
    for role, place in enumerate(chosen):
        if place is None:
            starts.append(None), markers.append(None), bodies.append("")
            continue
        end = min((p for p in chosen if p is not None and p > place), default=len(marks))
        after = chosen[role + 1] if role + 1 < len(ROLES) else None
        if after is not None and after > place:
            # An equally strong duplicate of the next role ends this one: it opens an abandoned scaffold.
            end = min([end, *(i for i in range(place + 1, after)
                              if marks[i][0] == role + 1 and marks[i][1] >= marks[after][1])])
        starts.append(marks[place][4]), markers.append(marks[place][2])
        bodies.append(marks[place][3] + "".join(m[2] + m[3] for m in marks[place + 1:end]))
    return counts, starts, markers, bodies


@F.pandas_udf(_LAYOUT)
def _laid_out(marked: pd.Series) -> pd.DataFrame:
    rows = [_layout(text or "") for text in marked]
    return pd.DataFrame(rows, columns=["role_counts", "starts", "markers", "bodies"])


_laid_out = _laid_out.asNondeterministic()


def normalized_choices(choices: Column) -> Column:
    """Normalised choice texts; all texts of a question are folded in one go, since folding may need Python.

    Another choice's label in brackets at the end of a text is a trace of an export and goes.
    """
    def own(c: Column) -> Column:
        last = F.regexp_extract(c["text"], r"\(([A-Z])\)\s*$", 1)
        return F.when((last != "") & (last != c["label"]), F.regexp_replace(c["text"], r"\s*\([A-Z]\)\s*$", "")).otherwise(c["text"])

    joined = F.array_join(F.transform(choices, lambda c: F.regexp_replace(own(c), r"\s+", " ")), "\n")
    folded = F.split(F.regexp_replace(X.folded(joined), "’", "'"), "\n")
    return F.transform(folded, lambda t: F.trim(F.regexp_replace(F.regexp_replace(
        t, r"(?U)\b(?:option|choice|answer)\s+[a-z]\b", " "), r"[^\p{L}\p{N}]+", " ")))


def recover(responses: DataFrame, *, content: str = "content", choices: str = "choices") -> DataFrame:
    """Add the recovered roles of every response.

    New columns: document, labels, choice_texts, sections (map of visible text by role), role_counts, ordered,
    preanswer_ordered, provisional_start, the options of the answer roles, and the decision.
    """
    prepared = responses.select(
        "*", X.outer_fence_removed(F.col(content)).alias("document"), labels_of(F.col(choices)).alias("labels"),
        normalized_choices(F.col(choices)).alias("choice_texts"))
    prepared = prepared.select("*", fragments.profiles(F.col("labels"), F.col("choice_texts")).alias("_profiles"))
    placed = prepared.select("*", _laid_out(_marked(F.col("document"))).alias("layout"))
    plain = placed.select("*", *[X.plain_text(F.col("layout.bodies")[k]).alias(f"_plain{k}") for k in range(_ROLE_COUNT)])
    plain = plain.select("*", *[X.guidance_removed(F.col(f"_plain{k}"), F.lit(GUIDANCE[r])).alias(f"_text{k}")
                                for k, r in enumerate(ROLES)])
    folded = plain.select("*", *[X.normalized(F.col(f"_text{ROLES.index(r)}")).alias(f"_norm_{r}")
                                 for r in ("provisional_answer", "second_best", "final_answer")])

    def option(role: str) -> Column:
        k = ROLES.index(role)
        attribute = F.upper(F.regexp_extract(F.col("layout.markers")[k], OPTION_ATTRIBUTE, 1))
        read = option_in(F.ltrim(F.col("layout.bodies")[k]), F.col(f"_norm_{role}"), F.col("labels"), F.col("choice_texts"),
                         F.col("_profiles"))
        return F.coalesce(F.when(F.array_contains("labels", attribute), attribute), read)

    def ascending(n: int) -> Column:
        starts = F.slice("layout.starts", 1, n)
        known = F.filter(starts, lambda p: p.isNotNull())
        return (F.size(known) == n) & (known == F.array_sort(known))

    attribute = F.lower(F.regexp_extract(F.col("layout.markers")[6], r"(?i)\bdecision\s*=\s*['\"]\s*(retain|revise)\s*['\"]", 1))
    result = folded.select(
        *responses.columns, "document", "labels", "choice_texts", "layout.role_counts",
        F.map_from_arrays(X.words(ROLES), F.array(*[F.col(f"_text{k}") for k in range(_ROLE_COUNT)])).alias("sections"),
        ascending(_ROLE_COUNT).alias("ordered"), ascending(3).alias("preanswer_ordered"),
        F.col("layout.starts")[2].alias("provisional_start"),
        option("provisional_answer").alias("provisional_option"),
        option("second_best").alias("second_best_option"),
        option("final_answer").alias("recovered_final_option"),
        F.coalesce(F.when(attribute != "", attribute), decision_in(F.col("_text6"))).alias("decision"),
    )
    return result
