"""Headings: rules as data, recognition, continuation marks, title lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, sentence_case

NEAR, FAR_FACTOR = 90, 0.6
UNKNOWN = "sin_clasificar"
OTHER_FAMILY = "otra"

# How a page says that it goes on from another, and how it counts its sheets.
COUNTER = r"\b(?:HOJA|PAG(?:INA)?\.?|CONTINUACION)\s*(\d{1,3})\s*(?:/|DE)\s*(\d{1,3})\b"
GOES_ON = (r"\(\s*CONTINUACION", r"\bCONTINUACION\s+\d+\s*(?:/|DE)\s*\d+", r"\bCONTINUA\s+(?:EN|AL)\b", r"\bVIENE\s+DE\s+(?:LA\s+VUELTA|FS)", r"\bSIGUE\s+AL\s+DORSO\b", r"\bHOJA\s+\d+\s+DE\s+\d+\b", r"\bPAG(?:INA)?\.?\s*\d+\s*(?:DE|/)\s*\d+\b")


@dataclass(frozen=True)
class Rule:
    """A type of piece: its key, label, family, weight, and patterns for folded upper-case headings, the strongest first."""

    key: str
    label: str
    family: str
    weight: float
    patterns: tuple[str, ...]


def heading(text: Column, lines: int = 6) -> Column:
    """The first lines of a text, folded and in upper case, joined by a space and a line feed."""
    first = F.substring_index(F.coalesce(text, F.lit("")), "\n", lines)
    return F.upper(fold(F.replace(first, F.lit("\n"), F.lit(" \n"))))


def needed(pattern: str) -> tuple[str, ...]:
    """Texts of which a match of the pattern holds one at least; none where that is not known. Of the parts that every match has, that with the longest text counts."""
    from re import _constants as kind
    from re import _parser as parser

    def of(tokens) -> tuple[str, ...]:
        found, run = [], ""
        for op, value in tokens:
            if op is kind.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append((run,))
            run = ""
            if op is kind.SUBPATTERN and not value[1] & parser.SRE_FLAG_IGNORECASE:
                found.append(of(value[3]))
            elif op is kind.BRANCH:
                each = [of(x) for x in value[1]]
                found.append(tuple(w for x in each for w in x) if all(each) else ())
            elif op in (kind.MAX_REPEAT, kind.MIN_REPEAT) and value[0] > 0:
                found.append(of(value[2]))
        if run:
            found.append((run,))
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=())

    tree = parser.parse(pattern)
    return () if tree.state.flags & parser.SRE_FLAG_IGNORECASE else of(tree)


def _there(head: Column, pattern: str) -> Column:
    """Whether a text that the pattern needs is there; true where it is not known to need one."""
    texts = needed(pattern)
    there = F.contains(head, F.lit(texts[0])) if texts else F.lit(True)
    for text in texts[1:]:
        there = there | F.contains(head, F.lit(text))
    return there


def _place(head: Column, pattern: str) -> Column:
    """Where a pattern first matches, 0 where it does not. It is only run where a text that it needs is there, so that of some hundred patterns few are."""
    return F.when(_there(head, pattern), F.regexp_instr(head, F.lit(f"(?m){pattern}"))).otherwise(0)


def recognise(head: Column, rules: list[Rule]) -> Column:
    """The rule that a heading (a column of its own, as every pattern reads it) matches best, as a struct (type, score).

    Of a rule the first listed pattern that matches counts, at its first match: the full weight if that
    starts within the first 90 characters, else 0.6 of it. The earliest of equally good rules wins.
    """
    starts = F.array(*[_place(head, p) for r in rules for p in r.patterns])

    def best(found: Column) -> Column:
        scored, i = [], 0
        for order, rule in enumerate(rules):
            at = F.coalesce(*[F.nullif(F.get(found, F.lit(i + k)), F.lit(0)) for k in range(len(rule.patterns))])
            score = F.when(at <= NEAR, rule.weight).when(at.isNotNull(), rule.weight * FAR_FACTOR)
            scored.append(F.when(score.isNotNull(), F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(rule.key).alias("type"))))
            i += len(rule.patterns)
        top = F.array_max(F.filter(F.array(*scored), lambda x: x.isNotNull()))
        return F.struct(F.coalesce(top["type"], F.lit(UNKNOWN)).alias("type"), F.coalesce(top["score"], F.lit(0.0)).alias("score"))

    # an array of one holds the places, so that every pattern is matched once
    return F.get(F.transform(F.array(starts), best), F.lit(0))


def continuation(head: Column) -> Column:
    """Whether a heading goes on from another page, as a struct (continues, n, m). A counter decides by itself: only from sheet 2 on."""
    n, m = (F.when(_there(head, COUNTER), F.regexp_extract(head, COUNTER, i)).try_cast("int") for i in (1, 2))
    goes_on = F.lit(False)
    for pattern in GOES_ON:
        goes_on = goes_on | (_there(head, pattern) & head.rlike(pattern))
    return F.struct(F.when(n.isNotNull(), n >= 2).otherwise(goes_on).alias("continues"), n.alias("n"), m.alias("m"))


def title_line(text: Column, kind: Column, rules: list[Rule], lines: int = 6) -> Column:
    """The line that made the rule match (else the first one) as a sentence; null if there is none."""
    rows = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines)
    line = F.lit(None).cast("string")
    matching = lambda p: lambda x: F.upper(fold(x)).rlike(p)
    for rule in rules:
        # the pattern is a literal, so it is compiled once; only the branch of the row's own type is run
        pattern = "(?m)" + "|".join(f"(?:{p})" for p in rule.patterns)
        line = F.when(kind == rule.key, F.get(F.filter(rows, matching(pattern)), F.lit(0))).otherwise(line)
    line = F.coalesce(line, F.get(rows, F.lit(0)))
    return F.nullif(sentence_case(line), F.lit(""))


def with_labels(pieces: DataFrame, rules: list[Rule], column: str = "type") -> DataFrame:
    """`label` and `family` of a type; an unknown one is its own label, of the family of others."""
    look = lambda values: F.create_map(*[F.lit(x) for pair in values for x in pair])
    return pieces.withColumns({
        "label": F.coalesce(F.element_at(look([(r.key, r.label) for r in rules]), F.col(column)), F.col(column)),
        "family": F.coalesce(F.element_at(look([(r.key, r.family) for r in rules]), F.col(column)), F.lit(OTHER_FAMILY)),
    })
