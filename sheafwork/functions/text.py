"""Text functions as column expressions: folding, keys, dates in words, numerals, number labels."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a title keeps in lower case, acronyms that keep their case, months.
PARTICLES = ("de", "del", "la", "las", "el", "los", "y", "e", "en", "a", "por", "con")
ACRONYMS = ("DNI", "CUIT", "CUIL", "LE", "LC", "SA", "S.A.", "SRL", "S.R.L.", "MPF", "UFIL", "OGA", "PDF", "USB", "IMEI", "CBU", "IVA", "AFIP", "ARCA", "IAFAS", "Nº", "N°", "N.º")
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
OCR_FROM, OCR_TO = "0158", "OISB"


def _folds() -> tuple[str, str]:
    """Letters of the basic plane whose decomposition is one base letter with marks, and these base letters."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0xD800) if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folds()


def fold(text: Column) -> Column:
    """Text without accents: letters with marks become their base letter, other marks go."""
    return F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), r"\p{Mn}", "")


def normalise(text: Column) -> Column:
    """Folded, lower-cased, with anything but letters, digits and underscores as one space; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(fold(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}_]+", " "))


def name_key(name: Column) -> Column:
    """The normalised words of a name in alphabetical order."""
    return F.array_join(F.array_sort(F.split(normalise(name), " ")), " ")


def ocr_key(text: Column) -> Column:
    """Upper-case letters and digits only, with digits that OCR confuses read as letters."""
    return F.regexp_replace(F.translate(F.upper(fold(F.coalesce(text, F.lit("")))), OCR_FROM, OCR_TO), "[^A-Z0-9]+", "")


def title_case(text: Column) -> Column:
    """Normalised words with capitals, but for particles after the first word."""
    small = F.array(*map(F.lit, PARTICLES))
    return F.array_join(F.transform(F.split(normalise(text), " "), lambda w, i: F.when((i > 0) & F.array_contains(small, w), w).otherwise(F.initcap(w))), " ")


def slug(number: Column, title: Column) -> Column:
    """A key for a case from its file number and the first 40 characters of its title, lower-case letters and digits between single hyphens; 80 characters at most, `caso` where both are empty."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(F.lower(fold(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    both = F.concat_ws("-", F.nullif(clean(number), F.lit("")), F.nullif(F.left(clean(title), F.lit(40)), F.lit("")))
    return F.left(F.coalesce(F.nullif(both, F.lit("")), F.lit("caso")), F.lit(80))


def roman(number: Column) -> Column:
    """A whole number from 1 on as a Roman numeral, with an M for every thousand; others give an empty string."""
    digits = [F.repeat(F.lit("M"), F.floor(number / 1000).cast("int"))]
    for unit, (one, five, ten) in zip((100, 10, 1), (("C", "D", "M"), ("X", "L", "C"), ("I", "V", "X")), strict=True):
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        digits.append(F.element_at(F.array(*map(F.lit, forms)), (F.floor(number / unit) % 10 + 1).cast("int")))
    return F.when(number >= 1, F.concat(*digits)).otherwise("")


def date_words(iso: Column) -> Column:
    """`2024-03-12` as `12 de marzo de 2024`; empty for what is no such date."""
    parts = [F.get(F.split(iso, "-"), F.lit(n)).try_cast("int") for n in range(3)]
    month = F.get(F.array(*map(F.lit, MONTHS)), parts[1] - 1)
    return F.coalesce(F.concat(parts[2].cast("string"), F.lit(" de "), month, F.lit(" de "), parts[0].cast("string")), F.lit(""))


def find_date(text: Column) -> Column:
    """The first date of a text as ISO: day de month de year first, else day/month/year; only the first match of each counts, nothing is completed."""
    raw = F.coalesce(text, F.lit(""))
    months = {m: i + 1 for i, m in enumerate(MONTHS)} | {"setiembre": 9}
    names = "|".join(months)
    # fixed values: the two forms of a date
    words = rf"\b(\d{{1,2}})\s+de\s+({names})\s+de\s+(\d{{4}})\b"
    figures = r"\b(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})\b"
    number = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    part = lambda c, p, i: F.regexp_extract(c, p, i).try_cast("int")
    iso = lambda a, b, c: F.format_string("%04d-%02d-%02d", a, b, c)

    def named(found: Column) -> Column:
        d, m, y = part(found, words, 1), F.element_at(number, F.regexp_extract(found, words, 2)), part(found, words, 3)
        return F.when(d.between(1, 31) & y.between(1900, 2100), iso(y, m, d))

    def figured(found: Column) -> Column:
        d, m, short = (part(found, figures, i) for i in (1, 2, 3))
        y = F.when(short < 70, short + 2000).when(short < 100, short + 1900).otherwise(short)
        return F.when(d.between(1, 31) & m.between(1, 12) & y.between(1900, 2100), iso(y, m, d))

    # the match alone is taken apart, held by an array of one, so that a text is folded and searched once for each form
    match = lambda c, p, take: F.get(F.transform(F.array(F.regexp_extract(c, p, 0)), take), F.lit(0))
    # without a digit, which folding makes of no letter, there is no date
    return F.when(raw.rlike("[0-9]"), F.coalesce(match(F.lower(fold(raw)), words, named), match(raw, figures, figured)))


# Fixed value: a page number at the margin, with what may stand around it and after it.
LABEL = r"(?i)^[\-–—.·(\[]*(?:f?s?\.?º?°?\s*)?(\d{1,4})\s*(vta\.?|vlta\.?|bis)?[\-–—.·)\]]*$"


def page_label(token: Column) -> tuple[Column, Column]:
    """Number (1 to 9999, else null) and suffix (`vta`, `bis` or empty) that a token of the margin holds."""
    token = F.trim(F.coalesce(token, F.lit("")))
    number = F.regexp_extract(token, LABEL, 1).try_cast("int")
    number = F.when(number.between(1, 9999), number)
    suffix = F.lower(F.regexp_extract(token, LABEL, 2))
    return number, F.when(number.isNull(), F.lit(None).cast("string")).when(suffix.startswith("v"), "vta").when(suffix == "bis", "bis").otherwise("")


def label_text(number: Column, suffix: Column) -> Column:
    """`411`, `411 vta.` or `411 bis`; null without a number."""
    return F.concat(number.cast("string"), F.when(suffix == "vta", " vta.").when(suffix == "bis", " bis").otherwise(""))


def sentence_case(text: Column) -> Column:
    """A title in capitals as a sentence: acronyms and words with digits stay; what is not mostly capitals stays as it is."""
    text = F.trim(F.coalesce(text, F.lit("")))
    letters, upper = F.regexp_count(text, F.lit(r"\p{L}")), F.regexp_count(text, F.lit(r"\p{Lu}"))
    keep = F.array(*map(F.lit, ACRONYMS))
    words = F.transform(F.split(text, r"(?<=\s)(?=\S)|(?<=\S)(?=\s)"), lambda w: F.when(F.array_contains(keep, F.upper(w)) | w.rlike(r"\p{Nd}"), w).otherwise(F.lower(w)))
    out = F.regexp_replace(F.array_join(words, ""), r"^[ .:\-—·]+|[ .:\-—·]+$", "")
    out = F.when(out == "", text).otherwise(F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20)))
    return F.when((letters == 0) | (upper < letters * 0.7), text).otherwise(out)


def level(confidence: Column) -> Column:
    """Level of a confidence; a missing one means that a person made the piece."""
    return F.when(confidence.isNull(), "manual").when(confidence >= 0.75, "alta").when(confidence >= 0.55, "media").otherwise("baja")


def json_list(text: Column) -> Column:
    """A JSON array of strings; what is missing, no array or no JSON at all gives an empty one."""
    return F.coalesce(F.from_json(text, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
