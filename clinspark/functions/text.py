"""String and date expressions over notes, names and labels."""

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F


def _col(column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def normalize_name(column) -> Column:
    """Task name as an identifier: separators become underscores, brackets and commas go."""
    return F.translate(F.lower(_col(column)), " -./,()", "____")


def normalized_name(name: str) -> str:
    """Driver-side twin of `normalize_name` for configuration values."""
    return name.lower().translate(str.maketrans({" ": "_", "-": "_", ".": "_", "/": "_", ",": None, "(": None, ")": None}))


@lru_cache
def _letter_maps() -> tuple[str, str, dict[str, str]]:
    """Accented Latin letters -> ASCII by compatibility decomposition; one-letter and longer results."""
    source, target, longer = [], [], {}
    for point in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)):
        letter = chr(point)
        plain = unicodedata.normalize("NFKD", letter).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(letter)
            target.append(plain)
        elif len(plain) > 1:
            longer[letter] = plain
    return "".join(source), "".join(target), longer


def accent_table() -> tuple[str, str]:
    """The two aligned strings of the one-to-one accent map."""
    return _letter_maps()[:2]


def norm_text(column) -> Column:
    """Lower case without accents, one output character per input character."""
    return F.lower(F.translate(_col(column), *accent_table()))


def fold_accents(column) -> Column:
    """Lower case ASCII: accents fold, ligatures split, any other non-ASCII letter is dropped."""
    folded = F.translate(_col(column), *accent_table())
    for letter, plain in _letter_maps()[2].items():
        folded = F.replace(folded, F.lit(letter), F.lit(plain))
    return F.lower(F.regexp_replace(folded, r"[^\x00-\x7F]", ""))


def first_part(column, separator: str = ";") -> Column:
    return F.element_at(F.split(_col(column), re.escape(separator)), 1)


def char_context(text, start, end, width: int) -> Column:
    """Characters from `width` before the span to `width` after it, cut at the text start."""
    start, end = _col(start), _col(end)
    begin = F.greatest(start - width, F.lit(0))
    return _col(text).substr((begin + 1).cast("int"), (end + width - begin).cast("int"))


def terms_regex(terms) -> str:
    """Regular expression that finds any of the literal terms as whole words."""
    body = "|".join(re.escape(t) for t in terms)
    return rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{body})(?:$|[^\p{{L}}\p{{N}}_])"


def any_regex(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def encode_labels(column, positive, negative, other=None) -> Column:
    """True/1/"1"/"true" -> positive, False/0/"0"/"false" -> negative, null -> `other`."""
    text = F.lower(_col(column).cast("string"))
    return (
        F.when(text.isin("true", "1"), F.lit(positive))
        .when(text.isin("false", "0"), F.lit(negative))
        .otherwise(F.lit(other))
    )


def nan_to_null(column) -> Column:
    column = _col(column)
    return F.when(~F.isnan(column), column)


# Month names (French without accents, English) and the month each one means.
MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6,
    "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}
_MONTH_WORD = "|".join(sorted(MONTHS, key=len, reverse=True))
# Date mentions in normalised text (lower case, no accents): y-m-d, d/m/y, d month y, month y, d/m. No letter or digit touches
# either end; word boundaries say so, which DuckDB's expressions know too.
DATE_REGEX = (
    r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{1,2}[/.-][0-9]{1,2}[/.-](?:[0-9]{4}|[0-9]{2})"
    rf"|(?:[0-9]{{1,2}}(?:er)? )?(?:{_MONTH_WORD}) [0-9]{{4}}"
    r"|[0-9]{1,2}/[0-9]{1,2})\b"
)


def resolve_date(mention, note_date, default_day: int = 15) -> Column:
    """Date of a mention; missing parts come from the note date and the default day, bad dates are null."""
    text, note_date = norm_text(mention), _col(note_date)

    def part(pattern, group):
        return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))

    iso = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})$"
    numeric = r"^([0-9]{1,2})[/.-]([0-9]{1,2})(?:[/.-]([0-9]{2,4}))?$"
    worded = rf"^(?:([0-9]{{1,2}})(?:er)? )?({_MONTH_WORD})(?: ([0-9]{{4}}))?$"
    months = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    day = F.coalesce(part(iso, 3), part(numeric, 1), part(worded, 1)).cast("int")
    month = F.coalesce(part(iso, 2).cast("int"), part(numeric, 2).cast("int"), months[part(worded, 2)])
    year = F.coalesce(part(iso, 1), part(numeric, 3), part(worded, 3)).cast("int")
    note_year = F.year(note_date)
    full_year = F.when(year >= 100, year).when(year + 2000 <= note_year, year + 2000).otherwise(year + 1900)
    day = F.coalesce(day, F.lit(default_day))

    def build(y):
        text_date = F.format_string("%04d-%02d-%02d", y, month, day)
        return F.when(y.isNotNull() & month.isNotNull(), F.try_to_date(text_date, "yyyy-MM-dd"))

    inferred = F.when(build(note_year) > note_date, build(note_year - 1)).otherwise(
        F.coalesce(build(note_year), build(note_year - 1))
    )
    return F.when(year.isNotNull(), build(full_year)).otherwise(inferred)
