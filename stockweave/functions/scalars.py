"""Row-level text and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockweave.functions.weeks import as_col

EPS = 1e-9

# Colour names recognised in product descriptions.
COLORS = [
    "BLACK", "WHITE", "BLUE", "BEIGE", "GREEN", "RED", "YELLOW", "GOLD", "SILVER",
    "GRAY", "GREY", "PINK", "PURPLE", "VIOLET", "CREAM", "ORANGE", "BROWN", "NAVY",
    "LIGHT BLUE", "DARK BLUE", "LIGHT GREEN", "PHANTOM", "LAVENDER", "GRAPHITE",
    "TITANIUM", "MYSTIC", "AWESOME",
]
# Country and region codes recognised as last token.
COUNTRY_CODES = [
    "LTC", "CO", "COO", "BR", "PE", "AR", "CL", "MX", "EC", "VE", "BOL",
    "PAN", "GTM", "CRI", "HND", "SLV", "NIC", "DOM", "PRI", "USA", "R410A",
]
# Texts that mean "no value" in the source files.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def r6(c) -> Column:
    """Round to 6 places and drop the sign of zero."""
    return F.round(as_col(c), 6) + F.lit(0.0)


def null_tokens(c) -> Column:
    c = as_col(c)
    return F.when(~c.isin(NULL_TOKENS), c)


def number_text(c, strict: bool = True) -> Column:
    """``" 1,234 "`` to 1234.0; null and blank to 0.

    Other text fails the job when ``strict`` and becomes 0 otherwise.
    """
    t = F.regexp_replace(F.trim(as_col(c)), ",", "")
    t = F.when(t.isin("", "nan", "None"), F.lit("0")).otherwise(t)
    num = t.cast("double") if strict else t.try_cast("double")
    return F.coalesce(num, F.lit(0.0))


def non_negative(c) -> Column:
    return F.greatest(F.coalesce(as_col(c), F.lit(0.0)), F.lit(0.0))


_COLOR_TOKEN = r"(?i),\s*(" + "|".join(COLORS) + r")\s*(?=,|$)"


def material_parts(c) -> dict[str, Column]:
    """Category, model, colour and country of a comma-joined description.

    The colour is the first known colour from the third token on, the country
    the last token if it is a known code or two or three letters. Plain string
    functions only, so the parse stays in generated code.
    """
    c = F.coalesce(as_col(c), F.lit(""))
    c = F.when(F.trim(c) == "", "").otherwise(c)
    rest = F.substring(c, F.length(F.substring_index(c, ",", 2)) + 1, F.length(c))
    last = F.trim(F.substring_index(c, ",", -1))
    is_code = F.upper(last).isin(COUNTRY_CODES) | last.rlike(r"^\p{L}{2,3}$")
    return {
        "product_category": F.trim(F.substring_index(c, ",", 1)),
        "product_model": F.trim(F.split_part(c, F.lit(","), F.lit(2))),
        "product_color": F.regexp_extract(rest, _COLOR_TOKEN, 1),
        "product_country": F.when(is_code, last).otherwise(""),
    }


def level_order(c, levels: list[str]) -> Column:
    """Position of a label in ``levels``; null for other labels."""
    pos = F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c))
    return F.when(pos > 0, (pos - 1).cast("int"))


def clip_text(c, n: int) -> Column:
    return F.substring(as_col(c), 1, n)


def ratio(num, den) -> Column:
    """``num / den``, null when the denominator is 0."""
    return F.try_divide(as_col(num), as_col(den))


def correlation(a, b) -> Column:
    """Pearson r of complete pairs; null when one side is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
