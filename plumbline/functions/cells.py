"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for a null on load.
NULL_TOKENS = ("nan", "n/a", "null", "none", "#n/a", "#ref!", "#value!", "#div/0!", "-", "?", "nil", "missing", "na", "n.a.", "<na>", "undefined", "null_value")
# Texts and numbers that stand for a null in the masked-null detector.
MASKED_TEXT = ("n/a", "na", "null", "none", "-", "--", "?", "missing", "unknown", "#n/a", "-999", "9999", "00/00/0000", "undefined", "blank", "n.a.", "nil")
MASKED_NUMBERS = (-999, -9999, 9999, 99999)
# Placeholders that the automatic cleaner empties.
PLACEHOLDERS = ("n/a", "na", "-999", "null", "?", "-", "missing", "unknown", "none")
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

#: The narrow sets of types that some operators accept.
FOUR = (T.LongType, T.IntegerType, T.DoubleType, T.FloatType)
TWO = (T.LongType, T.DoubleType)
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def of_type(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric(df: DataFrame) -> list[str]:
    return of_type(df, T.NumericType)


def strings(df: DataFrame) -> list[str]:
    return of_type(df, T.StringType)


SPACES = " \t\n\x0b\f\r"


def strip(c: Column) -> Column:
    """All white space off both ends (trim without a list takes spaces only); no pattern is tried at every character."""
    return F.btrim(c, F.lit(SPACES))


def null_tokens(c: Column, tokens=NULL_TOKENS) -> Column:
    """SAN-03: stripped text; a null token or nothing becomes null."""
    t = strip(c)
    return F.when(F.lower(t).isin(*tokens) | (t == ""), None).otherwise(t)


def undress(c: Column) -> Column:
    """Currency signs, separators, white space and % off; (x) is -x."""
    c = F.translate(c, "$,€£₹¥%" + SPACES, "")
    return F.when(c.startswith("("), F.regexp_replace(c, r"^\((.*)\)$", "-$1")).otherwise(c)


def to_number(c: Column) -> Column:
    """SAN-04: a double, or null if the undressed text isn't a plain number."""
    t = undress(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def finite(c: Column) -> Column:
    """SAN-05: NaN and infinities become null."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clip(c: Column, low, high) -> Column:
    """PRJ-06; null stays null."""
    return F.when(c > high, F.lit(high)).when(c < low, F.lit(low)).otherwise(c)


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & c.rlike(r"\p{L}")


def is_lower(c: Column) -> Column:
    return (c == F.lower(c)) & c.rlike(r"\p{L}")


def is_title(c: Column) -> Column:
    """Each run of letters begins in upper case and goes on in lower case."""
    return c.rlike(r"\p{L}") & ~c.rlike(r"(?<!\p{L})\p{Ll}|(?<=\p{L})\p{Lu}")


def total(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [f.cast("int") for f in flags]) if flags else F.lit(0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def vector(c: Column, kind: str = "array<double>") -> Column:
    """ARR-01: "[1, 2.5]" as an array; text that isn't one gives null."""
    return F.from_json(c, kind)


def metadata_text(c: Column) -> Column:
    """MAP/JSON-01: a map or struct as JSON, null members kept."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def metadata(c: Column) -> Column:
    """MAP/JSON-01: a JSON object as a map of texts; text that isn't one gives null."""
    return F.from_json(c, "map<string,string>")


def json_path(c: Column, *names: str) -> Column:
    """JSON-02: the value at a path of object members, as text; null where there is none."""
    return F.get_json_object(c, "$" + "".join(f"['{n}']" for n in names))
