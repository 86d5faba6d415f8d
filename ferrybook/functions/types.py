"""The decimal types of amounts and of their sums."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, DoubleType, FloatType, StringType

# One transfer's amount unless another type is asked for. At most 18 digits, so
# Spark stores it as one long.
AMOUNT = DecimalType(18, 4)


def volume_type(df: DataFrame) -> DecimalType:
    """Type of a sum of amounts: that of the amounts with all digits Spark has."""
    kind = df.schema["amount"].dataType
    if not isinstance(kind, DecimalType):
        raise TypeError(f"amount must be a decimal, not {kind.simpleString()}; see as_flows")
    return DecimalType(38, kind.scale)


def exact_decimal(value: Column, given: DataType, wanted: DecimalType, name: str) -> Column:
    """``value`` as ``wanted``; the query fails on a value that does not fit exactly.

    Doubles are rounded to the wanted scale (half up) and must come back as the same
    double, so 0.1 fits and 0.00001 does not fit four places. A text that is no number
    does not fit either.
    """
    cast = wanted.simpleString()
    if isinstance(given, StringType):
        # As many places as there are besides the wanted digits before the point.
        wide = DecimalType(38, 38 - (wanted.precision - wanted.scale))
        back = value.try_cast(cast).cast(wide).eqNullSafe(value.try_cast(wide.simpleString()))
        exact = back & value.try_cast(cast).isNotNull()
    elif isinstance(given, (FloatType, DoubleType)):
        exact = value.try_cast(cast).cast(given) == value
    else:
        exact = value.try_cast(cast).try_cast(given.simpleString()) == value
    message = F.concat(F.lit(f"{name} does not fit {cast} exactly: "), value.cast("string"))
    return (
        F.when(value.isNull(), F.lit(None).cast(wanted))
        .when(exact, value.try_cast(cast))
        .otherwise(F.raise_error(message).cast(wanted))
    )
