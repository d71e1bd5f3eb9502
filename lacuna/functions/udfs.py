"""The one scalar that built-in functions can't express: balanced parentheses are not regular."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.extract_python import clean_call_name


@F.pandas_udf(StringType())
def clean_call_names(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else clean_call_name(x))
