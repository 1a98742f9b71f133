"""A table seen as a log: a DataFrame with known time, message and stream columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftflow.functions import values
from siftflow.lang.ir import ALL, MSG, STREAM, STREAM_ID, TIME


def c(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class LogFrame:
    """df has the columns _time and _msg where the log has a time and a message; `stream` names the columns that tell streams apart.

    `extra` names a map<string, string> column that holds fields without a column of their own; `day` a date column that the
    table is partitioned by.
    """

    df: DataFrame
    stream: tuple[str, ...] = ()
    extra: str = ""
    day: str = ""
    types: dict[str, T.DataType] = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "types", {f.name: f.dataType for f in self.df.schema.fields})

    @staticmethod
    def of(df: DataFrame, time: str = "", msg: str = "", stream: tuple[str, ...] | list[str] = (), extra: str = "", day: str = "") -> LogFrame:
        for old, new in ((time, TIME), (msg, MSG)):
            if old and old != new:
                df = df.withColumnRenamed(old, new)
        return LogFrame(df, tuple(MSG if s == msg else s for s in stream), extra, day)

    def with_df(self, df: DataFrame) -> LogFrame:
        cols = set(df.columns)
        return replace(self, df=df, stream=self.stream if all(s in cols for s in self.stream) else (), extra=self.extra if self.extra in cols else "", day=self.day if self.day in cols else "")

    # ------------------------------------------------------------ columns

    @property
    def columns(self) -> list[str]:
        return [x for x in self.df.columns if x not in (self.extra, self.day)]

    def has(self, name: str) -> bool:
        return name in self.types or name in (STREAM, STREAM_ID) and bool(self.stream)

    def type(self, name: str) -> T.DataType:
        return self.types.get(name, T.StringType())

    def col(self, name: str) -> Column:
        """The column of a field; null text for one that doesn't exist."""
        if name in self.types:
            return c(name)
        if self.stream and name == STREAM:
            return self.stream_text()
        if self.stream and name == STREAM_ID:
            return F.concat(F.lit("0" * 16), F.md5(self.stream_text()))
        if self.extra:
            return F.try_element_at(c(self.extra), F.lit(name))
        return F.lit(None).cast("string")

    def stream_text(self) -> Column:
        """{a="1",b="2"} of the stream columns that aren't empty, by name."""
        labels = [F.when(self.text(s) != "", F.concat(F.lit(f'{s}="'), F.replace(F.replace(self.text(s), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))) for s in sorted(self.stream)]
        return F.concat(F.lit("{"), F.concat_ws(",", *labels), F.lit("}"))

    def label(self, name: str) -> Column:
        """The text of a label of the row's stream; '' if the stream doesn't have it."""
        if name in self.stream:
            return self.text(name)
        if not self.stream and STREAM in self.types:  # a stored log holds the labels in the stream's text
            raw = F.regexp_extract(c(STREAM), r'(?:^\{|,)\Q' + name + r'\E="((?:[^"\\]|\\.)*)"', 1)
            return F.coalesce(F.regexp_replace(raw, r"\\(.)", "$1"), F.lit(""))
        return F.lit("")

    def text(self, name: str) -> Column:
        return values.as_str(self.col(name), self.type(name))

    def number(self, name: str) -> Column:
        return values.as_num(self.col(name), self.type(name))

    def filled(self, name: str) -> Column:
        """Whether a field has a value; never null."""
        x, t = self.col(name), self.type(name)
        return F.coalesce(x != "", F.lit(False)) if isinstance(t, T.StringType) else x.isNotNull()

    def key(self, name: str) -> Column:
        """What groups and joins compare: '' and missing text are one."""
        x, t = self.col(name), self.type(name)
        return F.coalesce(x, F.lit("")) if isinstance(t, (T.StringType, T.NullType)) else x

    def order(self, name: str) -> Column:
        return values.sort_key(self.col(name), self.type(name))

    def expand(self, fields) -> list[str]:
        """Names with wildcards resolved on the columns there are, each once."""
        out: dict[str, None] = {}
        for f in fields:
            if f == ALL:
                out |= dict.fromkeys(self.columns)
            elif f.endswith("*"):
                out |= dict.fromkeys(x for x in self.columns if x.startswith(f[:-1]))
            else:
                out[f] = None
        return list(out)

    def row_json(self, fields, in_order: bool = False) -> Column:
        """The non-empty values of a row as JSON of strings, keys sorted, or in the order of the fields."""
        names = self.expand(fields) if in_order else sorted(self.expand(fields))
        cols = [F.when(self.text(n) != "", self.text(n)).alias(n) for n in names]
        return F.to_json(F.struct(*cols)) if cols else F.lit("{}")
