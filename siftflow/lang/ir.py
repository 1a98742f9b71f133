"""The immutable plan. str() of a node is canonical text that parses to an equal node."""

from __future__ import annotations

from dataclasses import dataclass, field

from siftflow.lang.lexer import quote

ALL = "*"
MSG, TIME, STREAM, STREAM_ID = "_msg", "_time", "_stream", "_stream_id"


def name(f: str) -> str:
    """A field, or a wildcard over fields that start so."""
    return quote(f[:-1]) + "*" if len(f) > 1 and f.endswith("*") else f if f == "*" else quote(f)


def names(fs) -> str:
    return ", ".join(map(name, fs))


def scope(f: str) -> str:
    return "" if f == MSG else quote(f) + ":"


def before_sign(f: str) -> str:
    """The field before a comparison is always written, as one after a word would belong to the word."""
    return quote(f) + ":"


def number(x: float) -> str:
    if x in (float("inf"), float("-inf")):
        return "inf" if x > 0 else "-inf"
    return str(int(x)) if x == int(x) and abs(x) < 1e16 else repr(x)


#: Binary operators of math, by how loosely they bind.
MATH_RANK = {"^": 1, "*": 2, "/": 2, "%": 2, "+": 3, "-": 3, "&": 4, "xor": 5, "or": 6, "default": 7}


class Filter:
    def parts(self) -> tuple[Filter, ...]:
        return ()


@dataclass(frozen=True)
class Noop(Filter):
    def __str__(self):
        return "*"


@dataclass(frozen=True)
class And(Filter):
    of: tuple[Filter, ...]

    def parts(self):
        return self.of

    def __str__(self):
        return " ".join(f"({f})" if isinstance(f, Or) else str(f) for f in self.of)


@dataclass(frozen=True)
class Or(Filter):
    of: tuple[Filter, ...]

    def parts(self):
        return self.of

    def __str__(self):
        return " or ".join(map(str, self.of))


@dataclass(frozen=True)
class Not(Filter):
    of: Filter

    def parts(self):
        return (self.of,)

    def __str__(self):
        return f"!({self.of})" if isinstance(self.of, (And, Or)) else f"!{self.of}"


@dataclass(frozen=True)
class Phrase(Filter):
    field: str
    text: str

    def __str__(self):
        return scope(self.field) + quote(self.text, PIPE_WORDS)


@dataclass(frozen=True)
class Prefix(Filter):
    field: str
    text: str

    def __str__(self):
        return scope(self.field) + (quote(self.text, PIPE_WORDS) if self.text else "") + "*" if self.field != MSG or self.text else quote(MSG) + ":*"


@dataclass(frozen=True)
class AnyCase(Filter):
    field: str
    text: str
    prefix: bool = False

    def __str__(self):
        return f"{scope(self.field)}i({quote(self.text)}{'*' if self.prefix else ''})"


@dataclass(frozen=True)
class Exact(Filter):
    field: str
    value: str

    def __str__(self):
        return f"{before_sign(self.field)}={quote(self.value)}"


@dataclass(frozen=True)
class ExactPrefix(Filter):
    field: str
    value: str

    def __str__(self):
        return f"{before_sign(self.field)}={quote(self.value)}*"


@dataclass(frozen=True)
class Regexp(Filter):
    field: str
    pattern: str

    def __str__(self):
        return f"{before_sign(self.field)}~{quote(self.pattern, {self.pattern.lower()})}"


@dataclass(frozen=True)
class Members(Filter):
    """in, contains_all or contains_any: of values, of a subquery's values, or of anything."""

    kind: str
    field: str
    values: tuple[str, ...] = ()
    query: Query | None = None
    anything: bool = False

    def __str__(self):
        inside = "*" if self.anything else str(self.query) if self.query else ", ".join(quote(v, PIPE_WORDS) for v in self.values)
        return f"{scope(self.field)}{self.kind}({inside})"


@dataclass(frozen=True)
class Seq(Filter):
    field: str
    phrases: tuple[str, ...]

    def __str__(self):
        return f"{scope(self.field)}seq({', '.join(map(quote, self.phrases))})"


@dataclass(frozen=True)
class Range(Filter):
    field: str
    low: float
    high: float
    with_low: bool = True
    with_high: bool = True

    def __str__(self):
        return f"{scope(self.field)}range{'[' if self.with_low else '('}{number(self.low)}, {number(self.high)}{']' if self.with_high else ')'}"


@dataclass(frozen=True)
class StringCompare(Filter):
    field: str
    op: str
    value: str

    def __str__(self):
        return f"{before_sign(self.field)}{self.op}{quote(self.value)}"


@dataclass(frozen=True)
class StringRange(Filter):
    field: str
    low: str
    high: str

    def __str__(self):
        return f"{scope(self.field)}string_range({quote(self.low)}, {quote(self.high)})"


@dataclass(frozen=True)
class LenRange(Filter):
    field: str
    low: float
    high: float

    def __str__(self):
        return f"{scope(self.field)}len_range({number(self.low)}, {number(self.high)})"


@dataclass(frozen=True)
class IPv4Range(Filter):
    field: str
    low: int
    high: int

    def __str__(self):
        ip = lambda n: ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
        return f"{scope(self.field)}ipv4_range({ip(self.low)}, {ip(self.high)})"


@dataclass(frozen=True)
class FieldCompare(Filter):
    field: str
    op: str  # eq, le, lt
    other: str

    def __str__(self):
        return f"{scope(self.field)}{self.op}_field({quote(self.other)})"


@dataclass(frozen=True)
class ValueType(Filter):
    field: str
    type: str

    def __str__(self):
        return f"{scope(self.field)}value_type({quote(self.type)})"


@dataclass(frozen=True)
class TimeRange(Filter):
    """Micros since the epoch, from low up to but without high; text is what was written."""

    low: int
    high: int
    text: str = field(default="", compare=False)

    def __str__(self):
        return f"{TIME}:{self.text}"


@dataclass(frozen=True)
class DayRange(Filter):
    """Micros of the day after the offset is taken off, from low up to but without high."""

    low: int
    high: int
    text: str = field(default="", compare=False)
    offset: int = 0

    def __str__(self):
        return f"{TIME}:day_range{self.text}"


@dataclass(frozen=True)
class WeekRange(Filter):
    """Days from 0, Sunday, both included, after the offset is taken off."""

    low: int
    high: int
    text: str = field(default="", compare=False)
    offset: int = 0

    def __str__(self):
        return f"{TIME}:week_range{self.text}"


@dataclass(frozen=True)
class StreamFilter(Filter):
    """An or of ands of (label, operator, values)."""

    of: tuple[tuple[tuple[str, str, tuple[str, ...]], ...], ...]

    def __str__(self):
        def one(label, op, values):
            q = lambda v: quote(v, {v.lower()})
            return f"{quote(label)} {op} ({', '.join(map(q, values))})" if "in" in op else f"{quote(label)}{op}{q(values[0])}"

        return "{" + " or ".join(", ".join(one(*t) for t in a) for a in self.of) + "}"


@dataclass(frozen=True)
class StreamIds(Filter):
    values: tuple[str, ...] = ()
    query: Query | None = None

    def __str__(self):
        return f"{STREAM_ID}:in({self.query or ', '.join(self.values)})"


# ---------------------------------------------------------------- pipes


class Pipe:
    pass


def cond(f: Filter | None) -> str:
    return "" if f is None else f" if ({'' if isinstance(f, Noop) else f})"


@dataclass(frozen=True)
class Fields(Pipe):
    of: tuple[str, ...]

    def __str__(self):
        return f"fields {names(self.of)}"


@dataclass(frozen=True)
class Delete(Pipe):
    of: tuple[str, ...]

    def __str__(self):
        return f"delete {names(self.of)}"


@dataclass(frozen=True)
class Copy(Pipe):
    pairs: tuple[tuple[str, str], ...]
    move: bool = False

    def __str__(self):
        return ("rename " if self.move else "copy ") + ", ".join(f"{name(a)} as {name(b)}" for a, b in self.pairs)


@dataclass(frozen=True)
class DropEmptyFields(Pipe):
    def __str__(self):
        return "drop_empty_fields"


@dataclass(frozen=True)
class FieldNames(Pipe):
    result: str = "name"

    def __str__(self):
        return f"field_names as {quote(self.result)}"


@dataclass(frozen=True)
class Pack(Pipe):
    kind: str  # json or logfmt
    of: tuple[str, ...] = (ALL,)
    result: str = MSG

    def __str__(self):
        return f"pack_{self.kind}" + ("" if self.of == (ALL,) else f" fields ({names(self.of)})") + f" as {quote(self.result)}"


@dataclass(frozen=True)
class Where(Pipe):
    filter: Filter

    def __str__(self):
        return f"filter {self.filter}"


@dataclass(frozen=True)
class Extract(Pipe):
    pattern: str
    source: str = MSG
    keep: bool = False
    skip_empty: bool = False
    iff: Filter | None = None
    regexp: bool = False

    def __str__(self):
        return f"extract{'_regexp' if self.regexp else ''}{cond(self.iff)} {quote(self.pattern, {self.pattern.lower()})} from {quote(self.source)}" + " keep_original_fields" * self.keep + " skip_empty_results" * self.skip_empty


@dataclass(frozen=True)
class Format(Pipe):
    pattern: str
    result: str = MSG
    keep: bool = False
    skip_empty: bool = False
    iff: Filter | None = None

    def __str__(self):
        return f"format{cond(self.iff)} {quote(self.pattern, {self.pattern.lower()})} as {quote(self.result)}" + " keep_original_fields" * self.keep + " skip_empty_results" * self.skip_empty


@dataclass(frozen=True)
class MathExpr:
    """op: num, field, a function's name, or a binary operator."""

    op: str
    args: tuple = ()
    value: str = ""

    def __str__(self):
        if self.op == "num":
            return self.value if self.value[:1].isdigit() and all(c.isalnum() or c == "." for c in self.value) else quote(self.value)
        if self.op == "field":
            return quote(self.value, {"default"})
        if self.op.isalpha() and self.op not in ("xor", "or", "default"):
            return f"{self.op}({', '.join(map(str, self.args))})"
        if len(self.args) == 1:
            return f"{self.op}({self.args[0]})" if self.args[0].rank() else f"{self.op}{self.args[0]}"
        left, right = (f"({a})" if a.rank() > self.rank() or i and a.rank() == self.rank() else str(a) for i, a in enumerate(self.args))
        return f"{left} {self.op} {right}"

    def rank(self) -> int:
        """How loosely it binds: 0 for a value or a call."""
        return MATH_RANK.get(self.op, 0) if len(self.args) == 2 else 0


@dataclass(frozen=True)
class Math(Pipe):
    of: tuple[tuple[MathExpr, str], ...]

    def __str__(self):
        return "math " + ", ".join(f"{e} as {quote(r)}" for e, r in self.of)


@dataclass(frozen=True)
class Replace(Pipe):
    old: str
    new: str
    at: str = MSG
    limit: int = 0
    iff: Filter | None = None
    regexp: bool = False

    def __str__(self):
        return f"replace{'_regexp' if self.regexp else ''}{cond(self.iff)} ({quote(self.old, {self.old.lower()})}, {quote(self.new, {self.new.lower()})}) at {quote(self.at)}" + (f" limit {self.limit}" if self.limit else "")


@dataclass(frozen=True)
class CollapseNums(Pipe):
    at: str = MSG
    prettify: bool = False
    iff: Filter | None = None

    def __str__(self):
        return f"collapse_nums{cond(self.iff)} at {quote(self.at)}" + " prettify" * self.prettify


@dataclass(frozen=True)
class Decolorize(Pipe):
    at: str = MSG

    def __str__(self):
        return f"decolorize {quote(self.at)}"


@dataclass(frozen=True)
class FieldFunction(Pipe):
    """hash, len or json_array_len."""

    kind: str
    source: str
    result: str

    def __str__(self):
        return f"{self.kind}({quote(self.source)}) as {quote(self.result)}"


@dataclass(frozen=True)
class Unpack(Pipe):
    kind: str  # json, logfmt, syslog
    source: str = MSG
    of: tuple[str, ...] = (ALL,)
    prefix: str = ""
    keep: bool = False
    skip_empty: bool = False
    iff: Filter | None = None
    offset: int | None = None

    def __str__(self):
        return (
            f"unpack_{self.kind}{cond(self.iff)} from {quote(self.source)}"
            + (f" offset {self.offset}us" if self.offset is not None else "")
            + ("" if self.of == (ALL,) else f" fields ({names(self.of)})")
            + (f" result_prefix {quote(self.prefix)}" if self.prefix else "")
            + " keep_original_fields" * self.keep
            + " skip_empty_results" * self.skip_empty
        )


@dataclass(frozen=True)
class UnpackWords(Pipe):
    source: str = MSG
    result: str = MSG
    distinct: bool = False

    def __str__(self):
        return f"unpack_words from {quote(self.source)} as {quote(self.result)}" + " drop_duplicates" * self.distinct


@dataclass(frozen=True)
class Unroll(Pipe):
    of: tuple[str, ...]
    iff: Filter | None = None

    def __str__(self):
        return f"unroll{cond(self.iff)} by ({names(self.of)})"


@dataclass(frozen=True)
class Sample(Pipe):
    n: int

    def __str__(self):
        return f"sample {self.n}"


@dataclass(frozen=True)
class Sort(Pipe):
    by: tuple[tuple[str, bool], ...] = ()  # field, descending
    desc: bool = False
    partition: tuple[str, ...] = ()
    offset: int = 0
    limit: int | None = None
    rank: str = ""

    def __str__(self):
        return (
            "sort"
            + (f" by ({', '.join(quote(f) + ' desc' * d for f, d in self.by)})" if self.by else "")
            + " desc" * self.desc
            + (f" partition by ({names(self.partition)})" if self.partition else "")
            + (f" offset {self.offset}" if self.offset else "")
            + (f" limit {self.limit}" if self.limit is not None else "")
            + (f" rank as {quote(self.rank)}" if self.rank else "")
        )


@dataclass(frozen=True)
class Limit(Pipe):
    n: int = 10

    def __str__(self):
        return f"limit {self.n}"


@dataclass(frozen=True)
class Offset(Pipe):
    n: int

    def __str__(self):
        return f"offset {self.n}"


@dataclass(frozen=True)
class Uniq(Pipe):
    by: tuple[str, ...] = ()
    hits: str = ""
    limit: int = 0

    def __str__(self):
        return "uniq" + (f" by ({names(self.by)})" if self.by else "") + (f" with hits as {quote(self.hits)}" if self.hits else "") + (f" limit {self.limit}" if self.limit else "")


@dataclass(frozen=True)
class Top(Pipe):
    n: int = 10
    by: tuple[str, ...] = ()
    hits: str = "hits"
    rank: str = ""

    def __str__(self):
        return f"top {self.n}" + (f" by ({names(self.by)})" if self.by else "") + f" hits as {quote(self.hits)}" + (f" rank as {quote(self.rank)}" if self.rank else "")


@dataclass(frozen=True)
class Facets(Pipe):
    n: int = 10
    max_values: int = 1000
    max_len: int = 128
    keep_const: bool = False

    def __str__(self):
        return f"facets {self.n} max_values_per_field {self.max_values} max_value_len {self.max_len}" + " keep_const_fields" * self.keep_const


@dataclass(frozen=True)
class FieldValues(Pipe):
    of: str
    limit: int = 0

    def __str__(self):
        return f"field_values {quote(self.of)}" + (f" limit {self.limit}" if self.limit else "")


@dataclass(frozen=True)
class GroupKey:
    field: str
    bucket: str = ""
    offset: str = ""

    def __str__(self):
        return quote(self.field) + (f":{quote(self.bucket, {self.bucket.lower()})}" if self.bucket else "") + (f" offset {quote(self.offset, {self.offset.lower()})}" if self.offset else "")


@dataclass(frozen=True)
class StatsFunc:
    kind: str
    args: tuple[str, ...] = (ALL,)
    result: str = ""
    iff: Filter | None = None
    limit: int = 0
    phi: float = 0.5

    def call(self) -> str:
        args = ([number(self.phi)] if self.kind == "quantile" else []) + ([] if self.args == (ALL,) and self.kind in ("quantile", "rate") else [name(a) for a in self.args])
        return f"{self.kind}({', '.join(args)})" + (f" limit {self.limit}" if self.limit else "")

    def __str__(self):
        return self.call() + cond(self.iff) + f" as {quote(self.result)}"


@dataclass(frozen=True)
class Stats(Pipe):
    by: tuple[GroupKey, ...]
    funcs: tuple[StatsFunc, ...]

    def __str__(self):
        return "stats" + (f" by ({', '.join(map(str, self.by))})" if self.by else "") + " " + ", ".join(map(str, self.funcs))


@dataclass(frozen=True)
class Join(Pipe):
    by: tuple[str, ...]
    query: Query
    inner: bool = False
    prefix: str = ""

    def __str__(self):
        return f"join by ({names(self.by)}) ({self.query})" + " inner" * self.inner + (f" prefix {quote(self.prefix)}" if self.prefix else "")


@dataclass(frozen=True)
class Union(Pipe):
    query: Query

    def __str__(self):
        return f"union ({self.query})"


@dataclass(frozen=True)
class StreamContext(Pipe):
    before: int = 0
    after: int = 0
    window: int = 3_600_000_000  # micros

    def __str__(self):
        return f"stream_context before {self.before} after {self.after} time_window {self.window}us"


@dataclass(frozen=True)
class BlockStats(Pipe):
    def __str__(self):
        return "block_stats"


@dataclass(frozen=True)
class BlocksCount(Pipe):
    result: str = "blocks_count"

    def __str__(self):
        return f"blocks_count as {quote(self.result)}"


@dataclass(frozen=True)
class Query:
    filter: Filter
    pipes: tuple[Pipe, ...] = ()
    options: tuple[tuple[str, str], ...] = ()

    def __str__(self):
        opts = f"options({', '.join(f'{k}={v}' for k, v in self.options)}) " if self.options else ""
        return opts + " | ".join([str(self.filter), *map(str, self.pipes)])


#: Words that start a pipe, and stats functions, which may start one too.
STATS_FUNCS = set(
    """
avg count count_empty count_uniq count_uniq_hash histogram json_values max median min quantile rate rate_sum row_any row_max row_min sum sum_len
uniq_values values
""".split()
)
PIPE_WORDS = STATS_FUNCS | set(
    """
block_stats blocks_count collapse_nums copy cp decolorize del delete drop drop_empty_fields eval extract extract_regexp facets field_names
field_values fields filter first format hash head join json_array_len keep last len limit math mv offset order pack_json pack_logfmt rename replace
replace_regexp rm sample skip sort stats stream_context top union uniq unpack_json unpack_logfmt unpack_syslog unpack_words unroll where
""".split()
)
