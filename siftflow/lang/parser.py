"""Text to plan."""

from __future__ import annotations

import re
import time as clock

from siftflow.lang import ir, literals
from siftflow.lang.lexer import END, QueryError, Token, tokens

STOPS = set("()[]{}|,:!~=<>") | {"!=", "!~", "=~", "<=", ">="}
SPAN_STOPS = set("()[]|,")
DAYS = {d: i for i, names in enumerate(("sun sunday", "mon monday", "tue tuesday", "wed wednesday", "thu thursday", "fri friday", "sat saturday")) for d in names.split()}
MEMBERS = {"in", "contains_all", "contains_any"}
FUNCS = MEMBERS | {"exact", "re", "i", "seq", "range", "string_range", "len_range", "ipv4_range", "eq_field", "le_field", "lt_field", "value_type", "pattern_match"}
COMPARE = {"=", "!=", "=~", "~", "!~", "<", "<=", ">", ">="}
MATH_FUNCS = {"abs": 1, "ceil": 1, "exp": 1, "floor": 1, "ln": 1, "now": 0, "rand": 0, "round": (1, 2), "max": None, "min": None}


def parse(text: str, now_us: int | None = None) -> ir.Query:
    """now_us: what relative times are measured from, in micros since the epoch; the clock's time if None."""
    p = Parser(text, now_us if now_us is not None else clock.time_ns() // 1000)
    q = p.query()
    if not p.done():
        raise p.error("unexpected text")
    return q


class Parser:
    def __init__(self, text: str, now_us: int):
        self.text, self.toks, self.i, self.now = text, tokens(text), 0, now_us

    # ------------------------------------------------------------ tokens

    @property
    def t(self) -> Token:
        return self.toks[self.i] if self.i < len(self.toks) else END

    def ahead(self, n: int = 1) -> Token:
        return self.toks[self.i + n] if self.i + n < len(self.toks) else END

    def done(self) -> bool:
        return self.i >= len(self.toks)

    def error(self, why: str) -> QueryError:
        at = self.t.at if not self.done() else len(self.text)
        return QueryError(f"{why} at {at}: {self.text[at : at + 30]!r}")

    def is_(self, *words: str) -> bool:
        return not self.done() and self.t.low() in words

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += 1
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise self.error(f"expected {' or '.join(words)}")

    def compound(self, stops=STOPS) -> str:
        """A token, with those that follow it without white space up to a stop."""
        if self.done() or not self.t.quoted and self.t.text in stops:
            raise self.error("expected a word")
        first = self.t
        self.i += 1
        out = [first.text]
        if first.quoted:
            return first.text
        while not self.done() and not self.t.gap and not self.t.quoted and self.t.text not in stops and self.t.text != "*":
            out.append(self.t.text)
            self.i += 1
        return "".join(out)

    def span_text(self, stops=SPAN_STOPS) -> str:
        """Like compound, but colons, signs and the like belong to it, as in times."""
        return self.compound(stops)

    def field(self) -> str:
        return self.compound(STOPS | {"+", "*", "/"})

    def field_or_wildcard(self) -> str:
        if self.take("*"):
            return ir.ALL
        f = self.compound()
        if not self.done() and not self.t.gap and self.is_("*"):
            self.i += 1
            f += "*"
        return f

    def fields(self, wild: bool = True) -> tuple[str, ...]:
        """a, b or (a, b); a trailing * is a wildcard where that is allowed."""
        one = self.field_or_wildcard if wild else self.field
        out = []
        if self.take("("):
            while not self.take(")"):
                out.append(one())
                if not self.is_(")"):
                    self.need(",")
        else:
            out.append(one())
            while self.take(","):
                out.append(one())
        return tuple(out)

    def count(self) -> int:
        return literals.count(self.compound())

    # ------------------------------------------------------------ queries

    def query(self) -> ir.Query:
        options: list[tuple[str, str]] = []
        if self.is_("options") and self.ahead().text == "(":
            self.i += 2
            while not self.take(")"):
                k = self.compound()
                self.need("=")
                v = self.compound()
                if k not in ("concurrency", "ignore_global_time_filter", "parallel_readers", "allow_partial_response"):
                    raise self.error(f"unknown option {k}")
                options.append((k, v))
                if not self.is_(")"):
                    self.need(",")
        f = self.filter()
        pipes = []
        while self.take("|"):
            pipes.append(self.pipe())
        return ir.Query(f, tuple(pipes), tuple(options))

    def subquery(self) -> ir.Query:
        self.need("(")
        q = self.query()
        self.need(")")
        return q

    # ------------------------------------------------------------ filters

    def filter(self, field: str = ir.MSG, scoped: bool = False) -> ir.Filter:
        of = [self.and_(field, scoped)]
        while self.take("or"):
            of.append(self.and_(field, scoped))
        return of[0] if len(of) == 1 else ir.Or(tuple(of))

    def and_(self, field: str, scoped: bool) -> ir.Filter:
        of: list[ir.Filter] = []
        while True:
            f = self.unary(field, scoped)
            of += f.of if isinstance(f, ir.And) else (f,)
            self.take("and")
            if self.done() or self.is_("|", ")", "or", ","):
                break
        return of[0] if len(of) == 1 else ir.And(tuple(of))

    def unary(self, field: str, scoped: bool) -> ir.Filter:
        if self.take("not", "!", "-"):
            f = self.unary(field, scoped)
            return f.of if isinstance(f, ir.Not) else ir.Not(f)
        if self.take("("):
            f = self.filter(field, scoped)
            self.need(")")
            return f
        if self.is_("{") and not scoped:
            return self.stream()
        if self.done():
            raise self.error("expected a filter")
        if not scoped:
            if self.is_("*") and self.ahead().text != ":":
                self.i += 1
                return ir.Noop()
            at = self.i
            if not self.t.quoted and self.t.text in COMPARE:
                return self.value(field)
            if self.t.low() in FUNCS and self.ahead().text == "(" and not self.ahead().quoted:
                return self.value(field)
            if self.t.low() in ir.PIPE_WORDS and self.ahead().text not in (":", *COMPARE):
                raise self.error("a pipe's name must be quoted to be searched for")
            name = ir.ALL if self.take("*") else self.compound(STOPS | {"*"})
            if self.take(":"):
                if name == ir.STREAM and self.is_("{"):
                    return self.stream()
                return self.value(name)
            if not self.done() and not self.t.quoted and self.t.text in COMPARE:
                return self.value(name)
            self.i = at
        return self.value(field)

    def value(self, field: str) -> ir.Filter:
        if field == ir.TIME:
            return self.time()
        if field == ir.STREAM_ID:
            return self.stream_ids()
        if self.take("("):
            f = self.filter(field, True)
            self.need(")")
            return f
        if self.take("not", "!", "-"):
            return ir.Not(self.value(field))
        if self.take("!="):
            return ir.Not(self.exact(field))
        if self.take("="):
            return self.exact(field)
        if self.take("~", "=~"):
            return self.regexp(field)
        if self.take("!~"):
            return ir.Not(self.regexp(field))
        if self.is_("<", "<=", ">", ">="):
            op = self.t.text
            self.i += 1
            if self.take("="):
                op += "="
            text = self.span_text()
            x = literals.number(text)
            if x is None:
                return ir.StringCompare(field, op, text)
            inf = float("inf")
            return ir.Range(field, x, inf, op == ">=", True) if op[0] == ">" else ir.Range(field, -inf, x, True, op == "<=")
        if self.take("*"):
            return ir.Prefix(field, "")
        if self.t.low() in FUNCS and self.ahead().text in "([" and not self.ahead().quoted and self.ahead().text:
            return self.function(field)
        text = self.compound(STOPS | {"*"})
        if not self.done() and not self.t.gap and self.take("*"):
            return ir.Prefix(field, text)
        return ir.Phrase(field, text)

    def exact(self, field: str) -> ir.Filter:
        if self.take("("):
            values = []
            while not self.take(")"):
                values.append(self.compound())
                self.take("or", ",")
            return ir.Members("in", field, tuple(values))
        text = self.compound(SPAN_STOPS | {"*"})
        if not self.done() and not self.t.gap and self.take("*"):
            return ir.ExactPrefix(field, text)
        return ir.Exact(field, text)

    def regexp(self, field: str) -> ir.Filter:
        return ir.Regexp(field, checked_regexp(self.compound(SPAN_STOPS)))

    def function(self, field: str) -> ir.Filter:
        kind = self.t.low()
        self.i += 1
        if kind in MEMBERS:
            return self.members(kind, field)
        if kind in ("range",):
            return self.range(field)
        self.need("(")
        if kind == "i":
            if self.take("*"):
                f: ir.Filter = ir.AnyCase(field, "", True)
            else:
                text = self.compound(STOPS | {"*"})
                f = ir.AnyCase(field, text, self.take("*"))
            self.need(")")
            return f
        args = []
        wild = False
        while not self.take(")"):
            if self.take("*"):
                wild = True
            else:
                args.append(self.compound(SPAN_STOPS | {"*"}))
            if not self.is_(")", "*"):
                self.need(",")

        def take(n: int) -> None:
            if len(args) != n:
                raise self.error(f"{kind} takes {n} values")

        if kind == "exact":
            take(1)
            return ir.ExactPrefix(field, args[0]) if wild else ir.Exact(field, args[0])
        if kind == "re":
            take(1)
            return ir.Regexp(field, checked_regexp(args[0]))
        if kind == "seq":
            return ir.Seq(field, tuple(args))
        if kind == "string_range":
            take(2)
            return ir.StringRange(field, *args)
        if kind == "len_range":
            take(2)
            x = [literals.number(a) for a in args]
            if None in x:
                raise self.error("len_range takes numbers")
            return ir.LenRange(field, *x)
        if kind == "ipv4_range":
            if len(args) == 1:
                ip, _, bits = args[0].partition("/")
                low = literals.ipv4(ip)
                n = int(bits) if bits.isdigit() else 32
                if low is None or n > 32:
                    raise self.error("bad address")
                mask = (0xFFFFFFFF << (32 - n)) & 0xFFFFFFFF
                return ir.IPv4Range(field, low & mask, low | (mask ^ 0xFFFFFFFF))
            take(2)
            low, high = map(literals.ipv4, args)
            if low is None or high is None:
                raise self.error("bad address")
            return ir.IPv4Range(field, low, high)
        if kind in ("eq_field", "le_field", "lt_field"):
            take(1)
            return ir.FieldCompare(field, kind[:2], args[0])
        if kind == "value_type":
            take(1)
            return ir.ValueType(field, args[0])
        raise self.error(f"unknown filter {kind}")

    def members(self, kind: str, field: str) -> ir.Filter:
        self.need("(")
        if self.is_("*") and self.ahead().text == ")":
            self.i += 2
            return ir.Members(kind, field, anything=True)
        at = self.i
        values: list[str] = []
        try:
            while not self.take(")"):
                values.append(self.compound(SPAN_STOPS))
                if not self.is_(")"):
                    self.need(",")
            return ir.Members(kind, field, tuple(values))
        except QueryError:
            self.i = at
        q = self.query()
        self.need(")")
        values_field(q)
        return ir.Members(kind, field, query=q)

    def range(self, field: str) -> ir.Filter:
        with_low = self.is_("[")
        self.need("(", "[")
        low = literals.number(self.span_text())
        self.need(",")
        high = literals.number(self.span_text())
        with_high = self.is_("]")
        self.need(")", "]")
        if low is None or high is None:
            raise self.error("range takes numbers")
        return ir.Range(field, low, high, with_low, with_high)

    def stream(self) -> ir.Filter:
        self.need("{")
        ors = []
        while True:
            ands = []
            while not self.is_("or", "}"):
                label = self.compound()
                if self.take("in"):
                    op = "in"
                elif self.take("not_in"):
                    op = "not_in"
                else:
                    op = self.t.text
                    self.need("=", "!=", "=~", "!~")
                if "in" in op:
                    values = self.fields(False)
                else:
                    values = (self.compound(),)
                    if "~" in op:
                        checked_regexp(values[0])
                ands.append((label, op, values))
                if not self.is_("or", "}"):
                    self.need(",")
            if ands:
                ors.append(tuple(ands))
            if self.take("}"):
                break
            self.need("or")
        return ir.StreamFilter(tuple(ors)) if ors else ir.Noop()

    def stream_ids(self) -> ir.Filter:
        if self.take("in"):
            at = self.i
            try:
                return ir.StreamIds(self.fields(False))
            except QueryError:
                self.i = at
            q = self.subquery()
            values_field(q)
            return ir.StreamIds(query=q)
        self.take("=")
        return ir.StreamIds((self.compound(),))

    # ------------------------------------------------------------ times

    def time(self) -> ir.Filter:
        start = self.t.at
        if self.is_("day_range", "week_range"):
            return self.day_or_week()
        if self.is_("[", "("):
            with_low = self.is_("[")
            self.i += 1
            a = self.span_text(SPAN_STOPS)
            self.need(",")
            b = self.span_text(SPAN_STOPS)
            with_high = self.is_("]")
            self.need("]", ")")
            lo, hi = self.moment(a), self.moment(b)
            low = lo[0] if with_low else lo[1]
            high = hi[1] if with_high else hi[0]
        elif self.is_(">", ">=", "<", "<="):
            op = self.t.text
            self.i += 1
            if self.take("="):
                op += "="
            raw = self.span_text()
            far = 1 << 62
            if (ns := literals.duration_ns(raw)) is not None:  # an age: over 1h is before an hour ago
                at = self.now - int(ns // 1000)
                low, high = (-far, at) if op[0] == ">" else (at, far)
            else:
                s = self.moment(raw)
                low, high = {">": (s[1], far), ">=": (s[0], far), "<": (-far, s[0]), "<=": (-far, s[1])}[op]
        else:
            self.take("=")
            raw = self.span_text(SPAN_STOPS)
            ns = literals.duration_ns(raw)
            if ns is not None:
                low, high = self.now - int(abs(ns) // 1000), self.now
            else:
                low, high = self.moment(raw)
        if self.take("offset"):
            off = literals.duration_us(self.span_text())
            low, high = low - off, high - off
        return ir.TimeRange(low, high, self.raw(start))

    def raw(self, start: int) -> str:
        end = self.toks[self.i].at if self.i < len(self.toks) else len(self.text)
        return self.text[start:end].strip()

    def moment(self, raw: str) -> tuple[int, int]:
        if raw == "now":
            return self.now, self.now
        if (s := literals.time_span(raw)) is not None:
            return s
        if (ns := literals.duration_ns(raw.removeprefix("now"))) is not None:
            at = self.now - int(abs(ns) // 1000)
            return at, at
        if (u := literals.unix_us(raw)) is not None:
            return u, u + 1
        raise self.error(f"{raw!r} isn't a time")

    def day_or_week(self) -> ir.Filter:
        day = self.t.low() == "day_range"
        self.i += 1
        start = self.t.at
        with_low = self.is_("[")
        self.need("[", "(")
        a = self.span_text()
        self.need(",")
        b = self.span_text()
        with_high = self.is_("]")
        self.need("]", ")")
        off = literals.duration_us(self.span_text()) if self.take("offset") else 0
        if day:
            low, high = self.day_micros(a), self.day_micros(b)
            return ir.DayRange(low + (0 if with_low else 60_000_000), high + (60_000_000 if with_high and b != "24:00" else 0), self.raw(start), off)
        if a.lower() not in DAYS or b.lower() not in DAYS:
            raise self.error("unknown day of the week")
        return ir.WeekRange(DAYS[a.lower()] + (not with_low), DAYS[b.lower()] - (not with_high), self.raw(start), off)

    def day_micros(self, text: str) -> int:
        m = re.match(r"(\d{1,2}):(\d{2})$", text)
        if not m or int(m[1]) * 60 + int(m[2]) > 24 * 60 or int(m[2]) > 59:
            raise self.error(f"{text!r} isn't a time of the day")
        return (int(m[1]) * 60 + int(m[2])) * 60_000_000

    # ------------------------------------------------------------ pipes

    def pipe(self) -> ir.Pipe:
        word = self.t.low()
        handler = PIPES.get(word)
        if handler and not (word in ir.STATS_FUNCS and self.ahead().text == "("):
            self.i += 1
            return handler(self)
        if word in ir.STATS_FUNCS and self.ahead().text == "(" or word == "by" and self.ahead().text == "(":
            return self.stats()
        return ir.Where(self.filter())

    def iff(self) -> ir.Filter | None:
        if not self.take("if"):
            return None
        self.need("(")
        if self.take(")"):
            return ir.Noop()
        f = self.filter()
        self.need(")")
        return f

    def keep(self) -> dict:
        out = {}
        while self.is_("keep_original_fields", "skip_empty_results"):
            out["keep" if self.t.low() == "keep_original_fields" else "skip_empty"] = True
            self.i += 1
        return out

    def ends(self) -> bool:
        return self.done() or self.is_("|", ")")

    def result(self, default: str) -> str:
        if self.take("as"):
            return self.field()
        return default if self.ends() else self.field()

    def pairs(self) -> tuple[tuple[str, str], ...]:
        out = []
        while True:
            a = self.field_or_wildcard()
            self.take("as")
            out.append((a, self.field_or_wildcard()))
            if not self.take(","):
                return tuple(out)

    def pack(self, kind: str) -> ir.Pipe:
        of, result = (ir.ALL,), ir.MSG
        while not self.ends():
            if self.take("fields"):
                of = self.fields()
            else:
                result = self.result(ir.MSG)
        return ir.Pack(kind, of, result)

    def extract(self, regexp: bool) -> ir.Pipe:
        iff = self.iff()
        pattern = self.compound()
        source = self.field() if self.take("from") else ir.MSG
        if regexp:
            checked_regexp(pattern)
            if not re.search(r"\(\?P?<", pattern):
                raise self.error("extract_regexp needs a named group")
        return ir.Extract(pattern, source, iff=iff, regexp=regexp, **self.keep())

    def format(self) -> ir.Pipe:
        iff = self.iff()
        pattern = self.compound()
        result = self.field() if self.take("as") else ir.MSG
        return ir.Format(pattern, result, iff=iff, **self.keep())

    def replace(self, regexp: bool) -> ir.Pipe:
        iff = self.iff()
        self.need("(")
        old = self.compound()
        self.need(",")
        new = self.compound()
        self.need(")")
        at = self.field() if self.take("at") else ir.MSG
        limit = self.count() if self.take("limit") else 0
        if regexp:
            checked_regexp(old)
        return ir.Replace(old, new, at, limit, iff, regexp)

    def collapse(self) -> ir.Pipe:
        iff = self.iff()
        at = self.field() if self.take("at") else ir.MSG
        return ir.CollapseNums(at, self.take("prettify"), iff)

    def field_function(self, kind: str) -> ir.Pipe:
        inside = self.take("(")
        source = self.field()
        if inside:
            self.need(")")
        return ir.FieldFunction(kind, source, self.result(ir.MSG))

    def unpack(self, kind: str) -> ir.Pipe:
        at: dict = {"iff": self.iff()}
        while not self.ends():
            if self.take("from"):
                at["source"] = self.field()
            elif self.take("fields"):
                at["of"] = self.fields()
            elif self.take("result_prefix"):
                at["prefix"] = self.compound()
            elif kind == "syslog" and self.take("offset"):
                at["offset"] = literals.duration_us(self.compound())
            elif self.is_("keep_original_fields", "skip_empty_results"):
                at |= self.keep()
            elif "source" not in at:
                at["source"] = self.field()
            else:
                raise self.error("unexpected word")
        return ir.Unpack(kind, **at)

    def unpack_words(self) -> ir.Pipe:
        source, result, distinct = ir.MSG, None, False
        while not self.ends():
            if self.take("from"):
                source = self.field()
            elif self.take("as"):
                result = self.field()
            elif self.take("drop_duplicates"):
                distinct = True
            else:
                source = self.field()
        return ir.UnpackWords(source, result or source, distinct)

    def unroll(self) -> ir.Pipe:
        iff = self.iff()
        self.take("by")
        of = self.fields(False)
        return ir.Unroll(of, iff or self.iff())

    def sort_keys(self) -> tuple[tuple[str, bool], ...]:
        out = []
        self.need("(")
        while not self.take(")"):
            f = self.field()
            out.append((f, self.take("desc") or (self.take("asc") and False)))
            if not self.is_(")"):
                self.need(",")
        return tuple(out)

    def rank(self) -> str:
        self.take("as")
        return "rank" if self.ends() or self.is_("limit", "offset", "partition") else self.field()

    def sort_tail(self, by, desc, limit) -> ir.Sort:
        partition, offset, rank = (), 0, ""
        while not self.ends():
            if self.take("desc"):
                desc = not desc
            elif self.take("asc"):
                pass
            elif self.take("partition"):
                self.need("by")
                partition = self.fields(False)
            elif self.take("offset"):
                offset = self.count()
            elif self.take("limit"):
                limit = self.count()
            elif self.take("rank"):
                rank = self.rank()
            else:
                raise self.error("unexpected word in sort")
        if partition and limit is None:
            raise self.error("partition by needs a limit")
        return ir.Sort(by, desc, partition, offset, limit, rank)

    def sort(self) -> ir.Pipe:
        self.take("by")
        return self.sort_tail(self.sort_keys() if self.is_("(") else (), False, None)

    def first_last(self, last: bool) -> ir.Pipe:
        n = 1 if self.ends() or self.is_("by", "(", "partition", "rank") else self.count()
        self.take("by")
        return self.sort_tail(self.sort_keys() if self.is_("(") else (), last, n)

    def uniq(self) -> ir.Pipe:
        by = ()
        if self.take("by") or self.is_("("):
            by = self.fields(False)
        hits, limit = "", 0
        while not self.ends():
            if self.take("with"):
                self.need("hits")
                hits = self.field() if self.take("as") else free("hits", by)
            elif self.take("hits"):
                hits = self.field() if self.take("as") else free("hits", by)
            elif self.take("limit"):
                limit = self.count()
            elif not by:
                by = self.fields(False)
            else:
                raise self.error("unexpected word in uniq")
        return ir.Uniq(tuple(dict.fromkeys(by)), hits, limit)

    def top(self) -> ir.Pipe:
        n = 10
        if not self.ends() and not self.is_("by", "(", "hits", "rank") and literals.plain_number(self.t.text) is not None:
            n = self.count()
        by = ()
        if self.take("by") or self.is_("("):
            by = self.fields(False)
        hits, rank = free("hits", by), ""
        while not self.ends():
            if self.take("hits"):
                self.take("as")
                hits = self.field()
            elif self.take("rank"):
                self.take("as")
                rank = free("rank", by) if self.ends() or self.is_("hits") else self.field()
            elif not by:
                by = self.fields(False)
                hits = free("hits", by)
            else:
                raise self.error("unexpected word in top")
        return ir.Top(n, tuple(dict.fromkeys(by)), hits, rank)

    def facets(self) -> ir.Pipe:
        at = {}
        if not self.ends() and literals.plain_number(self.t.text) is not None:
            at["n"] = self.count()
        while not self.ends():
            if self.take("max_values_per_field"):
                at["max_values"] = self.count()
            elif self.take("max_value_len"):
                at["max_len"] = self.count()
            elif self.take("keep_const_fields"):
                at["keep_const"] = True
            else:
                raise self.error("unexpected word in facets")
        return ir.Facets(**at)

    def field_values(self) -> ir.Pipe:
        of = self.fields(False)
        if len(of) != 1:
            raise self.error("field_values takes one field")
        return ir.FieldValues(of[0], self.count() if self.take("limit") else 0)

    def join(self) -> ir.Pipe:
        self.need("by", "on")
        by = self.fields(False)
        q = self.subquery()
        inner, prefix = False, ""
        while not self.ends():
            if self.take("inner"):
                inner = True
            elif self.take("prefix"):
                prefix = self.compound()
            else:
                raise self.error("unexpected word in join")
        return ir.Join(by, q, inner, prefix)

    def stream_context(self) -> ir.Pipe:
        at = {}
        while not self.ends():
            if self.take("before"):
                at["before"] = self.count()
            elif self.take("after"):
                at["after"] = self.count()
            elif self.take("time_window"):
                at["window"] = literals.duration_us(self.compound())
                if at["window"] <= 0:
                    raise self.error("time_window must be positive")
            else:
                raise self.error("unexpected word in stream_context")
        return ir.StreamContext(**at)

    def stats(self) -> ir.Stats:
        by: tuple[ir.GroupKey, ...] = ()
        if self.take("by") or self.is_("("):
            by = self.group_keys()
        funcs = [self.stats_func()]
        while self.take(","):
            funcs.append(self.stats_func())
        seen = {k.field for k in by}
        for f in funcs:
            if f.result in seen:
                raise self.error(f"result {f.result!r} is there twice")
            seen.add(f.result)
        return ir.Stats(by, tuple(funcs))

    def group_keys(self) -> tuple[ir.GroupKey, ...]:
        out = []
        self.need("(")
        while not self.take(")"):
            f = self.field()
            bucket = self.compound(SPAN_STOPS | {":"}) if self.take(":") else ""
            offset = self.compound(SPAN_STOPS) if self.take("offset") else ""
            out.append(ir.GroupKey(f, bucket, offset))
            if not self.is_(")"):
                self.need(",")
        return tuple(out)

    def stats_func(self) -> ir.StatsFunc:
        kind = self.t.low()
        if kind not in ir.STATS_FUNCS:
            raise self.error("expected a stats function")
        self.i += 1
        self.need("(")
        phi, args = 0.5, []
        if kind == "quantile":
            phi = literals.plain_number(self.compound()) if not self.is_(")") else None
            if phi is None or not 0 <= phi <= 1:
                raise self.error("quantile takes a number from 0 to 1")
            if not self.is_(")"):
                self.need(",")
        while not self.take(")"):
            args.append(self.field_or_wildcard())
            if not self.is_(")"):
                self.need(",")
        if kind in ("row_min", "row_max") and not args or kind == "histogram" and len(args) != 1:
            raise self.error(f"{kind} needs a field")
        limit = self.count() if kind in ("count_uniq", "count_uniq_hash", "uniq_values", "values", "json_values") and self.take("limit") else 0
        f = ir.StatsFunc(kind, tuple(args) or (ir.ALL,), "", None, limit, phi)
        iff = self.iff()
        name = f.call()
        if iff is not None:
            name += ir.cond(iff)
        if self.take("as"):
            name = self.field()
        elif not self.ends() and not self.is_(","):
            name = self.field()
        return ir.StatsFunc(kind, f.args, name, iff, limit, phi)

    # ------------------------------------------------------------ math

    def math(self) -> ir.Pipe:
        out = []
        while True:
            e = self.math_expr(7)
            if self.take("as") or not (self.ends() or self.is_(",")):
                r = self.field()
            else:
                r = str(e)
            out.append((e, r))
            if not self.take(","):
                return ir.Math(tuple(out))

    def math_expr(self, rank: int) -> ir.MathExpr:
        if rank == 0:
            return self.math_atom()
        left = self.math_expr(rank - 1)
        while not self.done() and not self.t.quoted and ir.MATH_RANK.get(self.t.low()) == rank:
            op = self.t.low()
            self.i += 1
            left = ir.MathExpr(op, (left, self.math_expr(rank - 1)))
        return left

    def math_atom(self) -> ir.MathExpr:
        if self.take("("):
            e = self.math_expr(7)
            self.need(")")
            return e
        if self.is_("-", "+"):
            op = self.t.text
            self.i += 1
            e = self.math_atom()
            return ir.MathExpr("-", (e,)) if op == "-" else e
        word = self.t.low()
        if word in MATH_FUNCS and self.ahead().text == "(":
            self.i += 2
            args = []
            while not self.take(")"):
                args.append(self.math_expr(7))
                if not self.is_(")"):
                    self.need(",")
            n = MATH_FUNCS[word]
            if isinstance(n, int) and len(args) != n or isinstance(n, tuple) and len(args) not in n or n is None and len(args) < 1:
                raise self.error(f"wrong number of arguments of {word}")
            return ir.MathExpr(word, tuple(args))
        quoted = self.t.quoted
        first = self.t.text
        date = not quoted and re.match(r"\d{4}$", first) and self.ahead().text == "-" and not self.ahead().gap
        text = self.compound(SPAN_STOPS) if date and re.match(r"\d{4}-\d\d-\d\d", self.text[self.t.at :]) else self.compound(STOPS | set("+-*/%^&"))
        if quoted and literals.number(text) is not None:
            return ir.MathExpr("num", (), text)
        if not quoted and (first[:1].isdigit() or first[:1] == "." or first.lower() in ("inf", "nan")):
            if literals.number(text) is None:
                raise self.error(f"{text!r} isn't a number")
            return ir.MathExpr("num", (), text)
        return ir.MathExpr("field", (), text)


def free(name: str, taken) -> str:
    while name in taken:
        name += "s"
    return name


def checked_regexp(pattern: str) -> str:
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z_])", r"(?P<\1", re.sub(r"\\[pP](\{[^}]*\}|\w)", r"\\w", pattern)).replace(r"\z", r"\Z"))
    except re.error as e:
        raise QueryError(f"bad regular expression {pattern!r}: {e}") from None
    return pattern


def values_field(q: ir.Query) -> str:
    """The one field that a subquery of in() and the like gives."""
    last = q.pipes[-1] if q.pipes else None
    if isinstance(last, ir.Fields) and len(last.of) == 1 and not last.of[0].endswith("*"):
        return last.of[0]
    if isinstance(last, ir.Uniq) and len(last.by) == 1:
        return last.by[0]
    if isinstance(last, ir.FieldValues):
        return last.of
    raise QueryError("a subquery for values must end in fields or uniq by one field")


def _aliases(names: str, f) -> dict:
    return dict.fromkeys(names.split(), f)


PIPES = {
    **_aliases("fields keep", lambda p: ir.Fields(p.fields())),
    **_aliases("delete del rm drop", lambda p: ir.Delete(p.fields())),
    **_aliases("copy cp", lambda p: ir.Copy(p.pairs())),
    **_aliases("rename mv", lambda p: ir.Copy(p.pairs(), True)),
    "drop_empty_fields": lambda p: ir.DropEmptyFields(),
    "field_names": lambda p: ir.FieldNames(p.result("name")),
    "pack_json": lambda p: p.pack("json"),
    "pack_logfmt": lambda p: p.pack("logfmt"),
    **_aliases("filter where", lambda p: ir.Where(p.filter())),
    "extract": lambda p: p.extract(False),
    "extract_regexp": lambda p: p.extract(True),
    "format": lambda p: p.format(),
    **_aliases("math eval", lambda p: p.math()),
    "replace": lambda p: p.replace(False),
    "replace_regexp": lambda p: p.replace(True),
    "collapse_nums": lambda p: p.collapse(),
    "decolorize": lambda p: ir.Decolorize(p.field() if not p.ends() else ir.MSG),
    "hash": lambda p: p.field_function("hash"),
    "len": lambda p: p.field_function("len"),
    "json_array_len": lambda p: p.field_function("json_array_len"),
    "unpack_json": lambda p: p.unpack("json"),
    "unpack_logfmt": lambda p: p.unpack("logfmt"),
    "unpack_syslog": lambda p: p.unpack("syslog"),
    "unpack_words": lambda p: p.unpack_words(),
    "unroll": lambda p: p.unroll(),
    "sample": lambda p: ir.Sample(p.count()),
    **_aliases("sort order", lambda p: p.sort()),
    "first": lambda p: p.first_last(False),
    "last": lambda p: p.first_last(True),
    **_aliases("limit head", lambda p: ir.Limit(10 if p.ends() else p.count())),
    **_aliases("offset skip", lambda p: ir.Offset(p.count())),
    "uniq": lambda p: p.uniq(),
    "top": lambda p: p.top(),
    "facets": lambda p: p.facets(),
    "field_values": lambda p: p.field_values(),
    "stats": lambda p: p.stats(),
    "join": lambda p: p.join(),
    "union": lambda p: ir.Union(p.subquery()),
    "stream_context": lambda p: p.stream_context(),
    "block_stats": lambda p: ir.BlockStats(),
    "blocks_count": lambda p: ir.BlocksCount(p.result("blocks_count")),
}
