"""Secrets in texts: fixed patterns, and windows of high Shannon entropy in long tokens. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import unused

# The three base kinds, in the order in which they are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy64", "entropy36", "entropy16")
#: Characters of tokens, and tokens in which entropy is measured: at least WINDOW characters, with a digit and a letter.
LETTER = r"[A-Za-z0-9+/_=-]"
TOKEN = rf"(?<!{LETTER})(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z]){LETTER}{{20,}}"
WINDOW = 20
#: Least bits a character in a window, by class: mixed case and digits, one case and digits, hexadecimal digits.
LEAST = {"entropy64": 3.7, "entropy36": 3.4, "entropy16": 3.0}
#: The allow-list. Whole tokens: UUIDs, and words, paths or versions joined by separators (see _joined_words). Stretches, which
#: are cut out of a token: documented sample keys with what surrounds them, dates, runs of one character, counted-up characters.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
SAMPLES = r"(?i:example|sample|dummy|placeholder|your[_-]?(?:key|token|secret))"
STRETCHES = (rf"{LETTER}{{0,40}}{SAMPLES}{LETTER}{{0,40}}", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|(.)\1{7,}|(?i:0123456789|abcdefghij|123456789)")
#: Elements over which running totals are built one by one; longer arrays go by blocks, so that the cost stays near linear.
BLOCK = 256
_SPAN = "array<struct<start:int,kind:int,end:int,first:int,last:int,text:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _before(items: Column, of: Callable, plus: Callable, zero: Column, kind: str) -> Column:
    """For each item the total, by plus, of what `of` gives for those before it."""

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK)))

    def running(x: Column, start: Column, of: Callable) -> Column:
        none = F.array().cast(f"array<{kind}>")
        step = lambda a, i: F.struct(plus(a["at"], of(i)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(x, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def over(b: Column) -> Column:
        total = lambda x: F.aggregate(x, zero, lambda a, i: plus(a, of(i)))
        return _let(running(F.transform(b, total), zero, lambda t: t), lambda starts: F.flatten(F.transform(b, lambda x, k: running(x, F.get(starts, k), of))))

    return F.when(F.size(items) > 0, _let(items, lambda x: _let(blocks(x), over))).otherwise(F.array().cast(f"array<{kind}>"))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """(gap, own, value) of each leftmost non-overlapping match: the text before it, the match, and a group of it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("own"), values.alias("value"))
    return F.filter(both, lambda m: m["own"].isNotNull())


def _spans(text: Column, pattern: str, kind: int, least: int = 0, group: int = 0) -> Column:
    """Matches as (start, kind, end, first, last, text): code points, then bytes, ends exclusive. The group must have `least` characters.

    The text between matches and the matches themselves, both in order, give all positions by running sums.
    """
    ends = lambda g, o: F.struct((F.length(g) + F.length(o)).alias("c"), (F.octet_length(g) + F.octet_length(o)).alias("b"))
    plus = lambda a, x: F.struct((a["c"] + x["c"]).alias("c"), (a["b"] + x["b"]).alias("b"))
    zero = F.struct(F.lit(0).alias("c"), F.lit(0).alias("b"))

    def placed(m: Column) -> Column:
        at = _before(m, lambda x: ends(x["gap"], x["own"]), plus, zero, "struct<c:int,b:int>")
        return F.zip_with(m, at, span)

    def span(m: Column, at: Column) -> Column:
        start, first = at["c"] + F.length(m["gap"]), at["b"] + F.octet_length(m["gap"])
        fields = {"start": start, "kind": F.lit(kind), "end": start + F.length(m["own"]), "first": first, "last": first + F.octet_length(m["own"])}
        return F.struct(*(c.alias(n) for n, c in fields.items()), F.when(F.length(m["value"]) >= least, m["own"]).alias("text"))

    found = F.filter(_let(_matches(text, pattern, group), placed), lambda s: s["text"].isNotNull()).cast(_SPAN)
    # The cheap test spares most texts the sums.
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _masked(text: Column, pattern: str, least: int = 0, group: int = 0) -> Column:
    """The text with a blank for each character of the matches."""
    blank = lambda m: F.when(F.length(m["value"]) >= least, F.repeat(F.lit(" "), F.length(m["own"]))).otherwise(m["own"])
    ends = F.element_at(F.split(text, pattern, -1), -1)
    out = F.concat(F.array_join(F.transform(_matches(text, pattern, group), lambda m: F.concat(m["gap"], blank(m))), ""), ends)
    return F.when(text.rlike(pattern), out).otherwise(text)


def _class(token: Column) -> Column:
    return F.when(token.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), 5).when(token.rlike(r"[a-z]") & token.rlike(r"[A-Z]"), 3).otherwise(4)


def _joined_words(token: Column) -> Column:
    """Whether the token is words in one case or short numbers, joined by separators, with at most 8 characters of any kind at its end.

    Parts are tested one by one: a repeated group would recurse once for each in the regular expression engine.
    """
    parts = F.split(token, "[-_/=+]+", -1)
    word = lambda p: p.rlike("^(?:[a-z]+|[A-Z]+|[0-9]{1,4})$")
    return (F.size(parts) > 1) & F.forall(F.slice(parts, 1, F.size(parts) - 1), word) & (F.length(F.element_at(parts, -1)) <= 8)


def _peak(token: Column, window: int) -> Column:
    """Where in the token windows of enough entropy start and end: (first, last end), or null.

    Counts of the window's characters go along with S = sum of c * log2(c); a step adds one character and
    drops one, which changes two of the terms. Entropy = log2(window) - S / window. The counts are a string of 128
    characters, the code of each being a count, and 1, so that a step replaces one character.
    """
    least = F.element_at(F.array(*(F.lit(LEAST[k]) for k in KINDS[3:])), _class(token) - 2)
    most = (F.lit(math.log2(window)) - least) * window  # of S
    term = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(0.0)
    count = lambda counts, code: F.ascii(F.substring(counts, code + 1, F.lit(1))) - 1
    put = lambda counts, code, n: F.overlay(counts, F.char(n + 1), code + 1, F.lit(1))

    def summed(letters: Column, most: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            return _let(F.ascii(F.get(letters, i)), lambda new: added(state, i, new))

        def added(state: Column, i: Column, new: Column) -> Column:
            return _let(count(state["counts"], new), lambda n: dropped(state, i, put(state["counts"], new, n + 1), state["s"] + term(n + 1) - term(n)))

        def dropped(state: Column, i: Column, counts: Column, s: Column) -> Column:
            old = F.ascii(F.get(letters, i - window))
            both = F.struct(counts.alias("counts"), s.alias("s"))
            less = lambda x: _let(count(x["counts"], old), lambda n: F.struct(put(x["counts"], old, n - 1).alias("counts"), (x["s"] - term(n) + term(n - 1)).alias("s")))
            return _let(F.when(i >= window, _let(both, less)).otherwise(both), lambda x: told(state, i, x))

        def told(state: Column, i: Column, x: Column) -> Column:
            # Sums of logarithms are exact to about 1e-13: a window at the very threshold counts.
            hit = (i + 1 >= window) & (x["s"] <= most + 1e-9)
            return F.struct(x["counts"].alias("counts"), x["s"].alias("s"), F.when(hit & state["first"].isNull(), i + 1 - window).otherwise(state["first"]).alias("first"), F.when(hit, i + 1).otherwise(state["last"]).alias("last"))

        none = F.lit(None).cast("int")
        start = F.struct(F.repeat(F.char(F.lit(1)), 128).alias("counts"), F.lit(0.0).alias("s"), none.alias("first"), none.alias("last"))
        ends = lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"].alias("first"), a["last"].alias("last")))
        return F.aggregate(F.sequence(F.lit(0), F.size(letters) - 1), start, step, ends)

    return _let(F.struct(F.split(token, "").alias("letters"), most.alias("most")), lambda x: summed(x["letters"], x["most"]))


def _entropic(tokens: Column, window: int) -> Column:
    """Spans of the windows of high entropy in tokens, without what the allow-list names."""

    def parts(token: Column) -> Column:
        rest = reduce(_masked, STRETCHES, token["text"])
        moved = lambda s: F.struct((s["start"] + token["start"]).alias("start"), s["kind"].alias("kind"), (s["end"] + token["start"]).alias("end"), (s["first"] + token["first"]).alias("first"), (s["last"] + token["first"]).alias("last"), s["text"].alias("text"))
        cut_out = F.transform(_spans(rest, TOKEN, 3), moved)
        return F.when(reduce(lambda a, p: a | token["text"].rlike(p), STRETCHES[1:], token["text"].rlike(SAMPLES)), cut_out).otherwise(F.array(token))

    free = F.filter(tokens, lambda t: ~t["text"].rlike(UUID) & ~_joined_words(t["text"]))
    peaks = F.transform(F.flatten(F.transform(free, parts)), lambda t: F.struct(t.alias("t"), _class(t["text"]).alias("kind"), _peak(t["text"], window).alias("peak")))
    ends = lambda p: {f"{n}": p["t"][of] + p["peak"][x] for n, of, x in (("start", "start", "first"), ("end", "start", "last"), ("first", "first", "first"), ("last", "first", "last"))}
    span = lambda p, e: F.struct(e["start"].alias("start"), p["kind"].alias("kind"), e["end"].alias("end"), e["first"].alias("first"), e["last"].alias("last"), F.lit("").alias("text"))
    return F.transform(F.filter(peaks, lambda p: p["peak"].isNotNull()), lambda p: span(p, ends(p)))


def _found(docs: DataFrame, text_col: str, into: str, window: int) -> DataFrame:
    """docs with all spans, in code points and in bytes."""
    text, base, tokens = F.coalesce(F.col(text_col).cast("string"), F.lit("")), unused(docs, "base"), unused(docs, "tokens")
    bare = lambda spans: F.transform(spans, lambda s: s.withField("text", F.lit("")))
    rest = _masked(_masked(_masked(text, ASSIGN, 8, 2), ACCESS), HEX)
    out = docs.withColumn(base, F.concat(*(bare(s) for s in (_spans(text, ASSIGN, 0, 8, 2), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))))
    out = out.withColumn(tokens, F.when(F.size(base) == 0, _spans(text, TOKEN, 3)).otherwise(_let(rest, lambda x: _spans(x, TOKEN, 3))))
    found = F.when(F.size(tokens) == 0, F.col(base)).otherwise(F.concat(F.col(base), _entropic(F.col(tokens), window).cast(_SPAN)))
    columns = [F.col(c) for c in docs.columns if c != into]
    return out.select(*columns, F.array_sort(found).alias(into))


def scan(docs: DataFrame, text_col: str = "text", into: str = "spans", window: int = WINDOW) -> DataFrame:
    """docs with a column of spans (start, kind, end), by start and then kind as listed; code points, end exclusive.

    Base kinds are matched leftmost without overlap, each kind by itself, then those too short are dropped.
    Entropy spans cover the windows of `window` characters of a long token whose entropy is high for its class. Base spans
    are cut out of the text first, and stretches on the allow-list out of its tokens; what is left is judged by itself. Base spans are never
    suppressed. Null and empty texts have no spans; an empty table gives an empty one; repeated rows get equal spans. Other columns
    stay, whatever their names; one of the same name as `into` is replaced. The cost grows with the text's length, whatever it holds.
    """
    found = _found(docs, text_col, into, window)
    return found.withColumn(into, F.transform(into, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each run of overlapping spans in the text replaced by the mark.

    Null texts stay null and empty ones empty; texts without spans, and all other columns, stay as they are.
    """
    spans, text = unused(docs, "spans"), F.col(text_col)
    found = _found(docs, text_col, spans, WINDOW)

    def clean(data: Column, ends: Column) -> Column:
        # `ends` has for each span where those before it end; one that starts earlier adds nothing but its end.
        between = F.zip_with(F.col(spans), ends, lambda s, at: F.when(s["first"] >= at, F.concat(F.substring(data, at + 1, s["first"] - at).cast("string"), F.lit(mark))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda s: s["last"]))
        return F.concat(F.array_join(between, ""), F.substring(data, last + 1, F.octet_length(data)).cast("string"))

    ends = _before(F.col(spans), lambda s: s["last"], lambda a, x: F.greatest(a, x), F.lit(0), "int")
    done = _let(F.struct(text.cast("binary").alias("data"), ends.alias("ends")), lambda x: clean(x["data"], x["ends"]))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).drop(spans)
