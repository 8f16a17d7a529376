"""Personal data by boosted trees over candidate spans, in DataFrame functions only.

1. Rules find the base spans of each kind, leftmost and non-overlapping. Generators with high recall propose further
   spans (looser forms, parts of longer runs), which may overlap them and each other.
2. Every candidate becomes a pattern of yes/no features of its format and context. Candidates are counted by
   (kind, pattern, fold, coincides with a base span); the counts are at most 4 * 2 ** 10 * 4 rows however large the
   corpus is. On these, trees of depth two are boosted on the logistic loss: the rules supervise the trees, which
   judge candidates that the rules pass over (say the second of two card numbers that stand side by side).
3. On the counts of a fold kept apart, each kind gets the lowest threshold with the wanted precision; with too few
   counted candidates it gets none and adds nothing. The trees are evaluated as column expressions.

Base spans always stay. An accepted candidate is added unless it lies inside a base span. Texts are read once; what
later steps read is a written table of spans.

Patterns are written for linear matching: a run is entered only at its start or where the last match ended
(``\\G``), and loops are possessive, which changes no match.

Defined cases: null and empty texts have no spans; an empty table gives an empty result and no trees; repeated rows
are scanned like any other; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variascope.llm.io import written

KINDS = ("email", "ip", "card", "phone")

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@|\x20?[\[(]at[\])]\x20?)", r"(?:\.|\x20?[\[(]dot[\])]\x20?)"
_LOOSE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)*+",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20.-][0-9]{4}){3})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[\x20./-]{1,2}[(]?[0-9]{2,4}[)]?){2,5}(?![0-9A-Za-z])",
}
_GUARD = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20.-]?[0-9]", "phone": r"[0-9][\x20().+/0-9-]*[0-9]"}
_CONTEXT = {
    "email": "(?i)mail|contact|write|address|user",
    "ip": "(?i)\\bip|host|server|from|address|login",
    "card": "(?i)card|visa|pay|account|credit|iban",
    "phone": "(?i)phone|tel|call|mobile|fax|contact",
}
_SPANS = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _find(text: Column, pattern: str) -> Column:
    """All matches with their code point positions and 24 characters of context on both sides."""

    def place(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        pairs = F.arrays_zip(pieces.alias("gap"), F.concat(found, F.array(F.lit(""))).alias("hit"), F.concat(F.slice(pieces, 2, F.size(found)), F.array(F.lit(""))).alias("next"))

        def step(done: Column, pair: Column) -> Column:
            start = done["at"] + F.char_length(pair["gap"])
            end = start + F.char_length(pair["hit"])
            span = F.struct(
                start.alias("start"),
                end.alias("end"),
                pair["hit"].alias("text"),
                F.right(pair["gap"], F.lit(24)).alias("before"),
                F.left(pair["next"], F.lit(24)).alias("after"),
            )
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(span)).alias("out"))

        begin = F.struct(F.lit(0).alias("at"), _none().alias("out"))
        return F.aggregate(F.slice(pairs, 1, F.size(found)), begin, step, lambda done: done["out"])

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, _none()).otherwise(place(found)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string holds."""

    def add(total: Column, k: Column) -> Column:
        digit = F.substr(digits, F.char_length(digits) - k + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The further condition that a match of the kind's base pattern has to meet."""
    if kind == "email":
        return F.regexp_like(text, F.lit(rf"^{_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++$"))
    if kind == "ip":
        small = lambda p: _let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255))
        return F.forall(F.split(text, r"\."), small)
    if kind == "card":
        return _let(_digits(text), lambda d: F.char_length(d).between(13, 19) & luhn(d))
    return F.char_length(_digits(text)).between(9, 15)


def features(kind: str, span: Column) -> Column:
    """The candidate's pattern: one bit per yes/no feature of format and context."""
    text, before, after = span["text"], span["before"], span["after"]
    digits = F.char_length(_digits(text))
    own = {
        "email": [F.contains(text, F.lit("@")), F.regexp_like(text, F.lit(r"[.\]) ][A-Za-z]{2,6}$")), digits > 0],
        "ip": [F.char_length(text) >= 9, F.regexp_like(text, F.lit(r"^0|\.0[0-9]")), F.regexp_like(after, F.lit(r"^\.[0-9]"))],
        "card": [digits == 16, F.regexp_like(text, F.lit(r"[\x20.-]")), F.regexp_like(text, F.lit("^[3-6]"))],
        "phone": [F.startswith(text, F.lit("+")), F.regexp_like(text, F.lit(r"[()]")), digits >= 10],
    }[kind]
    shared = [
        valid(kind, text),
        (before == "") | F.regexp_like(before, F.lit(r"[\s:;,(<\[]$")),
        (after == "") | F.regexp_like(after, F.lit(r"^[\s;,)>\].!?#$%&*]")),
        F.regexp_like(before, F.lit("[A-Za-z0-9]$")) | F.regexp_like(after, F.lit("^[A-Za-z0-9]")),
        F.regexp_like(before, F.lit(_CONTEXT[kind])),
    ]
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate([*own, *shared])), F.lit(0))


FEATURES = 8


def spans(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """Written table: id, _fold, and per kind the base spans and the candidates (start, end, pattern, coincides)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    ready = docs.select(F.col(key).alias("_key"), whole.alias("_text"))

    def found(pattern, guard):
        return F.when(F.regexp_like("_text", F.lit(guard)), _find(F.col("_text"), pattern)).otherwise(_none())

    def column(kind: str) -> Column:
        base = F.filter(found(_BASE[kind], _GUARD[kind]), lambda s: valid(kind, s["text"]))

        def both(held: Column) -> Column:
            def candidate(s: Column) -> Column:
                same = F.exists(held, lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"]))
                inside = F.exists(held, lambda b: (b["start"] <= s["start"]) & (b["end"] >= s["end"]))
                pattern = features(kind, s)
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), pattern.alias("pattern"), same.alias("same"), inside.alias("inside"))

            return F.struct(
                F.transform(held, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"))).alias("base"),
                F.transform(found(_LOOSE[kind], _GUARD[kind]), candidate).alias("more"),
            )

        return _let(base, both).alias(kind)

    columns = [F.col("_key"), F.pmod(F.xxhash64("_key"), F.lit(4)).cast("int").alias("_fold"), *map(column, KINDS)]
    return written(ready.select(*columns), "spans")


def boost(counts: dict[int, tuple[float, float]], rounds: int = 24, rate: float = 0.4, l2: float = 1.0):
    """Trees of depth two on {pattern: (negatives, positives)}: (start, [(bit, {0: (bit, low, high), 1: ...})])."""
    negative, positive = (sum(c[k] for c in counts.values()) for k in (0, 1))
    start = math.log((positive + 1) / (negative + 1))
    margin = {p: start for p in counts}
    trees = []

    def best(patterns: list[int], grad: dict[int, float], hess: dict[int, float]):
        top = None
        for bit in range(FEATURES):
            g, h = [0.0, 0.0], [0.0, 0.0]
            for p in patterns:
                g[p >> bit & 1] += grad[p]
                h[p >> bit & 1] += hess[p]
            gain = sum(x * x / (y + l2) for x, y in zip(g, h))
            if top is None or gain > top[0] + 1e-12:
                top = (gain, bit, *(rate * x / (y + l2) for x, y in zip(g, h)))
        return top

    for _ in range(rounds):
        grad, hess = {}, {}
        for p, (n, y) in counts.items():
            q = 1 / (1 + math.exp(-margin[p]))
            grad[p], hess[p] = y - (n + y) * q, (n + y) * q * (1 - q)
        root = best(list(counts), grad, hess)[1]
        sides = {side: best([p for p in counts if p >> root & 1 == side], grad, hess)[1:] for side in (0, 1)}
        trees.append((root, sides))
        for p in margin:
            bit, low, high = sides[p >> root & 1]
            margin[p] += high if p >> bit & 1 else low
    return start, trees


def margin_of(model, pattern: int) -> float:
    start, trees = model
    for root, sides in trees:
        bit, low, high = sides[pattern >> root & 1]
        start += high if pattern >> bit & 1 else low
    return start


def margin_column(model, pattern: Column) -> Column:
    start, trees = model
    on = lambda bit: pattern.bitwiseAND(F.lit(1 << bit)) != 0
    leaf = lambda side: F.when(on(side[0]), F.lit(side[2])).otherwise(F.lit(side[1]))
    return sum((F.when(on(root), leaf(sides[1])).otherwise(leaf(sides[0])) for root, sides in trees), F.lit(start))


def train(found: DataFrame, *, precision: float, least: int) -> dict[str, tuple[tuple, float]]:
    """{kind: (trees, lowest accepted margin)} for the kinds with at least ``least`` candidates that are base spans."""
    rows = [
        found.select(F.lit(kind).alias("kind"), (F.col("_fold") == 0).alias("apart"), F.explode(f"{kind}.more").alias("c")) for kind in KINDS
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    counted = every.groupBy("kind", "apart", "c.pattern", "c.same").agg(F.count(F.lit(1)).alias("n"))
    tables = {(kind, apart): {} for kind in KINDS for apart in (False, True)}
    for r in counted.collect():  # at most one row per kind, fold, pattern and label
        cell = tables[r.kind, bool(r.apart)].setdefault(r.pattern, [0, 0])
        cell[int(r.same)] += r.n
    models = {}
    for kind in KINDS:
        learn, held = tables[kind, False], tables[kind, True]
        if sum(c[1] for c in learn.values()) < least or not held:
            continue
        model = boost({p: tuple(c) for p, c in learn.items()})
        ranked = sorted(((margin_of(model, p), c) for p, c in held.items()), key=lambda x: -x[0])
        cut, right, total = None, 0, 0
        for at, (value, (n, y)) in enumerate(ranked):
            right, total = right + y, total + n + y
            last = at + 1 == len(ranked) or ranked[at + 1][0] < value
            if last and right >= precision * total and value > 0:
                cut = value
        if cut is not None:
            models[kind] = (model, cut - 1e-9)
    return models


def redactions(docs: DataFrame, *, key: str = "doc_id", text: str = "text", precision: float = 0.9, least: int = 20) -> DataFrame:
    """id, per kind the base spans (``email`` ...), and ``spans``: all spans as (kind, start, end), base ones included."""
    found = spans(docs, key=key, text=text)
    models = train(found, precision=precision, least=least)
    def all_of(kind: str) -> Column:
        def named(s: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))

        base = F.transform(f"{kind}.base", named)
        if kind not in models:
            return base
        model, cut = models[kind]
        added = F.filter(f"{kind}.more", lambda s: ~s["inside"] & (margin_column(model, s["pattern"]) >= F.lit(cut)))
        return F.array_sort(F.array_distinct(F.concat(base, F.transform(added, named))))

    base = [F.col(f"{kind}.base").alias(f"_{kind}") for kind in KINDS]
    return found.select(F.col("_key").alias(key), *base, F.concat(*map(all_of, KINDS)).alias("spans")).withColumnsRenamed({f"_{k}": k for k in KINDS})


def redact(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; ids must be unique."""
    found = redactions(docs, key=key, text=text, **options).select(F.col(key), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"]))).alias("_spans"))

    def cut(done: Column, s: Column) -> Column:
        gap = F.substr(F.col(text), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        piece = F.when(s["start"] >= done["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.concat(done["out"], piece).alias("out"))

    whole = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda d: F.concat(d["out"], F.substring(F.col(text), d["at"] + 1, F.char_length(text))))
    joined = docs.join(found.where(F.size("_spans") > 0), key, "left")
    return joined.withColumn(text, F.when(F.col("_spans").isNull(), F.col(text)).otherwise(whole)).select(*[f"`{c}`" for c in docs.columns])
