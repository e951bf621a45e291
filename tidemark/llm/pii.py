"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Column expressions only; there is no Python, Arrow or RDD code on this path and no shuffle: every row is
worked on where it is read. A NULL text is an empty one; repeated rows give repeated results; other columns
of the input are carried (`redact`) or left out (`find`), never looked at.

Very long texts with very many spans: places are running sums over pieces, taken in about sqrt(n) chunks, and what
stands near a span is cut from the text's segments of SEGMENT code points, so no step goes over the text once a span.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: a text without a match of this has no span of the kind
    hint: str
    base_score: float
    #: words that raise and lower the score when they stand near
    raising: str
    lowering: str = ""


# Possessive quantifiers and the guards in front change no match: they stop the engine from trying every
# suffix of a run again, and from recursing once for every digit of a long number.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9]\\.[0-9]", 0.6, r"\bip\b|server|host|addr|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "[0-9][\\x20-]?[0-9]", 0.8, "card|visa|master|credit|karte|tarjeta|carte", "order|isbn|serial"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", 0.7, r"phone|tel|call|mobile|fax|whatsapp"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z][0-9][0-9]", 0.9, "iban|bank|account|konto|cuenta|compte"),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_CHARS = 40
SEGMENT = 1024
#: the largest part of an address, the digits of a card and of a phone number
MAX_OCTET, CARD_DIGITS, PHONE_DIGITS = 255, (13, 19), (9, 15)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn sum."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 when read as ISO 7064 mod 97-10 asks."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))

    def step(rest, i):
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _octets_ok(value: Column) -> Column:
    def fits(part):
        short = F.regexp_replace(part, "^0+(?=.)", "")
        return F.when(F.length(short) > 3, F.lit(False)).otherwise(short.cast("int") <= MAX_OCTET)

    return F.forall(F.split(value, r"\.", -1), fits)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _octets_ok(value)
    if kind == "card":
        lo, hi = CARD_DIGITS
        digits = _digits(value)
        # at most one separator stands between two digits, so longer strings have too many digits
        return F.when(F.length(value).between(lo, 2 * hi - 1) & F.length(digits).between(lo, hi), luhn_ok(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(*PHONE_DIGITS)
    if kind == "iban":
        account = F.regexp_replace(value, " ", "")
        return F.when(F.length(account).between(15, 34), mod97_ok(account)).otherwise(False)
    return F.lit(True)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, also where `use` names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of some whole numbers what `merge` makes of 0 and all before it; one more entry has that of all."""
    empty = F.expr("cast(array() as array<int>)")

    def running(chunk, first):
        start = F.struct(first.alias("at"), empty.alias("out"))
        return F.aggregate(chunk, start, lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def chunked(held):
        size = F.ceil(F.sqrt(F.size(held))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(held) / size).cast("int") - 1), lambda k: F.slice(held, k * size + 1, size))

    def joined(chunks):
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), merge))
        return _let(running(totals, F.lit(0)), lambda firsts: F.flatten(F.transform(chunks, lambda c, k: running(c, F.get(firsts, k)))))

    # a last 0 asks for one entry more
    return _let(F.array_append(values, F.lit(0)), lambda held: _let(chunked(held), joined))


def _placed(matches: Column, pieces: Column) -> Column:
    """The matches with their places, from the text between them: array<struct<value, start, end>> in code points."""

    def place(m):
        def with_pieces(p):
            steps = F.zip_with(F.slice(p, F.lit(1), F.size(m)), m, lambda piece, value: F.length(piece) + F.length(value))

            def out(ends):
                return F.transform(m, lambda value, k: F.struct(value.alias("value"), (F.get(ends, k + 1) - F.length(value)).alias("start"), F.get(ends, k + 1).alias("end")))

            return _let(_before(steps, lambda a, b: a + b), out)

        return _let(pieces, with_pieces)

    return _let(matches, place)


def _segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def _cut(segments: Column, begin: Column, end: Column) -> Column:
    """The text between two places, from the segments that it touches."""
    first = F.floor(begin / SEGMENT).cast("int")
    parts = F.slice(segments, first + 1, F.floor(end / SEGMENT).cast("int") - first + 1)
    return F.when(end > begin, F.substring(F.array_join(parts, ""), begin - first * SEGMENT + 1, end - begin)).otherwise(F.lit(""))


def _scored(segments: Column, kind: Kind, placed: Column) -> Column:
    """Confirmed spans with their scores: array<struct<kind, start, end, value, score>>."""

    def score(x):
        begin = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        near = F.lower(F.concat(_cut(segments, begin, x["start"]), F.lit(" "), _cut(segments, x["end"], x["end"] + CONTEXT_CHARS)))
        value = F.lit(kind.base_score) + F.when(near.rlike(kind.raising), 0.1 + (0.9 - kind.base_score) / 2).otherwise(0.0)
        if kind.lowering:
            value = value - F.when(near.rlike(kind.lowering), 0.2).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.least(value, F.lit(1.0)).alias("score"))

    return F.transform(F.filter(placed, lambda x: _valid(kind.name, x["value"])), score)


_NONE = "cast(array() as array<struct<kind:string,start:int,end:int,value:string,score:double>>)"


def _with_spans(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """df with array column `out` of all spans, by kind as listed and then by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns]
    found = df.select(*kept, *(F.when(text.rlike(k.hint), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).alias(f"_m_{k.name}") for k in KINDS))
    spans = []
    for k in KINDS:
        m = F.col(f"_m_{k.name}")
        placed = _placed(m, F.split(text, k.pattern, -1))
        spans.append(F.when(F.size(m) > 0, _let(_segments(text), lambda segments: _scored(segments, k, placed))).otherwise(F.expr(_NONE)))  # noqa: B023
    return found.select(*kept, F.concat(*spans).alias(out))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and `spans`, an array of struct(kind, start, end, value, score)."""
    return _with_spans(docs.select(F.col(id_col), F.col(text_col).alias("_text")), "_text", "spans").drop("_text")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text, and the largest score."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col(id_col),
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(spans).alias("spans"),
        count("iban").alias("n_iban"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def redact(docs: DataFrame, text_col: str = "text", least_score: float = 0.0) -> DataFrame:
    """docs, all columns and rows kept, with every span of at least `least_score` replaced by <KIND>.

    Spans that overlap become one mark, that of the one that begins first (of the longest where several begin there).
    A NULL text stays NULL.
    """
    # the row travels as one value, so no column of it can be taken for one of ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("text"))
    marked = _with_spans(rows, "text", "spans")
    text = F.col("text")
    # sorted by start, longest first
    order = F.array_sort(F.transform(F.filter("spans", lambda s: s["score"] >= least_score), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

    def marks(segments):
        def joined(spans):
            def with_reach(reach):
                # reach: how far the spans before one go; one that begins within them gets no mark of its own
                def part(s, k):
                    mark = F.concat(_cut(segments, F.get(reach, k), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
                    return F.when(s["start"] >= F.get(reach, k), mark).otherwise(F.lit(""))

                return F.concat(F.array_join(F.transform(spans, part), ""), _cut(segments, F.element_at(reach, -1), F.length(text)))

            return _let(_before(F.transform(spans, lambda s: -s["end"]), lambda a, b: F.greatest(a, b)), with_reach)

        return _let(order, joined)

    clean = _let(_segments(text), marks)
    return marked.select(*(F.when(F.size("spans") > 0, clean).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
