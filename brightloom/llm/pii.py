r"""Personal data: expressions propose spans, checksums confirm them, context words move the score.

All of it is Spark SQL expressions over one row: no shuffle, no Python. The expressions are
written to run in linear time on any text (possessive runs, anchored at the start of a run), and
give the same leftmost non-overlapping matches as the plain forms in the module's fixed values.

Defined results: null and empty texts have no spans; repeated rows give repeated results; further
columns of the input are left alone (``find``) or kept, whatever their names (``redact``); a null id
stays null. Work grows with the text and its spans, also where a text has very many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.llm.common import packed, unpacked

# Kinds in their listed order, with the expression that proposes spans.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32,64}+"
IP_RANGE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
SSN_RANGE = r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
CONTEXT_BEFORE, CONTEXT_AFTER = 40, 20
CONTEXT = {
    "email": "mail|contact|write to",
    "ip": r"\bip\b|address|server|host",
    "card": "card|visa|master|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account",
    "ssn": "ssn|social security|tax id",
    "secret": "token|secret|passw|api|key|credential",
}


@dataclass(frozen=True)
class Kind:
    """A kind of span; ``score`` before context, ``boost`` with a context word near it."""

    name: str
    pattern: str
    needs: str  # a cheap expression that any text with a span contains
    score: float
    boost: float
    base: bool


KINDS = (
    Kind("email", EMAIL, "@", 0.9, 0.1, True),
    Kind("ip", IP, ".", 0.6, 0.3, True),
    Kind("card", CARD, "", 0.8, 0.2, True),
    Kind("phone", PHONE, "+", 0.6, 0.3, True),
    Kind("iban", IBAN, "", 0.7, 0.2, False),
    Kind("ssn", SSN, "-", 0.4, 0.4, False),
    Kind("secret", SECRET, "", 0.3, 0.5, False),
)
#: Added kinds are reported from this score on; base kinds always.
THRESHOLD = 0.5
_BLOCK = 256
_FOUND = "array<struct<s:int,e:int,m:string,ctx:string,around:string>>"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where the digits pass the Luhn check."""
    values = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """True where an IBAN's rearranged digits leave 1 on division by 97 (letters count 10 to 35)."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (rest * 10 + (code - 48)) % 97).otherwise((rest * 100 + (code - 55)) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def _valid(kind: str, x: Column) -> Column:
    m = x["m"]
    alone = ~x["around"].rlike("[A-Za-z0-9]")
    if kind == "ip":
        return m.rlike(IP_RANGE)
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return alone & mod97(m)
    if kind == "ssn":
        return alone & m.rlike(SSN_RANGE)
    if kind == "secret":
        return ~x["around"].rlike("[A-Za-z0-9_-]") & m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    return F.lit(True)


def _parts(matches: Column, gaps: Column) -> Column:
    """Each match with the length of the gap before it and the text around it."""
    return F.transform(
        matches,
        lambda m, i: F.struct(
            F.length(F.get(gaps, i)).alias("gap"),
            F.length(m).alias("len"),
            m.alias("m"),
            F.lower(F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT_BEFORE)), F.lit(" "), F.left(F.get(gaps, i + 1), F.lit(CONTEXT_AFTER)))).alias("ctx"),
            F.concat(F.right(F.get(gaps, i), F.lit(1)), F.left(F.get(gaps, i + 1), F.lit(1))).alias("around"),
        ),
    )


def _located(parts: Column) -> Column:
    """Start and end of each match in code points. Running sums go block by block, so that a text
    with very many matches costs n * sqrt(n) at most, not n squared."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(parts, b * _BLOCK + 1, F.lit(_BLOCK)),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    starts = F.aggregate(
        sums,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"]).alias("all")),
        lambda a: a["all"],
    )

    def within(block: Column, start: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(start.alias("at"), F.array().cast(_FOUND).alias("all")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + x["len"]).alias("at"),
                F.array_append(
                    a["all"],
                    F.struct((a["at"] + x["gap"]).alias("s"), (a["at"] + x["gap"] + x["len"]).alias("e"), x["m"].alias("m"), x["ctx"].alias("ctx"), x["around"].alias("around")),
                ).alias("all"),
            ),
            lambda a: a["all"],
        )

    return F.flatten(F.zip_with(blocks, starts, within))


def _prefilter(kind: Kind, text: Column) -> Column:
    some = F.contains(text, F.lit(kind.needs)) if kind.needs else F.lit(True)
    return some & text.rlike(kind.pattern if kind.name != "card" else r"[0-9](?:[\x20-]?[0-9]){11}")


def _scored(kind: Kind, k: int, placed: Column) -> Column:
    """Those of the placed matches that the kind's validator accepts, with their scores."""

    def score(x: Column) -> Column:
        near = F.when(x["ctx"].rlike(CONTEXT[kind.name]), F.lit(kind.boost)).otherwise(F.lit(0.0))
        return F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), F.lit(kind.name).alias("kind"), (F.lit(kind.score) + near).alias("score"))

    scored = F.transform(F.filter(placed, lambda x: _valid(kind.name, x)), score)
    return scored if kind.base else F.filter(scored, lambda x: x["score"] >= THRESHOLD)


def with_spans(texts: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``texts`` (text, ...), and ``spans``, an array of (s, k, e, kind, score) of
    every accepted span, by start, then kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    steps = texts
    for kind in KINDS:
        some = _prefilter(kind, t)
        steps = steps.withColumn(f"m_{kind.name}", F.when(some, F.regexp_extract_all(t, F.lit(kind.pattern), F.lit(0))))
        steps = steps.withColumn(f"g_{kind.name}", F.when(F.size(f"m_{kind.name}") > 0, F.split(t, kind.pattern, -1)))
        steps = steps.withColumn(f"p_{kind.name}", F.when(F.size(f"m_{kind.name}") > 0, _parts(F.col(f"m_{kind.name}"), F.col(f"g_{kind.name}"))))
    found = []
    for k, kind in enumerate(KINDS):
        placed = F.when(F.size(f"p_{kind.name}") > 0, _located(F.col(f"p_{kind.name}")))
        scored = _scored(kind, k, placed)
        found.append(F.coalesce(scored, F.array().cast("array<struct<s:int,k:int,e:int,kind:string,score:double>>")))
    return steps.select(*keep, F.array_sort(F.concat(*found)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Counts, digest, spans and their scores of every document (doc_id, text): one row per input row."""
    spans = F.col("spans")
    count = lambda name: F.size(F.filter(spans, lambda x: x["kind"] == name)).cast("long")
    base = F.filter(spans, lambda x: x["k"] < 4)
    return with_spans(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id"]).select(
        "doc_id",
        *(count(kind.name).alias(f"n_{kind.name}") for kind in KINDS if kind.base),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda x: F.format_string("%.1f", x["score"])), ",").alias("scores"),
        F.size(F.filter(spans, lambda x: x["score"] >= 0.85)).cast("long").alias("n_strong"),
    )


def _ends_before(spans: Column) -> Column:
    """For each span the greatest end of the spans before it; 0 for the first. Block by block, as in
    ``_located``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / _BLOCK).cast("int")), lambda b: F.slice(spans, b * _BLOCK + 1, F.lit(_BLOCK)))

    def running(ends: Column, first: Column) -> Column:
        return F.aggregate(
            ends,
            F.struct(first.alias("top"), F.array().cast("array<int>").alias("all")),
            lambda a, e: F.struct(F.greatest(a["top"], e).alias("top"), F.array_append(a["all"], a["top"]).alias("all")),
            lambda a: a["all"],
        )

    starts = running(F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda x: x["e"]))), F.lit(0))
    return F.flatten(F.zip_with(blocks, starts, lambda b, top: running(F.transform(b, lambda x: x["e"]), top)))


def redacted(text: Column, chunks: Column, spans: Column, before: Column) -> Column:
    """``text`` with each span replaced by its kind. ``chunks`` are its runs of ``_BLOCK`` code points, so
    that cutting a piece out never walks the text from its start."""

    def piece(a: Column, b: Column) -> Column:
        first, last = F.floor(a / _BLOCK).cast("int"), F.floor(b / _BLOCK).cast("int")
        head = F.coalesce(F.get(chunks, first), F.lit(""))
        tail = F.substring(F.coalesce(F.get(chunks, last), F.lit("")), F.lit(1), b % _BLOCK)
        across = F.concat(F.substring(head, a % _BLOCK + 1, F.lit(_BLOCK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
        return F.when(first == last, F.substring(head, a % _BLOCK + 1, b - a)).otherwise(across)

    replaced = F.zip_with(spans, before, lambda x, m: F.when(x["s"] >= m, F.concat(piece(m, x["s"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise(F.lit("")))
    end = F.array_max(F.transform(spans, lambda x: x["e"]))
    return F.concat(F.array_join(replaced, ""), piece(end, F.length(text)))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets. Overlapping spans
    become one, named after the first. ``n_chars``, if there, is counted anew where the text changed."""
    some = F.size("spans") > 0
    apart = docs.select(packed(docs, "text").alias("row"), F.col("text").cast("string").alias("text"))
    cut = with_spans(apart, ["row", "text"]).select(
        "*",
        F.when(some, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))).alias("chunks"),
        F.when(some, _ends_before(F.col("spans"))).alias("before"),
    )
    text = F.when(some, redacted(F.col("text"), F.col("chunks"), F.col("spans"), F.col("before"))).otherwise(F.col("text"))
    out = cut.select("row", some.alias("changed"), text.alias("text"))
    instead = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*unpacked(docs, "row", **instead))
