"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

One narrow pass in DataFrame operations, without a shuffle: a text's spans depend on that text alone, so any number of
tasks share the corpus evenly and a hot source or a group of copies costs no task more than its rows.

Patterns use possessive quantifiers, and start a match only where a run of its characters starts or the last match
ended. Neither changes a match (what follows a run is never in its class), and both keep the time linear on very long texts, as does `spans` with very many matches.

Defined results: null text is empty text and has no spans; a null id stays null. Spans of different kinds may overlap, and all are reported. Very long texts
are read whole. Repeated rows give repeated result rows. Other columns of the input,
whatever their names, are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.llm.common import text_or_empty
from wharfline.llm.spans import SPAN, chunks, cut, joined, let, matches, replaced, sha256_hex


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(found: Column) -> Column:
    """Luhn's checksum over the digits of found."""
    reverse = F.split(F.reverse(digits(found)), "")
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.get(F.array(*[F.lit(v // 10 + v % 10) for v in range(0, 20, 2)]), d.cast("int")))
    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97(found: Column) -> Column:
    """The account number check: the first four characters go last, letters count from 10 for A, the rest by 97 is 1."""
    plain = F.upper(F.regexp_replace(found, "[^A-Za-z0-9]", ""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def octets(found: Column) -> Column:
    """Each of the parts between dots is at most 255, whatever its leading zeros."""
    return F.forall(F.split(found, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$")))


def digit_count(found: Column, least: int, most: int) -> Column:
    return F.length(digits(found)).between(least, most)


@dataclass(frozen=True)
class Kind:
    """needs: what a text must hold for the pattern to be tried; check: confirms a span; words: context that raises its score;
    ahead: the span is group 1, in a lookahead."""

    kind: str
    pattern: str
    needs: str
    check: Callable[[Column], Column]
    words: str
    prior: float
    base: bool = False
    ahead: bool = False


#: The length of an account number by country, of the IBAN registry and of countries that use the format outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE GG IE IM JE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BF BI BL CF CG CM DJ FR GA GF GP GQ GR IT KM MC MF MG MQ NC PF PM RE SM TD TF WF YT",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG MR PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: The country sets where a number ends, so what follows it after a space never counts in.
IBAN = "|".join(rf"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, codes in IBAN_LENGTHS.items())

#: Fixed values. Base kinds come first and always count; others count from MIN_SCORE on.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", lambda s: F.lit(True), "mail|contact|write|kontakt|correo|courriel", 0.8, True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", octets, "ip|host|server|address|adresse", 0.6, True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", lambda s: F.when(digit_count(s, 13, 19), luhn(s)).otherwise(False), "card|visa|credit|payment|karte|carte|tarjeta", 0.6, True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", lambda s: digit_count(s, 9, 15), "phone|tel|call|mobile|fax|anruf", 0.6, True),
    Kind("iban", rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=({IBAN})(?![A-Za-z0-9]))[A-Z]{{2}}[0-9]{{2}}", "", mod97, "iban|account|bank|konto|compte|cuenta", 0.7, ahead=True),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", lambda s: F.lit(True), "ssn|social|security", 0.4),
)

MIN_SCORE = 0.6
CONTEXT = 40
NEARBY = 0.2


def detect(df: DataFrame, kinds: Sequence[Kind] = KINDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, spans): array of (kind, start, stop, found, score); positions in code points, score 0 to 1."""
    texts = df.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    empty = F.array().cast(SPAN)

    def spans(kind: Kind, pieces: Column) -> Column:
        text = F.col("text")
        every = matches(text, kind.pattern, kind.check, int(kind.ahead), kind.ahead)
        every = F.when(F.contains(text, F.lit(kind.needs)), every).otherwise(empty) if kind.needs else every

        def scored(s: Column) -> Column:
            before = cut(pieces, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"])
            around = F.lower(F.concat_ws(" ", before, cut(pieces, s["stop"], s["stop"] + CONTEXT)))
            near = F.regexp_like(around, F.lit(rf"\b(?:{kind.words})"))
            score = F.lit(kind.prior) + F.when(near, F.lit(NEARBY)).otherwise(F.lit(0.0))
            return F.struct(F.lit(kind.kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found"), F.round(score, 2).alias("score"))

        return F.transform(every, scored)

    always = [k.kind for k in kinds if k.base]
    kept = lambda s: s["kind"].isin(always) | (s["score"] >= MIN_SCORE)
    found = let(chunks(F.col("text")), lambda pieces: F.filter(F.concat(*[spans(k, pieces) for k in kinds]), kept))
    return texts.select(id_col, "text", found.alias("spans"))


def redact(detected: DataFrame, kinds: Sequence[Kind] = KINDS, id_col: str = "doc_id") -> DataFrame:
    """(id_col, text): what stands at each span replaced by its kind in angle brackets; of spans that overlap, the first by start, then kind as listed, names the whole."""
    names = F.array(*[F.lit(k.kind) for k in kinds])
    order = lambda s: F.struct(s["start"].alias("start"), F.array_position(names, s["kind"]).alias("place"))
    return detected.select(id_col, replaced(F.col("text"), F.col("spans"), lambda s: F.concat(F.lit("<"), s["kind"], F.lit(">")), order).alias("text"))


def digest(detected: DataFrame, kinds: Sequence[Kind] = KINDS, id_col: str = "doc_id") -> DataFrame:
    """Counts, hash of the base spans and all spans as text, by kind, then start."""
    names = F.array(*[F.lit(k.kind) for k in kinds])
    base = [k.kind for k in kinds if k.base]
    order = lambda s: F.struct(F.array_position(names, s["kind"]).alias("place"), s["start"].alias("start"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return detected.select(
        id_col,
        *[of(kind).alias(f"n_{kind}") for kind in base],
        sha256_hex(joined(F.filter("spans", lambda s: s["kind"].isin(base)), order)).alias("base_sha256"),
        joined(F.col("spans"), order).alias("spans"),
    )
