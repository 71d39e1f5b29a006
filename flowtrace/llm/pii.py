"""Personal data: proposed by regular expressions, confirmed by checksums and
ranges, scored with nearby context words. DataFrame functions only; every row
is handled where it is read, nothing is shuffled.

The base spans follow plain rules (leftmost, non-overlapping, a failing match
is dropped). The method adds what those rules lose: cards and phone numbers
that stand next to other digits, IBANs (mod 97) and social security numbers
(only with a context word).

Patterns are written so that they find what the plain ones find without
backtracking over long runs: a run is entered at its start only and taken
whole (possessive), which also bounds the matcher's stack.

Defined results: a null or empty text has no spans; rows that repeat a
doc_id, or have none, each give their own row; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowtrace.llm.tables import table

#: Kinds in the order in which spans are listed.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]

#: Words that raise the score of a kind when they stand just before a span.
CONTEXT = {
    "email": "mail|contact|write", "ip": "ip|host|address|server",
    "card": "card|visa|credit|payment|amex", "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto", "ssn": "ssn|social|security",
}
CONTEXT_CHARS, CONTEXT_GAIN, THRESHOLD = 40, 0.3, 0.5


class Rule(NamedTuple):
    name: str
    kind: str
    base: bool
    pattern: str
    hint: str  # a text without it has no match; "" for none
    score: float  # of a confirmed span without context


RULES = [
    Rule("email", "email", True,
         r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9),
    Rule("ip", "ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7),
    Rule("card", "card", True,
         r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])", "", 0.8),
    Rule("phone", "phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7),
    Rule("card_inside", "card", False,
         r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])", "", 0.8),
    Rule("phone_inside", "phone", False,
         r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
         "+", 0.7),
    Rule("iban", "iban", False,
         r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
         "", 0.9),
    Rule("ssn", "ssn", False, r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3),
]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(m: Column) -> Column:
    """An IBAN's check: the first four signs moved behind, letters as 10 to
    35, read as a number."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    signs = F.filter(F.split(moved, ""), lambda c: c != "")

    def step(rest, c):
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value < 10, 10).otherwise(100) + value) % 97

    return F.aggregate(signs, F.lit(0), step) == 1


def _confirmed(rule: Rule, m: Column) -> Column:
    if rule.kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if rule.kind == "card":
        return F.call_function("luhn_check", _digits(m))
    if rule.kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if rule.kind == "iban":
        return _mod97(m)
    return F.lit(True)


def _prefix(lengths: Column) -> Column:
    """Sum of the entries before each one, in one pass over a short array."""
    zero = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
    return F.aggregate(
        lengths, zero,
        lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"),
                                (acc["sum"] + x).alias("sum")))["out"]


def _prefix_sums(lengths: Column) -> Column:
    """As :func:`_prefix`, by blocks of about the root of the length, so that
    a text with very many matches doesn't cost its square."""
    block = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, block),
                         lambda i: F.slice(lengths, i + 1, block))
    bases = _prefix(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x)))
    return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(_prefix(b), lambda x: x + base)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest, spans): spans are structs (rank of the kind, start,
    stop, base, score), offsets in code points, ordered by kind and start;
    rest holds the other columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.lit(None).cast("string")
    df = docs.select("doc_id", text.alias("text"), rest.alias("rest"))
    names = [r.name for r in RULES]

    def when_hinted(rule, value):
        return value if not rule.hint else F.when(F.contains(F.col("text"), F.lit(rule.hint)), value)

    df = df.select("doc_id", "text", "rest", *(
        F.coalesce(when_hinted(r, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))),
                   F.array().cast("array<string>")).alias(f"m_{r.name}") for r in RULES))
    # What stands between the matches gives their places.
    df = df.select("doc_id", "text", "rest", *(f"m_{n}" for n in names), *(
        F.when(F.size(f"m_{r.name}") > 0, F.slice(F.split("text", r.pattern, -1), F.lit(1),
                                                  F.size(f"m_{r.name}"))).alias(f"g_{r.name}")
        for r in RULES))
    df = df.select("doc_id", "text", "rest", *(f"m_{n}" for n in names), *(f"g_{n}" for n in names), *(
        F.when(F.col(f"g_{n}").isNotNull(), F.get(F.transform(
            F.array(F.zip_with(f"g_{n}", f"m_{n}", lambda g, m: F.char_length(g) + F.char_length(m))),
            _prefix_sums), F.lit(0))).alias(f"b_{n}")
        for n in names))

    def spans(rule: Rule) -> Column:
        found = F.arrays_zip(f"m_{rule.name}", f"g_{rule.name}", f"b_{rule.name}")

        def span(x):
            m, g, base = (x[f"{p}_{rule.name}"] for p in "mgb")
            start = base + F.char_length(g)
            near = F.rlike(F.lower(F.right(g, F.lit(CONTEXT_CHARS))), F.lit(rf"\b(?:{CONTEXT[rule.kind]})"))
            score = F.lit(rule.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
            return F.struct(F.lit(KINDS.index(rule.kind)).alias("rank"), start.alias("start"),
                            (start + F.char_length(m)).alias("stop"), F.lit(rule.base).alias("base"),
                            score.alias("score"))

        good = F.filter(found, lambda x: _confirmed(rule, x[f"m_{rule.name}"]))
        none = F.array().cast("array<struct<rank:int,start:int,stop:int,base:boolean,score:double>>")
        return F.when(F.col(f"g_{rule.name}").isNotNull(), F.transform(good, span)).otherwise(none)

    base = F.concat(*(spans(r) for r in RULES if r.base))
    more = F.filter(F.concat(*(spans(r) for r in RULES if not r.base)), lambda x: x["score"] >= THRESHOLD)
    df = df.select("doc_id", "text", "rest", base.alias("found"), more.alias("more"))
    # A span that the base has already is not added again.
    new = F.filter("more", lambda x: ~F.exists("found", lambda y: (y["rank"] == x["rank"]) & (
        y["start"] == x["start"]) & (y["stop"] == x["stop"])))
    return df.select("doc_id", "text", "rest", F.array_sort(F.concat("found", new)).alias("spans"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["base"] & (x["rank"] == KINDS.index(kind)))).cast("long")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:4]),
                        F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(F.col("spans")).alias("spans"))


def redacted(found: DataFrame) -> DataFrame:
    """(doc_id, text, rest) with every span replaced by its kind in brackets;
    overlapping spans become one, named after the first."""
    kinds = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform("spans", lambda x: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), x["rank"].alias("rank"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        gap = F.substr(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], x["stop"]).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(gap, F.concat(
                F.lit("["), F.get(kinds, x["rank"]), F.lit("]"))))).otherwise(acc["parts"]).alias("parts"))

    done = F.aggregate(ordered, zero, step)
    clean = found.select("doc_id", "text", "rest", F.when(F.size("spans") > 0, done).alias("done"))
    return clean.select("doc_id", F.when(
        F.col("done").isNotNull(),
        F.concat(F.array_join("done.parts", ""), F.substr("text", F.col("done.at") + 1)))
        .otherwise(F.col("text")).alias("text"), "rest")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return report(find(table(spark, sf_dir, "documents")))
