"""Redaction of personal data in a fixed order of stages, each counting on what the stages before it left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import let

#: Stages in order, their patterns and marks. Each stage's text is worked out once and bound before the next.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN = r"(?U)\bTR\d{2}(?:\s?\d{4}){5}\s?\d{2}\b|\bTR\d{24}\b"
UUID = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
IP = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
NATIONAL = r"(?U)\b\d{11}\b"
PHONE = r"(?U)(?<!\d)(?:\+90|0)?[\s\-]*\(?\d{3}\)?[\s\-]*\d{3}[\s\-]*\d{2}[\s\-]*\d{2}(?!\d)"
STAGES = (
    ("email", EMAIL, "[email_redacted]"),
    ("iban", IBAN, "[iban_redacted]"),
    ("uuid", UUID, "[ref_redacted]"),
    ("ip", IP, "[ip_redacted]"),
    ("tc", NATIONAL, "[id_redacted]"),
    ("phone", PHONE, "[phone_redacted]"),
)
#: What every match of a pattern holds: a fixed string, and whether a digit too. A text without them is not searched.
DIGIT = r"(?U)\d"
HOLDS = {EMAIL: ("@", False), IBAN: ("TR", True), UUID: ("-", False), IP: (".", True), NATIONAL: ("", True), PHONE: ("", True)}


def valid_national_id(c: Column) -> Column:
    """Eleven digits, the first not 0, the last two checksums of the others."""
    d = F.transform(F.split(c, ""), lambda x: F.try_to_number(x, F.lit("9")).cast("int"))
    at = lambda *i: sum((F.try_element_at(d, F.lit(k + 1)) for k in i[1:]), F.try_element_at(d, F.lit(i[0] + 1)))
    tenth = F.pmod(at(0, 2, 4, 6, 8) * 7 - at(1, 3, 5, 7), F.lit(10)) == at(9)
    eleventh = F.pmod(at(*range(10)), F.lit(10)) == at(10)
    return F.when(F.rlike(c, F.lit("^[1-9][0-9]{10}$")), tenth & eleventh).otherwise(F.lit(False))


def redact(text: Column, stages: tuple = STAGES) -> Column:
    """A struct of the redacted ``text`` and a count for each stage. A national id that fails its checksum is
    left as it is: its stage goes through the matches and the parts between them. No mark holds a digit, so a text without one stays so."""

    def chain(t: Column) -> Column:
        state = F.struct(t["text"].alias("text"))
        for i, (name, pattern, mark) in enumerate(stages):
            state = let(state, _stage([n for n, _, _ in stages[:i]], name, pattern, mark, t["digit"]))
        return state

    return let(let(F.coalesce(text, F.lit("")), lambda t: F.struct(t.alias("text"), F.rlike(t, F.lit(DIGIT)).alias("digit"))), chain)


def _stage(done: list[str], name: str, pattern: str, mark: str, digit: Column) -> Callable[[Column], Column]:
    return lambda s: _redacted(s, done, name, pattern, mark, digit)


def _redacted(s: Column, done: list[str], name: str, pattern: str, mark: str, digit: Column) -> Column:
    out, counts = s["text"], [s[n].alias(n) for n in done]
    held, digits = HOLDS.get(pattern, ("", False))
    may = (digit if digits else F.lit(True)) & F.contains(out, F.lit(held))
    if name != "tc":
        n = F.when(may, F.regexp_count(out, F.lit(pattern))).otherwise(0).cast("long")
        return let(n, lambda n: F.struct(F.when(n > 0, F.regexp_replace(out, pattern, mark)).otherwise(out).alias("text"), *counts, n.alias(name)))
    found = F.transform(F.regexp_extract_all(out, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(m.alias("m"), valid_national_id(m).alias("v")))

    def rebuilt(f: Column) -> Column:
        pieces = F.split(out, pattern)
        joined = F.zip_with(F.slice(pieces, F.lit(2), F.size(pieces)), f, lambda p, x: F.concat(F.when(x["v"], mark).otherwise(x["m"]), p))
        whole = F.when(F.exists(f, lambda x: x["v"]), F.concat(F.element_at(pieces, 1), F.array_join(joined, ""))).otherwise(out)
        return F.struct(whole.alias("text"), *counts, F.size(F.filter(f, lambda x: x["v"])).cast("long").alias(name))

    none = F.struct(out.alias("text"), *counts, F.lit(0).cast("long").alias(name))
    return F.when(may, let(found, rebuilt)).otherwise(none)
