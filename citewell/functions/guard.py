"""Redaction, injection scoring and policy checks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell import params as P
from citewell.functions import text

UNICODE, UNICODE_NOCASE = "(?U)", "(?iUd)"


# ---- gates -------------------------------------------------------------------------------------
#
# A pattern can only match a text that holds its literals. Substring searches tell in a fraction of a pattern's time that most texts hold
# none, so patterns run on the few others. A gate lets every match through.


def folded(c: Column) -> Column:
    """Lower case, with the letters that patterns without case take for ASCII ones."""
    odd, plain = P.FOLDED_LETTERS
    return F.lower(F.when(holds_one(c, tuple(odd)), F.translate(c, odd, plain)).otherwise(c))


def holds_one(c: Column, literals: tuple[str, ...]) -> Column:
    out = F.contains(c, F.lit(literals[0]))
    for literal in literals[1:]:
        out = out | F.contains(c, F.lit(literal))
    return out


SHARED = tuple(sorted({lit for groups in P.INJECTION_NEEDS.values() for lit in groups[0]
                       if sum(lit in groups[0] for groups in P.INJECTION_NEEDS.values()) > 1}))


def shared_literals(low: Column) -> Column:
    """Whether a `folded` text holds each literal that more than one rule asks for first."""
    return F.struct(*[F.contains(low, F.lit(lit)).alias(lit) for lit in SHARED])


def may_fire(rule: str, low: Column, shared: Column | None = None) -> Column:
    """Whether a `folded` text holds what the injection rule needs; ``shared``: its `shared_literals`."""
    first, *others = P.INJECTION_NEEDS[rule]
    own = [lit for lit in first if shared is None or lit not in SHARED]
    known = [shared[lit] for lit in first if shared is not None and lit in SHARED]
    out = F.lit(False)
    for found in [*known, *[F.contains(low, F.lit(lit)) for lit in own]]:
        out = out | found
    for group in others:
        out = out & holds_one(low, group)
    return out


def may_hold(kind: str, c: Column, low: Column, digits: Column) -> Column:
    """Whether a text holds what the redaction needs; ``digits``: whether it holds DIGIT_PAIR. No label holds any of it, so what holds for the
    text as it came holds after other redactions too."""
    if kind in P.REDACTION_NEEDS_DIGITS:
        return digits
    if kind in P.REDACTION_NEEDS_LOWER:
        return holds_one(low, P.REDACTION_NEEDS_LOWER[kind])
    return holds_one(c, P.REDACTION_NEEDS[kind])


# ---- redaction ---------------------------------------------------------------------------------


def luhn_valid(candidate: Column) -> Column:
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def _redact_cards(c: Column, pattern: str, label: str) -> tuple[Column, Column]:
    """Only matches that pass the checksum are replaced. The text is cut at every match and put together
    again, so that each match keeps its own place."""
    matches = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    pieces = F.split(c, pattern)
    rebuilt = F.array_join(
        F.zip_with(
            pieces, matches,
            lambda piece, m: F.concat(piece, F.when(m.isNull(), "").when(luhn_valid(m), label).otherwise(m)),
        ),
        "",
    )
    return rebuilt, F.size(F.filter(matches, luhn_valid))


def redact(df: DataFrame, column: str = "text", allow: tuple[str, ...] = (), counts: str = "redactions") -> DataFrame:
    """Replaces sensitive values of ``column`` by ``[REDACTED_TYPE]`` and adds ``counts``, a map of the types found.

    The patterns run in order, each on the text the ones before it left, and only where the text may hold a match. Counting comes
    first and a row is only rewritten if something was found."""
    steps = [(kind, pattern) for kind, pattern in P.REDACTIONS if kind not in allow]
    raw = F.col(column)
    df = text.computed(df, **{column: raw, "_low": folded(raw), "_digits": raw.rlike(UNICODE + P.DIGIT_PAIR)})
    df = text.computed(df, _may=F.struct(*[may_hold(kind, raw, F.col("_low"), F.col("_digits")).alias(kind) for kind, _ in steps])).drop("_low", "_digits")
    for kind, pattern in steps:
        java = UNICODE + pattern
        label = f"[REDACTED_{kind}]"
        if kind == "CREDIT_CARD":
            rebuilt, found = _redact_cards(F.col(column), java, label)
        else:
            rebuilt = F.regexp_replace(F.col(column), F.lit(java), F.lit(label))
            found = F.regexp_count(F.col(column), F.lit(java))
        found = F.when(F.col("_may")[kind], found).when(F.col(column).isNotNull(), F.lit(0))
        df = df.withColumns({f"_n_{kind}": found, column: F.when(found > 0, rebuilt).otherwise(F.col(column))})
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(f"_n_{k}").cast("long").alias("value")) for k, _ in steps])
    found = F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))
    return text.computed(df, **{column: F.col(column), counts: found}).drop("_may", *[f"_n_{k}" for k, _ in steps])


def redaction_types(counts: Column) -> Column:
    return F.sort_array(F.map_keys(counts))


def has_secret(types: Column) -> Column:
    return F.arrays_overlap(types, F.array(*[F.lit(t) for t in P.SECRET_TYPES]))


# ---- injection ---------------------------------------------------------------------------------


def collapsed(c: Column) -> Column:
    """Undoes ``i.g.n.o.r.e``: single separators between single characters are dropped."""
    return F.regexp_replace(c, UNICODE + P.SPACED_LETTERS, "")


def decoded_payloads(c: Column, limit: int | None = P.DEFAULTS.encoded_payloads) -> Column:
    """The base64-looking runs (the first ``limit``, or all), decoded; only printable UTF-8 stays."""
    blobs = F.regexp_extract_all(c, F.lit(P.BASE64_PATTERN), F.lit(0))
    blobs = F.slice(blobs, 1, limit) if limit else blobs

    def decode(blob: Column) -> Column:
        missing = F.pmod(-F.length(blob), F.lit(4))
        raw = F.try_to_binary(F.concat(blob, F.repeat(F.lit("="), missing)), F.lit("base64"))
        body = F.length(F.regexp_replace(blob, "=+$", ""))
        return F.when((missing < 3) & (F.pmod(body, F.lit(4)) != 1), raw)

    def readable(raw: Column) -> Column:
        return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))

    strings = F.transform(F.transform(blobs, decode), readable)
    return F.filter(strings, lambda s: s.isNotNull() & s.rlike(r"^[[\P{C}&&\P{Z}] ]*$"))


def injection_flags(df: DataFrame, column: str = "text", out: str = "injection", normalized: bool = False) -> DataFrame:
    """Adds ``out``: struct<score double, flags array<string>> for the text, its collapsed form and its decoded
    payloads. Distinct flags combine as 1 - prod(1 - weight)."""
    df = df.withColumn("_plain", F.col(column)) if normalized else text.with_normalized(df, column, "_plain")
    plain = F.col("_plain")
    blobs = F.when(plain.rlike(P.BASE64_TEST), decoded_payloads(plain))
    spaced = F.when(plain.rlike(UNICODE + P.SPACED_LETTERS_TEST), collapsed(plain))
    df = text.computed(df, _plain=plain, _low=folded(plain), _collapsed=spaced, _payloads=F.coalesce(blobs, F.array().cast("array<string>")))
    df = text.computed(df, _low_collapsed=folded(F.col("_collapsed")), _shared=shared_literals(F.col("_low")))

    def fires(name: str, pattern: str) -> Column:
        java = UNICODE_NOCASE + pattern
        return (
            (may_fire(name, F.col("_low"), F.col("_shared")) & plain.rlike(java))
            | (F.col("_collapsed").isNotNull() & may_fire(name, F.col("_low_collapsed")) & F.col("_collapsed").rlike(java))
            | ((F.size("_payloads") > 0) & F.exists("_payloads", lambda p: p.rlike(java)))
        )

    df = df.withColumns({f"_f_{name}": fires(name, pattern) for name, _, pattern in P.INJECTION_RULES})
    any_rule = F.lit(False)
    for name, _, _ in P.INJECTION_RULES:
        any_rule = any_rule | F.col(f"_f_{name}")
    df = df.withColumn(f"_f_{P.ENCODED_PAYLOAD[0]}", any_rule & (F.size("_payloads") > 0))
    weights = [(name, weight) for name, weight, _ in P.INJECTION_RULES] + [P.ENCODED_PAYLOAD]
    remaining = F.lit(1.0)
    for name, weight in weights:
        remaining = remaining * F.when(F.col(f"_f_{name}"), F.lit(1 - weight)).otherwise(F.lit(1.0))
    flags = F.array_compact(F.array(*[F.when(F.col(f"_f_{n}"), n) for n in sorted(n for n, _ in weights)]))
    df = text.computed(df, **{out: F.struct(F.round(1 - remaining, 3).alias("score"), flags.alias("flags"))})
    return df.drop("_plain", "_low", "_collapsed", "_low_collapsed", "_shared", "_payloads", *[f"_f_{n}" for n, _ in weights])


def is_harmful(c: Column) -> Column:
    return c.rlike(UNICODE_NOCASE + P.HARMFUL_PATTERN)


# ---- policy ------------------------------------------------------------------------------------


def check_input(questions: DataFrame, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """Decision per row of ``question``: adds safe_question, blocked, block_reason, refusal, input_flags,
    pii_types, injection_score. First match wins: too long, secret, injection, harmful."""
    df = redact(questions.withColumn("safe_question", F.col("question")), "safe_question", counts="_pii")
    df = injection_flags(df, "question", "_inj")
    too_long = F.length("question") > s.max_question_chars
    injected = F.col("_inj.score") >= s.injection_threshold
    rule_flags = F.transform(F.col("_inj.flags"), lambda f: F.concat(F.lit("injection:"), f))
    none = F.array().cast("array<string>")
    types = redaction_types(F.col("_pii"))
    df = df.withColumns({
        "_types": types,
        "block_reason": F.when(too_long, "input_too_long").when(has_secret(types), "secret_in_input")
        .when(injected, "prompt_injection").when(is_harmful(F.col("question")), "harmful_content"),
    })
    reason = F.col("block_reason")
    return df.withColumns({
        "blocked": reason.isNotNull(),
        "refusal": F.when(reason == "input_too_long", P.TOO_LONG_REPLY).when(reason == "secret_in_input", P.REFUSAL_SENSITIVE)
        .when(reason == "prompt_injection", P.REFUSAL_INJECTION).when(reason == "harmful_content", P.REFUSAL_HARMFUL),
        "input_flags": F.when(reason == "input_too_long", F.array(F.lit("input_too_long")))
        .when(reason == "secret_in_input", F.array(F.lit("secret_detected")))
        .when(reason == "harmful_content", F.concat(rule_flags, F.array(F.lit("harmful")))).otherwise(rule_flags),
        "pii_types": F.when(reason == "input_too_long", none).otherwise(F.col("_types")),
        "injection_score": F.when(reason.isin("input_too_long", "secret_in_input"), 0.0).otherwise(F.col("_inj.score")),
    }).drop("_pii", "_inj", "_types")


def cited_refs(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(P.CITATION_PATTERN), F.lit(1)), lambda n: n.cast("int")))


def drop_refs(c: Column, invalid: Column) -> Column:
    """Removes ``[n]`` for every n of ``invalid``, in whatever spelling (``[7]`` and ``[07]``)."""
    pieces = F.split(c, P.CITATION_PATTERN)
    marks = F.regexp_extract_all(c, F.lit(P.CITATION_PATTERN), F.lit(0))
    number = lambda m: F.regexp_extract(m, P.CITATION_PATTERN, 1).cast("int")
    return F.array_join(
        F.zip_with(pieces, marks, lambda piece, m: F.concat(
            piece, F.when(m.isNull() | F.array_contains(invalid, number(m)), "").otherwise(m))),
        "",
    )


def check_output(answers: DataFrame, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """Needs answer, canary (may be empty) and n_refs. Replaces ``answer``; adds output_flags, output_pii,
    valid_refs, leaked."""
    none, no_refs = F.array().cast("array<string>"), F.array().cast("array<int>")
    df = answers.withColumn("leaked", (F.col("canary") != "") & F.contains(F.col("answer"), F.col("canary")))
    df = redact(df.withColumn("_text", F.col("answer")), "_text", counts="_pii")
    available = F.when(F.col("n_refs") > 0, F.sequence(F.lit(1), F.col("n_refs").cast("int"))).otherwise(no_refs)
    df = df.withColumns({"_cited": cited_refs(F.col("_text")), "_available": available})
    invalid = F.array_except("_cited", "_available")
    df = df.withColumns({"_invalid": invalid, "_text": F.when(F.size(invalid) > 0, drop_refs(F.col("_text"), invalid)).otherwise(F.col("_text"))})
    df = injection_flags(df, "_text", "_inj")
    flags = F.array_compact(F.array(
        F.when(F.size("_pii") > 0, "pii_redacted"),
        F.when(F.size("_invalid") > 0, "invalid_citations_removed"),
        F.when(F.col("_inj.score") >= s.output_injection_threshold, "suspicious_output"),
    ))
    return df.withColumns({
        "answer": F.when(F.col("leaked"), P.REFUSAL_INJECTION).otherwise(text.strip(F.col("_text"))),
        "output_flags": F.when(F.col("leaked"), F.array(F.lit("system_prompt_leak"))).otherwise(flags),
        "output_pii": F.when(F.col("leaked"), none).otherwise(redaction_types(F.col("_pii"))),
        "valid_refs": F.when(F.col("leaked"), no_refs).otherwise(F.sort_array(F.array_intersect("_cited", "_available"))),
    }).drop("_text", "_pii", "_cited", "_available", "_invalid", "_inj")
