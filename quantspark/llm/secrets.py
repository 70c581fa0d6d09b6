"""Secret scan: fixed patterns plus a battery of randomness tests. DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.llm.common import ascii_lower

# The base patterns of the contract. In `hex` and `access` the least length stands in the pattern: a
# maximal run matches either form alike. In `assign` a failing match still uses up its characters, so the length of
# group 2 is tested afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
#: What may be an encoded random value: a maximal run of base64, base64url or hex characters.
RUN = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
# The alphabets of the inferred encodings, in code order.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


@dataclass(frozen=True)
class SecretConfig:
    #: Shortest run that is tested. Below it the tests lack the power to tell text from random characters.
    min_length: int = 24
    #: Digits and letters that a run must have; a word has no digits, a number no letters.
    min_digits: int = 3
    min_letters: int = 3
    #: Share of random values that may be rejected wrongly, in each class of lengths.
    fdr: float = 0.01
    #: Step of the histogram of -log10 p on which the rejection threshold is found.
    step: float = 0.05


def _spans(text: str, pattern: str, extra: str = "") -> str:
    """SQL: (start, end, match) of the leftmost non-overlapping matches in code points; ``extra`` adds fields.

    The pieces between the matches and the matches themselves alternate, so positions are running lengths.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""aggregate(
        arrays_zip(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0){extra.format(p=p)}),
        named_struct('at', 0, 'spans', cast(array() as array<struct<start:int,end:int,m:string,g:string>>)),
        (acc, x) -> if(x.`1` is null, acc, named_struct(
            'at', acc.at + length(x.`0`) + length(x.`1`),
            'spans', concat(acc.spans, array(named_struct(
                'start', acc.at + length(x.`0`), 'end', acc.at + length(x.`0`) + length(x.`1`),
                'm', x.`1`, 'g', {'x.`2`' if extra else 'x.`1`'}))))),
        acc -> acc.spans)"""


NONE = "cast(array() as array<struct<start:int,end:int,m:string,g:string>>)"


def _with_base(docs: DataFrame) -> DataFrame:
    """+ _text (null: empty), _assign, _access, _hex. A pattern is only split on where a cheaper test finds it."""
    inner = ", regexp_extract_all({{text}}, '{p}', 2)".replace("{{text}}", "_text")
    hint = " or ".join(f"contains(_low, '{k}')" for k in KEYWORDS)
    return (
        docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
        .withColumn("_low", ascii_lower(F.col("_text")))
        .withColumn("_assign", F.expr(f"if({hint}, filter({_spans('_text', ASSIGN, inner)}, x -> length(x.g) >= 6), {NONE})"))
        .withColumn("_access", F.expr(f"if(contains(_text, 'AKIA'), {_spans('_text', ACCESS)}, {NONE})"))
        .withColumn("_hex", F.expr(f"if(_text rlike '{HEX}', {_spans('_text', HEX)}, {NONE})"))
        .drop("_low")
    )


def _with_tests(docs: DataFrame, cfg: SecretConfig) -> DataFrame:
    """+ _tests: (start, end, cls, p) of every tested run outside the base spans; p under "all characters are drawn
    alike and independently from the inferred alphabet"."""
    run = RUN % cfg.min_length
    encoding = "case " + " ".join(
        f"when x.s rlike '^[{chars}]+$' then '{name}'"
        for name, chars in (
            ("hex", "0-9a-f"), ("HEX", "0-9A-F"), ("base32", "A-Z2-7"), ("base62", "0-9A-Za-z"), ("base64", "A-Za-z0-9+/"),
            ("base64url", "A-Za-z0-9_-"),
        )
    ) + " end"
    alphabet = "case x.enc " + " ".join(f"when '{k}' then '{v}'" for k, v in ALPHABETS.items()) + " end"
    named = lambda **kw: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in kw.items()) + ")"
    keep = {"start": "x.start", "end": "x.end"}
    z_p = "1 / (1 + exp(1.5976 * {z} + 0.070566 * {z} * {z} * {z}))"  # upper tail of the normal, to 2e-4
    steps = [
        named(**keep, s="rtrim('=', x.m)"),
        named(**keep, s="x.s", enc=encoding),
        named(**keep, s="x.s", alpha=alphabet, n="cast(length(x.s) as double)"),
        named(**keep, n="x.n", a="cast(length(x.alpha) as double)",
              code="transform(filter(split(x.s, ''), c -> c <> ''), c -> instr(x.alpha, c) - 1)"),
        named(**keep, n="x.n", a="x.a", code="x.code",
              sq="aggregate(array_distinct(x.code), 0D, (t, c) -> t + pow(size(filter(x.code, d -> d = c)), 2))",
              high="cast(size(filter(x.code, c -> c >= x.a / 2)) as double)",
              runs="1D + size(filter(transform(x.code, (c, i) -> i > 0 and (c >= x.a / 2) <> (x.code[greatest(i - 1, 0)] >= x.a / 2)), c -> c))",
              mean="aggregate(x.code, 0D, (t, c) -> t + c) / x.n"),
        named(**keep, n="x.n", z_chi="(x.sq * x.a / x.n - x.n - (x.a - 1)) / sqrt(2 * (x.a - 1) * (x.n - 1) / x.n)",
              high="x.high", runs="x.runs", expect="2 * x.high * (x.n - x.high) / x.n + 1",
              var="aggregate(x.code, 0D, (t, c) -> t + pow(c - x.mean, 2))",
              cov="aggregate(transform(x.code, (c, i) -> if(i = 0, 0D, (c - x.mean) * (x.code[greatest(i - 1, 0)] - x.mean))), 0D, (t, c) -> t + c)"),
        named(**keep, n="x.n", z1="greatest(-8D, least(8D, x.z_chi))",
              z2="least(8D, abs(coalesce((x.runs - x.expect) / sqrt(nullif((x.expect - 1) * (x.expect - 2) / (x.n - 1), 0)), 8D)))",
              z3="least(8D, abs(coalesce(x.cov / nullif(x.var, 0) * sqrt(x.n), 8D)))"),
        named(**keep, n="x.n", f="-2 * (" + " + ".join(
            f"ln(greatest(1e-16, {w} * {z_p.format(z=z)}))" for w, z in ((1, "x.z1"), (2, "x.z2"), (2, "x.z3"))) + ")"),
        # Fisher's sum of three tests: chi-squared with six degrees of freedom, whose tail is closed.
        named(**keep, cls="cast(floor(log2(x.n)) as int)",
              p="least(1D, exp(-greatest(x.f, 0D) / 2) * (1 + greatest(x.f, 0D) / 2 + pow(greatest(x.f, 0D), 2) / 8))"),
    ]
    free = "not exists(concat(_assign, _access, _hex), b -> b.start < x.end and x.start < b.end)"
    mixed = (
        f"length(regexp_replace(x.m, '[^0-9]', '')) >= {cfg.min_digits} and "
        f"length(regexp_replace(x.m, '[^A-Za-z]', '')) >= {cfg.min_letters}"
    )
    expr = f"filter({_spans('_text', run)}, x -> {mixed} and {free})"
    for step in steps:
        expr = f"transform({expr}, x -> {step})"
    empty = "cast(array() as array<struct<start:int,end:int,cls:int,p:double>>)"
    return docs.withColumn("_tests", F.expr(f"if(_text rlike '{run}', {expr}, {empty})"))


def randomness_limits(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> dict[int, float]:
    """Class of lengths -> the p-value up to which "random" is rejected (Benjamini-Hochberg, on a histogram).

    The histogram has at most a few thousand rows however many runs there are; one number a class (about thirty, the
    logarithm of the length) comes to the driver.
    """
    # The narrow select first: the regular expressions of the base spans run only where a run of such length is.
    runs = docs.select("text").where(F.col("text").rlike(RUN % cfg.min_length))
    tests = _with_tests(_with_base(runs), cfg).select(F.explode("_tests").alias("t")).select("t.cls", "t.p")
    bins = tests.groupBy("cls", F.floor(-F.log10(F.greatest("p", F.lit(1e-30))) / cfg.step).alias("bin")).count()
    below = Window.partitionBy("cls").orderBy(F.col("bin").desc())
    ranked = bins.withColumn("rank", F.sum("count").over(below)).withColumn(
        "m", F.sum("count").over(Window.partitionBy("cls"))
    )
    edge = F.pow(F.lit(10.0), -F.col("bin") * cfg.step)
    rows = ranked.where(edge <= cfg.fdr * F.col("rank") / F.col("m")).groupBy("cls").agg(F.max(edge).alias("p")).collect()
    return {r["cls"]: r["p"] for r in rows}


def secret_spans(docs: DataFrame, cfg: SecretConfig = SecretConfig()) -> DataFrame:
    """``docs`` with ``spans``: array of (start, end, kind) of all secrets in the text, by start, then kind.

    Base kinds: the fixed patterns. Kind `random`: runs that mix digits and letters, touch no base span, and for which
    the tests of uniformity, runs and serial correlation cannot reject random characters at the false-discovery
    rate of their class of lengths. Null text counts as empty and gives no spans; very long texts are scanned whole;
    repeated rows repeat; an empty table gives no rows; the other columns pass unread, but spans is replaced. Positions
    are code points, ends exclusive.
    """
    limits = randomness_limits(docs, cfg)
    docs = docs.drop("spans")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text")  # no name can clash
    limit = "case x.cls " + " ".join(f"when {c} then {p!r}D" for c, p in sorted(limits.items())) + " else 0D end" if limits else "0D"
    tag = lambda col, k: f"transform({col}, x -> named_struct('start', x.start, 'k', {k}, 'end', x.end))"
    found = _with_tests(_with_base(packed), cfg).withColumn(
        "_all",
        F.expr(
            "array_sort(concat("
            + ", ".join([tag("_assign", 0), tag("_access", 1), tag("_hex", 2), tag(f"filter(_tests, x -> x.p > {limit})", 3)])
            + "))"
        ),
    )
    kind = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.k + 1)"
    return found.withColumn(
        "spans", F.expr(f"transform(_all, x -> named_struct('start', x.start, 'end', x.end, 'kind', {kind}))")
    ).select("_row.*", "spans")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts, digest of the base spans and the list of all spans."""
    text = lambda spans: f"array_join(transform({spans}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = lambda k: F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(text("filter(spans, x -> x.kind <> 'random')")), 256).alias("base_sha256"),
        F.expr(text("spans")).alias("spans"),
    )


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); other texts as they were."""
    merged = """aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (acc, x) ->
        if(size(acc) > 0 and acc[greatest(size(acc) - 1, 0)].end > x.start,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', acc[greatest(size(acc) - 1, 0)].start,
                  'end', greatest(acc[greatest(size(acc) - 1, 0)].end, x.end)))),
           concat(acc, array(named_struct('start', x.start, 'end', x.end)))))"""
    built = f"""aggregate(_merged, named_struct('at', 0, 'parts', cast(array() as array<string>)), (acc, x) ->
        named_struct('at', x.end, 'parts', concat(acc.parts, array(substring(text, acc.at + 1, x.start - acc.at), '{mark}'))),
        acc -> concat(array_join(acc.parts, ''), substring(text, acc.at + 1)))"""
    columns = [c for c in found.columns if c != "spans"]
    packed = found.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text", F.expr(merged).alias("_merged"))
    changed = packed.select("_row", F.expr(f"if(size(_merged) = 0, text, {built})").alias("_new"))
    return changed.select(*[F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in columns])
