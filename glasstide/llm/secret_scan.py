"""Secret scan: pattern spans, plus tokens that pass a battery of randomness tests under false-discovery control.

Candidate tokens get an inferred encoding. Under that encoding's alphabet, a chi-squared test of uniformity, a runs
test and a serial-correlation test each give a p-value of "drawn at random"; Fisher's method joins them. Within each
stratum of encoding and length class, random tokens have uniform p-values, and what exceeds that among the accepted is
false: the least cut-off is taken that keeps this share under alpha. All steps are DataFrame expressions.

The joined p-values are approximate: runs and serial correlation depend on one another, and for tokens of 16 to 32 characters the
normal law is rough for the chi-squared sum. Both bend the p-values of truly random tokens alike within a stratum, and a cut-off
only compares a stratum's tokens among themselves, with its upper half as the measure; alpha is a target, not a guarantee.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

# Fixed values of the base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "random")

#: Tokens that may be encoded random bytes: 16 or more characters with a digit, or with a capital after a small letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_-]{16,}"
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {
    "decimal": DIGITS,
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": DIGITS + LOWER,
    "base64": LOWER.upper() + LOWER + DIGITS + "+/",
}
#: Bits that a token must be able to hold to count as a secret.
LEAST_BITS = 64
#: Lower ends of the p-value bins of the stratum histograms.
CUTS = (0.0, 1e-9, 1e-6, 1e-4, 1e-3, 0.003, 0.01, 0.03, 0.1, 0.2, 0.3, 0.4, 0.5)


#: Matches of a text that are placed one after the other; blocks of so many are placed by their lengths.
BLOCK = 256


def _with(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(text: Column, pattern: str) -> Column:
    """start, value of the leftmost non-overlapping matches; starts are in code points.

    A match stands where all gaps and matches before it end. These are summed up within blocks and over blocks, so that a text with
    many matches takes about as much longer.
    """
    kind = "array<struct<start:int,value:string>>"
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    step = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda v, g: F.struct(v.alias("value"), F.char_length(g).alias("gap")))
    size = lambda s: s["gap"] + F.char_length(s["value"])

    def ends(sizes: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(sizes, start, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def within(block: Column, begin: Column) -> Column:
        start = F.struct(begin.alias("end"), F.array().cast(kind).alias("out"))
        put = lambda a, s: F.concat(a["out"], F.array(F.struct((a["end"] + s["gap"]).alias("start"), s["value"].alias("value"))))
        return F.aggregate(block, start, lambda a, s: F.struct((a["end"] + size(s)).alias("end"), put(a, s).alias("out")), lambda a: a["out"])

    cut = lambda st: F.transform(F.sequence(F.lit(0), F.size(st) - 1, F.lit(BLOCK)), lambda i: F.slice(st, i + 1, BLOCK))
    total = lambda block: F.aggregate(block, F.lit(0), lambda a, s: a + size(s))
    folded = _with(step, lambda st: _with(cut(st), lambda blocks: F.flatten(F.zip_with(blocks, ends(F.transform(blocks, total)), within))))
    return F.when(F.size(values) > 0, folded).otherwise(F.array().cast(kind))


def _spans(placed: Column, kind: int) -> Column:
    return F.transform(
        placed,
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.char_length(m["value"])).alias("stop")),
    )


def base_spans(text: Column) -> Column:
    """Spans (start, kind, stop) of the base patterns by start, then kind; a failing match still uses up its text."""
    text = F.coalesce(text, F.lit(""))
    assigned = F.filter(
        _placed(text, ASSIGN), lambda m: F.char_length(F.regexp_extract(m["value"], ASSIGN, 2)) >= LEAST_ASSIGNED
    )
    return F.array_sort(F.concat(_spans(assigned, 0), _spans(_placed(text, ACCESS), 1), _spans(_placed(text, HEX), 2)))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal law, by the tanh approximation."""
    return F.greatest(F.lit(1e-12), 0.5 * (1 - F.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z * z * z))))


def _combined(m: Column) -> Column:
    """Fisher's combination of the three tests' p-values for one measured token."""
    n, size, a = m["n"].cast("double"), m["size"].cast("double"), m["sums"]
    chi = (size / n * m["squares"] - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (1 - 1 / n))
    mean = a["s"] / n
    lag = (a["lagged"] / (n - 1) - mean * mean) / F.greatest(a["ss"] / n - mean * mean, F.lit(1e-9))
    runs = 2 * a["high"] * (n - a["high"]) / n + 1
    spread = F.sqrt(F.greatest((runs - 1) * (runs - 2) / (n - 1), F.lit(1e-9)))
    p_runs = F.when(runs <= 2, F.lit(1e-12)).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(a["runs"] - runs) / spread)))
    p_lag = F.least(F.lit(1.0), 2 * _upper_tail(F.abs(lag) * F.sqrt(n)))
    half = -(F.log(_upper_tail(chi)) + F.log(p_runs) + F.log(p_lag))
    return F.exp(-half) * (1 + half + half * half / 2)


def _sums(m: Column) -> Column:
    """Running sums over a token's character codes, for the runs and serial-correlation tests."""
    half = m["size"] / 2.0
    names = ("m", "last", "s", "ss", "lagged", "high", "runs")
    return F.aggregate(
        F.transform(F.split(m["token"], ""), lambda c: F.position(c, m["alphabet"]).cast("double")),
        F.struct(*[F.lit(0.0).alias(k) for k in names]),
        lambda a, x: F.struct(
            (a["m"] + 1).alias("m"),
            x.alias("last"),
            (a["s"] + x).alias("s"),
            (a["ss"] + x * x).alias("ss"),
            (a["lagged"] + a["last"] * x).alias("lagged"),
            (a["high"] + F.when(x > half, 1.0).otherwise(0.0)).alias("high"),
            (a["runs"] + F.when((a["m"] > 0) & ((x > half) == (a["last"] > half)), 0.0).otherwise(1.0)).alias("runs"),
        ),
    )


def tested_tokens(text: Column) -> Column:
    """start, stop, stratum, p of each candidate token: p is the probability of looking less random if drawn at random."""
    encoding = lambda raw: (
        F.when(raw.rlike("^[0-9]+$"), "decimal")
        .when(raw.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(raw.rlike("^[A-Z2-7]+$"), "base32")
        .when(raw.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .otherwise("base64")
    )
    alphabets = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    placed = _placed(F.coalesce(text, F.lit("")), CANDIDATE)
    named = F.transform(placed, lambda m: F.struct(m["start"].alias("start"), m["value"].alias("raw"), encoding(m["value"]).alias("encoding")))
    spelt = F.transform(
        named,
        lambda m: F.struct(
            m["start"].alias("start"),
            F.char_length(m["raw"]).alias("n"),
            m["encoding"].alias("encoding"),
            F.element_at(alphabets, m["encoding"]).alias("alphabet"),
            F.when(m["encoding"].isin("hex", "base36"), F.lower(m["raw"])).otherwise(F.translate(m["raw"], "-_", "+/")).alias("token"),
        ),
    )
    sized = F.filter(spelt, lambda m: m["n"] * F.log2(F.char_length(m["alphabet"]).cast("double")) >= LEAST_BITS)
    measured = F.transform(
        F.transform(sized, lambda m: m.withField("size", F.char_length(m["alphabet"]))),
        lambda m: F.struct(
            m["start"].alias("start"),
            m["n"].alias("n"),
            m["encoding"].alias("encoding"),
            m["size"].alias("size"),
            _sums(m).alias("sums"),
            F.aggregate(
                F.filter(F.split(m["alphabet"], ""), lambda c: c != ""),
                F.lit(0.0),
                lambda a, c: a + F.pow((m["n"] - F.char_length(F.replace(m["token"], c, F.lit("")))).cast("double"), F.lit(2.0)),
            ).alias("squares"),
        ),
    )
    return F.transform(
        measured,
        lambda m: F.struct(
            m["start"].alias("start"),
            (m["start"] + m["n"]).alias("stop"),
            F.concat_ws(":", m["encoding"], F.floor(F.log2(m["n"].cast("double"))).cast("string")).alias("stratum"),
            _combined(m).alias("p"),
        ),
    )


def cutoffs(histogram: list[tuple[str, int, int]], alpha: float) -> dict[str, float]:
    """Least accepted p-value per stratum, from rows (stratum, bin, count); strata without one are left out."""
    strata: dict[str, list[int]] = {}
    for stratum, b, count in histogram:
        strata.setdefault(stratum, [0] * len(CUTS))[b] += count
    out = {}
    for key, counts in strata.items():
        random = counts[-1] / (1 - CUTS[-1])  # how many random tokens the upper half stands for
        for k in range(1, len(CUTS)):
            accepted = sum(counts[k:])
            if accepted and max(0.0, accepted - random * (1 - CUTS[k])) <= alpha * accepted:
                out[key] = CUTS[k]
                break
    return out


def scan_secrets(documents: DataFrame, alpha: float = 0.1) -> DataFrame:
    """documents' rows with base (pattern spans) and spans (those and the spans found by the tests that touch none of them).

    Spans are structs (start, kind, stop) in code points with kinds by index in KINDS, sorted. Null texts count as empty
    and have no spans; a very long text is scanned whole; repeated rows each get a result; an empty table gives no rows; other
    columns stay, but for ones named base or spans, whatever the case. The only thing collected is the strata's histogram: encodings x length classes x p-value bins, a few hundred rows at any size.
    """
    bins = sum((F.when(F.col("t.p") >= c, 1).otherwise(0) for c in CUTS[1:]), F.lit(0))
    tested = documents.select(F.explode(tested_tokens(F.col("text"))).alias("t"))
    cut = cutoffs([tuple(r) for r in tested.groupBy("t.stratum", bins.alias("bin")).count().collect()], alpha)
    columns = [c for c in documents.columns if c.lower() not in ("base", "spans")]
    based = documents.select(*quoted(columns), base_spans(F.col("text")).alias("base"))
    if not cut:
        return based.withColumn("spans", F.col("base"))
    least = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv])
    kept = F.filter(
        F.filter(tested_tokens(F.col("text")), lambda t: t["p"] >= F.coalesce(F.try_element_at(least, t["stratum"]), F.lit(2.0))),
        lambda t: ~F.exists("base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])),
    )
    extra = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    return based.withColumn("spans", F.array_sort(F.concat("base", extra)))


def written(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span replaced by a mark; overlapping spans count as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    folded = F.aggregate(
        spans,
        start,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["stop"].alias("at"), F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out")),
        ).otherwise(F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
