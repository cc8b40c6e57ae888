r"""Secret scan: base patterns plus a randomness test battery. DataFrame functions only.

Base spans come from three patterns. The battery looks at every run of
``LEAST`` or more characters of ``[A-Za-z0-9+/_-]``, those inside base spans
included. Its encoding is inferred (digits, hex, letters, base 32, 36, 62, 64)
and two questions are put to it.

Could it be random? That is asked of the tokens that could be anything else
than written, whose second p value is below one; all others are written and
never reported. Three tests are made of its symbols against uniform draws
from that alphabet: chi-squared of the symbol counts (its tail from the exact
first three moments at this length), runs above and below the alphabet's
middle (with continuity correction), and lag-one serial correlation (with its
variance at this length). The smallest p value, times three, is the token's p
value; simulated draws of 12 to 64 symbols stay at or below every nominal level.

Could it be written? In words, names, paths and numbers the kind of character
(lower, upper, digit) seldom changes and rare letters are few, at most
``WRITTEN`` of the places (``LETTERS`` in a token of letters alone). The p value
is the binomial tail of the count of such places, bounded by a geometric series.

Both are decided by Benjamini-Hochberg at ``fdr`` in strata of encoding and
length (powers of two): a token is reported if randomness is not rejected and
writing is. So the share of true keys among the tokens discarded as not random,
and the share of written ones among those reported, stay below ``fdr`` at every
length. The step-up thresholds are taken over p values rounded up to a grid of
``GRID`` steps per power of two; only those histograms (strata times grid, a
fixed bound) come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from .shared import write_table

# Fixed values of the base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16

LEAST = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
FDR = 0.05
WRITTEN, LETTERS = 0.15, 0.1
RARE = "jkqvwxz"
GRID, MAX_BITS = 8, 60
SUM_BLOCK = 128
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPAN = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
TOKEN = "array<struct<start:int,end:int,stratum:int,step:int,written:int,base:boolean>>"


def _found(text: Column, pattern: str, weigh: Column | None = None) -> Column:
    """Array of (start, end, value, weight) of the leftmost non-overlapping matches; code points, end exclusive.

    The pieces between matches and the matches themselves are laid end to end.
    Ends are sums over blocks of ``SUM_BLOCK`` and within the block, so that many
    matches in one text stay far below quadratic cost.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    weights = F.transform(values, lambda v: F.length(v)) if weigh is None else weigh
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def rows(t: Column) -> Column:
        return F.transform(t["v"], lambda v, i: F.struct(F.length(v).alias("n"), v.alias("value"), F.get(t["w"], i).alias("w"), (F.length(F.get(t["g"], i)) + F.length(v)).alias("step")))

    def sums(z: Column) -> Column:
        steps = F.transform(z, lambda x: x["step"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / SUM_BLOCK).cast("int")), lambda b: total(F.transform(F.slice(z, b * SUM_BLOCK + 1, SUM_BLOCK), lambda x: x["step"])))
        return F.struct(z.alias("z"), steps.alias("steps"), F.when(F.size(z) > 0, blocks).alias("blocks"))

    def placed(t: Column) -> Column:
        block = lambda i: F.floor(i / SUM_BLOCK).cast("int")
        end = lambda i: total(F.slice(t["blocks"], F.lit(1), block(i))) + total(F.slice(t["steps"], block(i) * SUM_BLOCK + 1, F.pmod(i, F.lit(SUM_BLOCK)) + 1))
        both = F.transform(t["z"], lambda x, i: F.struct(end(i).alias("end"), x.alias("x")))
        return F.transform(both, lambda y: F.struct((y["end"] - y["x"]["n"]).alias("start"), y["end"].alias("end"), y["x"]["value"].alias("value"), y["x"]["w"].alias("w")))

    parts = F.struct(values.alias("v"), F.split(text, pattern, -1).alias("g"), weights.alias("w"))
    return let(let(let(parts, rows), sums), placed)


def _kind(found: Column, no: int, least: int) -> Column:
    return F.transform(F.filter(found, lambda s: s["w"] >= least), lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), F.lit(KINDS[no]).alias("kind"), s["end"].alias("end")))


def _only(test: Column, value: Column, kind: str) -> Column:
    return F.when(test, value).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed.

    A run of ``[0-9a-f]`` or of the access pattern is maximal, so looking for
    runs of the least length directly finds what filtering all runs would.
    """
    long_hex, long_access = r"[0-9a-f]{%d,}" % MIN_HEX, r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4)
    kinds = (
        _only(F.rlike(text, F.lit(ASSIGN)), _kind(_found(text, ASSIGN, F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), 2), lambda v: F.length(v))), 0, MIN_VALUE), SPAN),
        _only(F.contains(text, F.lit("AKIA")), _kind(_found(text, long_access), 1, MIN_ACCESS), SPAN),
        _only(F.rlike(text, F.lit(long_hex)), _kind(_found(text, long_hex), 2, MIN_HEX), SPAN),
    )
    return F.array_sort(F.concat(*kinds))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the public rational approximation (error below 1e-7), floored at 2**-MAX_BITS."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.when(z >= 0, tail).otherwise(1 - tail), F.lit(2.0**-MAX_BITS))


def _alphabet(value: Column) -> Column:
    """(number, symbols in order, fold case) of the inferred encoding."""
    kind = lambda no, symbols, fold: F.struct(F.lit(no).alias("no"), F.lit(symbols).alias("symbols"), F.lit(fold).alias("fold"))
    fits = lambda pattern: F.rlike(value, F.lit(f"^({pattern})$"))
    return (
        F.when(fits("[0-9]+"), kind(0, _DIGITS, False))
        .when(fits("[0-9a-f]+|[0-9A-F]+"), kind(1, _DIGITS + "abcdef", True))
        .when(fits("[A-Z]?[a-z]+|[A-Z]+"), kind(2, _LOWER, True))
        .when(fits("[A-Z2-7]+"), kind(3, _UPPER + "234567", False))
        .when(fits("[0-9a-z]+|[0-9A-Z]+"), kind(4, _DIGITS + _LOWER, True))
        .when(fits("[0-9A-Za-z]+"), kind(5, _DIGITS + _UPPER + _LOWER, False))
        .when(fits("[0-9A-Za-z_-]+"), kind(6, _UPPER + _LOWER + _DIGITS + "-_", False))
        .otherwise(kind(7, _UPPER + _LOWER + _DIGITS + "+/", False))
    )


def p_value(value: Column, alphabet: Column | None = None) -> Column:
    """The battery's p value of a token under uniform draws from its inferred alphabet; a few symbols give 1."""
    bare = F.regexp_replace(value, "=+$", "")
    parts = F.struct((_alphabet(bare) if alphabet is None else alphabet).alias("a"), bare.alias("v"))

    def code(p: Column) -> Column:
        chars = F.split(F.when(p["a"]["fold"], F.lower(p["v"])).otherwise(p["v"]), "")
        return F.struct(F.length(p["a"]["symbols"]).cast("double").alias("k"), F.filter(F.transform(chars, lambda ch: F.when(ch != "", F.instr(p["a"]["symbols"], ch) - 1)), lambda x: x >= 0).alias("x"))

    def chi(equal: Column, n: Column, k: Column) -> Column:
        """Upper tail of the number of equal pairs, which chi-squared is linear in: a shifted gamma of its mean, variance and skewness."""
        mean = n * (n - 1) / 2 / k
        var = mean * (1 - 1 / k)
        third = n * (n - 1) * (n - 2) * (1 - 1 / k) * (1 - 2 / k) / (k * k) + var * (1 - 2 / k)
        shape = 4 * F.pow(var, F.lit(3.0)) / F.pow(third, F.lit(2.0))
        centre = 2 * var * var / third  # mean of the gamma part
        ratio = F.greatest(equal - 0.5 - mean + centre, F.lit(0.0)) / centre
        return _upper_tail((F.cbrt(ratio) - (1 - 1 / (9 * shape))) * 3 * F.sqrt(shape))

    def tests(c: Column) -> Column:
        x, k = c["x"], c["k"]
        n = F.size(x).cast("double")
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        equal = total(F.transform(F.array_distinct(x), lambda s: let(F.size(F.filter(x, lambda y: y == s)).cast("double"), lambda m: m * (m - 1) / 2)))
        above = total(F.transform(x, lambda s: F.when(2 * s >= k, 1.0).otherwise(0.0)))
        runs = 1 + total(F.transform(x, lambda s, i: F.when((i > 0) & ((2 * s >= k) != (2 * F.get(x, F.greatest(i - 1, F.lit(0))) >= k)), 1.0).otherwise(0.0)))
        s1, s2 = total(F.transform(x, lambda v: v.cast("double"))), total(F.transform(x, lambda v: (v * v).cast("double")))
        lag = total(F.transform(x, lambda v, i: (v * F.get(x, F.when(i + 1 < F.size(x), i + 1).otherwise(0))).cast("double")))
        return F.struct(n.alias("n"), k.alias("k"), equal.alias("equal"), above.alias("above"), runs.alias("runs"), s1.alias("s1"), s2.alias("s2"), lag.alias("lag"))

    def combined(t: Column) -> Column:
        n, above, below = t["n"], t["above"], t["n"] - t["above"]
        mean = 1 + 2 * above * below / n
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        # With no mixture the runs test says nothing: one side alone has probability 2**(1-n), which chi-squared sees too.
        p_runs = F.when(above * below == 0, F.lit(1.0)).otherwise(2 * _upper_tail(F.greatest(F.abs(t["runs"] - mean) - 0.5, F.lit(0.0)) / spread))
        variance = n * t["s2"] - t["s1"] * t["s1"]
        serial = F.when(variance > 0, (n * t["lag"] - t["s1"] * t["s1"]) / F.greatest(variance, F.lit(1e-9))).otherwise(F.lit(1.0))
        p_serial = 2 * _upper_tail(F.abs(serial + 1 / (n - 1)) * (n - 1) * F.sqrt((n + 1) / (n * (n - 3))))
        return F.least(F.lit(1.0), 3 * F.least(chi(t["equal"], n, t["k"]), p_runs, p_serial))

    return let(let(let(parts, code), tests), lambda t: F.when(t["n"] < 8, F.lit(1.0)).otherwise(combined(t)))


def written_p_value(value: Column, letters_only: Column) -> Column:
    """Bound of the binomial chance that a written token has so many changes of kind and rare letters.

    Signs between letters and digits are left out. A capital before a small
    letter is no change, as words begin so.
    """
    common = "".join(c for c in _LOWER if c not in RARE)
    kinds = F.translate(F.regexp_replace(value, "[^A-Za-z0-9]", ""), common + RARE + common.upper() + RARE.upper() + _DIGITS, "l" * len(common) + "q" * len(RARE) + "U" * len(common) + "Q" * len(RARE) + "0" * 10)
    places = F.regexp_count(kinds, F.lit("[qQ]|(?<=[lq])U|(?<=[lqUQ])0|(?<=0)[lU]")).cast("double")

    def bound(t: Column) -> Column:
        m, n, odds = t["m"], t["n"], t["rate"] / (1 - t["rate"])
        first = F.aggregate(F.sequence(F.lit(1), m.cast("int")), n * F.log(1 - t["rate"]), lambda acc, i: acc + F.log((n - i + 1) / i * odds))
        ratio = (n - m) / (m + 1) * odds  # of the next term to this one; later ratios are smaller
        return F.when(m <= n * t["rate"], F.lit(1.0)).otherwise(F.greatest(F.least(F.exp(first) / (1 - ratio), F.lit(1.0)), F.lit(2.0**-MAX_BITS)))

    return let(F.struct(places.alias("m"), F.greatest(F.length(kinds), F.lit(1)).cast("double").alias("n"), F.when(letters_only, LETTERS).otherwise(WRITTEN).alias("rate")), bound)


def candidate_tokens(text: Column, base: Column) -> Column:
    """Array of (start, end, stratum, step, written, base): steps are -log2 of the two p values on the grid, rounded down.

    ``step`` is -1 where the first question is not asked; ``base`` says whether a base span touches the token.
    """
    has = F.rlike(text, F.lit(CANDIDATE))
    step = lambda p: F.floor(F.greatest(F.lit(0.0), -GRID * F.log2(p))).cast("int")

    def placed(s: Column) -> Column:
        return F.struct(s.alias("s"), _alphabet(F.rtrim(s["value"], F.lit("="))).alias("a"))

    def written(t: Column) -> Column:
        return F.struct(t["s"].alias("s"), t["a"].alias("a"), step(written_p_value(t["s"]["value"], t["a"]["no"] == 2)).alias("written"))

    def judged(t: Column) -> Column:
        s, alphabet = t["s"], t["a"]
        return F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            (32 * alphabet["no"] + F.floor(F.log2(s["w"].cast("double")))).cast("int").alias("stratum"),
            F.when(t["written"] > 0, step(p_value(s["value"], alphabet))).otherwise(-1).alias("step"),
            t["written"].alias("written"),
            F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("base"),
        )

    scored = F.transform(F.transform(F.transform(_found(text, CANDIDATE), placed), written), judged)
    return _only(has, scored, TOKEN)


def rejection_steps(tokens: DataFrame, fdr: float = FDR, step: str = "step") -> dict[int, int]:
    """Per stratum the least step at which the hypothesis is rejected (Benjamini-Hochberg on the grid); absent: never.

    ``tokens`` has columns ``stratum`` and ``step``. The driver gets their histogram only.
    """
    counts: dict[int, dict[int, int]] = {}
    for r in tokens.groupBy("stratum", F.col(step).alias("step")).agg(F.count("*").alias("n")).collect():
        counts.setdefault(r.stratum, {})[r.step] = r.n
    out = {}
    for stratum, steps in counts.items():
        m, seen = sum(steps.values()), 0
        for at in sorted(steps, reverse=True):
            seen += steps[at]
            if 2.0 ** (-at / GRID) <= fdr * seen / m:  # p is at most this
                out[stratum] = at
    return out


def _thresholds(found: DataFrame, fdr: float) -> tuple[dict[int, int], dict[int, int]]:
    """(steps from which randomness is rejected, steps from which writing is) over all tokens of the stored scan."""
    tokens = found.select(F.explode("_tokens").alias("t")).select("t.stratum", "t.step", "t.written")
    return rejection_steps(tokens.where("step >= 0"), fdr), rejection_steps(tokens, fdr, "written")


def _decided(tokens: Column, thresholds: tuple[dict[int, int], dict[int, int]]) -> Column:
    """The tokens that are reported."""
    never = F.lit(1 << 30)
    limit = lambda t, steps: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(steps.items()) for x in kv]), t["stratum"]), never) if steps else never
    return F.filter(tokens, lambda t: (t["step"] < limit(t, thresholds[0])) & (t["written"] >= limit(t, thresholds[1])))


def _added(tokens: Column) -> Column:
    """Spans of the reported tokens that no base span touches."""
    return F.transform(F.filter(tokens, lambda t: ~t["base"]), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind_no"), F.lit(KINDS[3]).alias("kind"), t["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _scanned(docs: DataFrame) -> DataFrame:
    """The input row as ``row``, so that no name can clash, with ``_base`` and ``_tokens`` of its text."""
    packed = docs.select(F.struct("*").alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    return packed.withColumn("_base", base_spans(text)).withColumn("_tokens", candidate_tokens(text, F.col("_base")))


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per input row: ``doc_id``, counts of base spans, ``base_sha256``, ``spans``, and what the battery saw.

    ``n_tokens`` counts the tested tokens, ``n_random`` those reported (in base
    spans or not); ``spans`` has the base spans and the reported tokens that
    touch none of them. Null texts are empty: no spans, the digest of the empty
    string. Repeated rows and rows without ``doc_id`` are scanned each. Extra
    columns are ignored.
    """
    found = write_table(_scanned(docs.select("doc_id", "text")).select(F.col("row.doc_id").alias("doc_id"), "_base", "_tokens"), "secrets")
    found = found.withColumn("_random", _decided(F.col("_tokens"), _thresholds(found, fdr)))
    count = lambda no: F.size(F.filter("_base", lambda s: s["kind_no"] == no)).cast("long")
    return found.select(
        "doc_id",
        *[count(no).alias(f"n_{KINDS[no]}") for no in range(3)],
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("_base", _added(F.col("_random"))))).alias("spans"),
        F.size("_tokens").cast("long").alias("n_tokens"),
        F.size("_random").cast("long").alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every span, overlapping ones merged, replaced by ``mark``.

    Rows without spans are unchanged, null and empty texts among them; repeated
    rows are redacted alike. All input columns stay, whatever their names. The
    scan is stored, as the thresholds need all of it before any text changes.
    """
    found = write_table(_scanned(docs), "secrets")
    spans = F.array_sort(F.concat("_base", _added(_decided(F.col("_tokens"), _thresholds(found, fdr)))))
    text = F.col("row.text")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        between = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.when(fresh, F.concat(acc["out"], F.array(between, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    rebuilt = F.aggregate("_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    changed = F.col("row").withField("text", F.when(F.size("_spans") > 0, rebuilt).otherwise(text))
    return found.withColumn("_spans", spans).select(changed.alias("row")).select("row.*").select(*[F.col(f"`{c}`") for c in docs.columns])
