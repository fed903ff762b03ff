"""Secret scans: base patterns plus a battery of randomness tests; DataFrame functions only.

Candidates are long runs of an encoding's characters. Each is read in the narrowest encoding that
fits (hex, base32, base64). Three tests must not reject that its symbols are uniform: chi-squared over the
symbols of the alphabet, runs above and below the middle, and lag-one serial correlation.
What passes is weighed against what is not random: the likelihood ratio of its character classes, uniform
against text-like, is an e-value, and it grows with the length. A class's share in text-like runs is the larger
of a fixed one and that in the corpus's own candidates that a test rejects, so the mean is at most 1 under either.
Within each band of lengths the e-values of all documents go through the e-BH procedure, which
holds the false-discovery rate under any dependence. Only histograms of e-values are gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
#: No base match is possible without one of these; a cheap test before the exact ones.
ACCESS_FIRST, HEX_FIRST = r"AKIA[A-Z0-9]{16}", r"[0-9a-f]{24}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"

#: Alphabets in the order of their symbols' values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Shares of upper case, lower case, digits, others in text-like runs of each encoding's characters.
TEXT_SHARES = {"hex": (0.0, 0.1, 0.9, 0.0), "base32": (0.95, 0.0, 0.05, 0.0), "base64": (0.06, 0.88, 0.05, 0.01)}
#: The same shares if every symbol of the alphabet is as likely.
UNIFORM_SHARES = {"hex": (0.0, 6 / 16, 10 / 16, 0.0), "base32": (26 / 32, 0.0, 6 / 32, 0.0), "base64": (26 / 64, 26 / 64, 10 / 64, 2 / 64)}
LENGTH_BANDS = (32, 48, 64)
#: Classes of characters in the order of the shares.
CLASSES = {"upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "other": "[+/]"}


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often a lambda inside `use` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, groups' text>> of the leftmost non-overlapping matches, in code points.

    What lies between the matches (split) and the matches (regexp_extract_all) come in turn;
    their running lengths are the positions. They are summed in runs of the square root of their
    number, since appending to an array copies it.
    """
    p = F.lit(pattern)
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    each = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda gap, m: F.struct(F.char_length(gap).alias("gap"), m.alias("m")))
    none = F.array().cast("array<struct<start: int, end: int, m: string>>")
    at = lambda place: F.struct(place.alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        e = s + F.char_length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["m"].alias("m")))).alias("out"))

    def in_runs(each: Column) -> Column:
        side = F.ceil(F.sqrt(F.size(each))).cast("int")
        firsts = F.when(F.size(each) > 0, F.sequence(F.lit(1), F.size(each), side)).otherwise(F.array().cast("array<int>"))

        def add(acc: Column, first: Column) -> Column:
            run = F.aggregate(F.slice(each, first, side), at(acc["at"]), step)
            return _let(run, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], r["out"]).alias("out")))

        return F.aggregate(firsts, at(F.lit(0)), add, lambda acc: acc["out"])

    return _let(each, in_runs)


def _kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), x["m"].alias("m")))


_SPANS = "array<struct<start: int, kind: int, end: int, m: string>>"


def base_spans(text: Column) -> Column:
    none = F.array().cast(_SPANS)
    tail = F.lit(r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""")
    assign = F.filter(_kind(spans(text, ASSIGN), "assign"), lambda x: F.char_length(F.regexp_replace(x["m"], tail, F.lit(""))) >= 6)
    access = F.filter(_kind(spans(text, ACCESS), "access"), lambda x: x["end"] - x["start"] >= 20)
    hexes = F.filter(_kind(spans(text, HEX_FIRST + "[0-9a-f]*"), "hex"), lambda x: x["end"] - x["start"] >= 24)
    return F.concat(
        F.when(text.rlike(ASSIGN), assign).otherwise(none), F.when(text.rlike(ACCESS_FIRST), access).otherwise(none), F.when(text.rlike(HEX_FIRST), hexes).otherwise(none)
    )


def joined(found: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["end"])), ",")


def _by_encoding(encoding: Column, values: dict) -> Column:
    out = F.lit(values["base64"])
    for name in ("base32", "hex"):
        out = F.when(encoding == name, F.lit(values[name])).otherwise(out)
    return out


def randomness(m: Column) -> dict[str, Column]:
    """Encoding, the three statistics and the log e-value of a candidate string."""
    encoding = F.when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(m.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    plain = F.when(encoding == "hex", F.lower(m)).otherwise(F.translate(m, "-_", "+/"))
    size = _by_encoding(encoding, {k: len(v) for k, v in ALPHABETS.items()})
    values = _let(
        F.struct(encoding.alias("encoding"), plain.alias("plain")),
        lambda s: F.transform(F.split(s["plain"], "(?!^)"), lambda c: F.instr(_by_encoding(s["encoding"], ALPHABETS), c) - 1),
    )
    return {"encoding": encoding, "plain": plain, "alphabet": size, "values": values}


def _tested(c: DataFrame) -> DataFrame:
    """c has plain, encoding, alphabet, values. Adds n, chi_z, runs_z, serial_z and the characters of each class."""
    n = F.size("values").cast("double")
    part = F.aggregate(F.transform(F.sequence(F.lit(0), F.col("alphabet") - 1), lambda b: F.size(F.filter("values", lambda v: v == b)).cast("double")), F.lit(0.0), lambda a, x: a + x * x)
    free = F.col("alphabet") - 1.0
    # the cube root of chi-squared over its degrees of freedom is about normal (Wilson and Hilferty)
    chi_z = (F.cbrt((F.col("alphabet") * part / n - n) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    high = F.transform("values", lambda v: F.when(2 * v >= F.col("alphabet"), 1).otherwise(0))
    n1 = F.aggregate("high", F.lit(0.0), lambda a, x: a + x)
    changes = F.aggregate(F.zip_with(F.slice("high", 1, F.size("high") - 1), F.slice("high", 2, F.size("high") - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    expected = 2 * F.col("n1") * (F.col("n") - F.col("n1")) / F.col("n") + 1
    spread = (expected - 1) * (expected - 2) / (F.col("n") - 1)
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / n
    dev = _let(F.col("mean"), lambda mu: F.transform("values", lambda v: v - mu))
    square = F.aggregate("dev", F.lit(0.0), lambda a, x: a + x * x)
    lag = F.aggregate(F.zip_with(F.slice("dev", 1, F.size("dev") - 1), F.slice("dev", 2, F.size("dev") - 1), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    classes = {name: F.char_length("plain") - F.char_length(F.regexp_replace("plain", pattern, "")) for name, pattern in CLASSES.items()}
    return (
        c.withColumns({"n": n, "chi_z": chi_z, "high": high, "mean": mean, **classes})
        .withColumns({"n1": n1, "changes": changes, "dev": dev})
        .withColumns({
            "runs_z": F.when(spread > 0, (F.col("changes") + 1 - expected) / F.sqrt(spread)).otherwise(99.0),
            "serial_z": F.when(square > 0, lag / square * F.sqrt("n")).otherwise(99.0),
        })
        .drop("high", "mean", "n1", "changes", "dev", "values")
    )


def _weighed(tested: DataFrame) -> DataFrame:
    """tested with log_e, the log of its e-value; what the rejected candidates are made of is three rows."""
    made = tested.filter("not passed").groupBy("encoding").agg(*(F.sum(c).alias(f"all_{c}") for c in CLASSES), F.sum("n").alias("all_n"))
    log_e = F.lit(0.0)
    for i, c in enumerate(CLASSES):
        fixed = _by_encoding(F.col("encoding"), {e: TEXT_SHARES[e][i] for e in ALPHABETS})
        uniform = _by_encoding(F.col("encoding"), {e: UNIFORM_SHARES[e][i] for e in ALPHABETS})
        share = F.greatest(fixed, F.coalesce(F.col(f"all_{c}") / F.col("all_n"), F.lit(0.0)))
        log_e = log_e + F.when((uniform > 0) & (share > 0), F.col(c) * F.log(uniform / share)).otherwise(0.0)
    return tested.join(F.broadcast(made), "encoding", "left").withColumn("log_e", log_e)


def find_secrets(docs: DataFrame, *, fdr: float = 0.01, z_most: float = 3.3) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans; one row per input row.

    z_most is the 0.001 point of the normal distribution, to which all three tests are brought. A random span that overlaps a base span is not reported. A null text counts as empty;
    doc_id may be null or repeated; no rows give no rows; other columns are not read.
    The texts are read once; spans and candidates are written, and texts are never shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast(_SPANS)
    rough = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rough = rough.select("doc_id", base_spans(F.col("text")).alias("base"), F.when(F.col("text").rlike(CANDIDATE), _kind(spans(F.col("text"), CANDIDATE), "random")).otherwise(none).alias("cand"))
    free = F.filter("cand", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    rows = written(rough.select("doc_id", "base", F.when(F.size("cand") > 0, free).otherwise(none).alias("cand")).withColumn("row", F.monotonically_increasing_id()), "secret-spans")

    c = rows.select("row", F.explode("cand").alias("c")).select("row", "c")
    r = randomness(F.col("c")["m"])
    # generated, so that the filter on the tests isn't pushed below: inside lambdas its inlined inputs would be computed for every symbol
    c = c.select("row", "c", F.inline(F.array(F.struct(*(r[k].alias(k) for k in ("encoding", "plain", "alphabet", "values"))))))
    band = F.lit(0)
    for b in LENGTH_BANDS:
        band = band + F.when(F.col("n") >= b, 1).otherwise(0)
    passed = (F.col("chi_z") <= z_most) & (F.abs("runs_z") <= z_most) & (F.abs("serial_z") <= z_most)
    tested = _tested(c).select("row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), "encoding", "n", *CLASSES, passed.alias("passed"), band.alias("band"))
    tested = _weighed(written(tested, "secret-candidates"))
    # e-values are compared on steps of a tenth of their logarithm, so a histogram is enough; a candidate that
    # fails a test has no step (its e-value is 0) and still counts among all that were tested
    step = F.when(F.col("passed"), F.floor(F.least(F.col("log_e"), F.lit(200.0)) * 10).cast("int"))
    tested = written(tested.select("row", "start", "end", step.alias("step"), "band"), "secret-tests")
    from pyspark.sql import Window

    down = Window.partitionBy("band").orderBy(F.col("step").desc_nulls_last())
    least = (
        tested.groupBy("band", "step").agg(F.count(F.lit(1)).alias("k"))
        .withColumns({"found": F.sum("k").over(down), "all": F.sum("k").over(Window.partitionBy("band"))})
        .filter(F.col("step") / 10 >= F.log(F.col("all") / (F.col("found") * fdr)))
        .groupBy("band").agg(F.min("step").alias("least"))
    )  # at most one row a band
    found = tested.join(F.broadcast(least), "band").filter("step >= least").groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end", F.lit("").alias("m"))).alias("random"))
    out = rows.select("row", "doc_id", "base").join(found, "row", "left").withColumn("random", F.coalesce("random", none))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size("random").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "random")).alias("spans"),
    )
