"""Secret scans, with DataFrame operations only.

Three formats are found by their patterns. Beyond them, every long token of a text is put to a
battery of randomness tests: the encoding that its characters point to gives an alphabet, and
against it are tested the uniformity of the symbols (chi-squared), the number of runs above and
below the middle of the alphabet, and the correlation of neighbouring symbols. A token that one of
the tests rejects is not random and no secret.

Short tokens pass easily, so a token must also be unlikely as written language. Its p-value is the
likelihood ratio of the two, language over random, which by Markov's inequality bounds the chance
that language looks as random as this. The ratio falls with every symbol, so short tokens have
large p-values. The share of false reports is held by the procedure of Benjamini and Hochberg over
all tokens of all texts; it needs one small count per hundredth of a decimal power, nothing else
is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The three formats, in the order in which equal starts are listed.
ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
# Characters of an assigned value, at least.
ASSIGN_VALUE = 6

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}"
# Encodings, narrowest first, with their symbols in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("upper_hex", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$",
     "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/_-]+$",
     "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
# Shares of the letters a to z in European text, in thousandths.
LETTERS = (80, 15, 31, 42, 140, 13, 18, 35, 73, 4, 6, 44, 27, 76, 67, 22, 6, 66, 67, 72, 35, 11, 13,
           3, 11, 4)
# Language stays in one class (small, capital, digit, other) from one character to the next.
STAY = 0.92
# A test rejects below this p-value.
REJECT = 0.001
# Ties of p-values are taken together: hundredths of a decimal power, up to this power.
FINEST, DEEPEST = 100, 100


def _found(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as structs (start, stop, match), offsets in code points.

    Cutting the text at its matches leaves the pieces between them; their lengths and those of
    the matches add up to the offsets. Texts without a match are not cut.
    """
    empty = F.array().cast("array<struct<start:bigint,stop:bigint,match:string>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    first = F.struct(empty.alias("spans"), F.lit(0).cast("bigint").alias("at"))

    def step(state, pair):
        start = state["at"] + F.char_length(pair["p"])
        stop = start + F.char_length(pair["m"])
        span = F.struct(start.alias("start"), stop.alias("stop"), pair["m"].alias("match"))
        spans = F.when(pair["m"].isNotNull(), F.array_append(state["spans"], span))
        return F.struct(F.coalesce(spans, state["spans"]).alias("spans"), stop.alias("at"))

    pairs = F.zip_with(pieces, matches, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    cut = F.aggregate(pairs, first, step, lambda state: state["spans"])
    return F.when(text.rlike(pattern), cut).otherwise(empty)


def _normal_tail(z: Column) -> Column:
    """P(|Z| >= z) for a standard normal Z and z >= 0, by a logistic form good to 0.0003."""
    return 2 / (1 + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z))


def _class(symbol: Column) -> Column:
    return (
        F.when(symbol.between("a", "z"), 1).when(symbol.between("A", "Z"), 2)
        .when(symbol.between("0", "9"), 3).otherwise(4)
    )


def _log_share(symbol: Column, kind: Column) -> Column:
    """Log of a symbol's share among those of its class in written language."""
    logs = F.array(*[F.log(F.lit(s / 1000)) for s in LETTERS])
    letter = F.element_at(logs, F.instr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.lower(symbol)))
    return F.when(kind <= 2, letter).when(kind == 3, F.log(F.lit(0.1))).otherwise(F.log(F.lit(0.25)))


def battery(token: Column) -> Column:
    """Encoding, tests and p-value of a token of 2 or more characters as a struct.

    ``chi_p``, ``runs_p`` and ``serial_p`` are the tests' p-values if the symbols are random;
    ``language_p`` bounds the chance that written language is as unlike itself. ``evidence`` is
    that in hundredths of a decimal power, rounded down, or NULL if a test rejects or the token is
    a mere number.
    """
    named = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, pattern, alphabet in reversed(ENCODINGS):
        entry = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))
        named = F.when(token.rlike(pattern), entry).otherwise(named)

    def walk(encoding):
        size = F.char_length(encoding["alphabet"]).cast("double")
        middle = (size + 1) / 2
        start = F.struct(
            F.lit(0).alias("kind"), F.lit(None).cast("double").alias("code"),
            F.lit(0.0).alias("log"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("products"),
        )

        def step(s, symbol):
            kind = _class(symbol)
            code = F.instr(encoding["alphabet"], symbol).cast("double") - middle
            move = (
                F.when(s["kind"] == 0, F.log(F.lit(0.25)))
                .when(s["kind"] == kind, F.log(F.lit(STAY))).otherwise(F.log(F.lit((1 - STAY) / 3)))
            )
            turn = F.when((s["code"] < 0) != (code < 0), 1.0).otherwise(0.0)
            return F.struct(
                kind.alias("kind"), code.alias("code"),
                (s["log"] + move + _log_share(symbol, kind)).alias("log"),
                (s["turns"] + turn).alias("turns"),
                (s["products"] + F.coalesce(s["code"] * code, F.lit(0.0))).alias("products"),
            )

        def end(s):
            length = F.char_length(token).cast("double")
            square = F.aggregate(
                F.array_distinct(F.split(token, "")), F.lit(0.0),
                lambda total, c: total + F.pow(
                    length - F.char_length(F.replace(token, c, F.lit(""))), F.lit(2.0)),
            )
            freedom = size - 1
            chi = square * size / length - length
            # Chi-squared to the power of a third is nearly normal.
            cube = F.pow(F.greatest(chi, F.lit(0.0)) / freedom, F.lit(1 / 3))
            chi_z = (cube - 1 + 2 / (9 * freedom)) / F.sqrt(2 / (9 * freedom))
            spread = (size * size - 1) / 12
            return F.struct(
                encoding["name"].alias("encoding"), chi.alias("chi"),
                (_normal_tail(F.greatest(chi_z, F.lit(0.0))) / 2).alias("chi_p"),
                _normal_tail(
                    F.abs(s["turns"] - (length - 1) / 2) / F.sqrt((length - 1) / 4)).alias("runs_p"),
                _normal_tail(F.abs(s["products"]) / (spread * F.sqrt(length - 1))).alias("serial_p"),
                (s["log"] + length * F.log(size)).alias("log_ratio"),
            )

        return F.aggregate(F.split(token, ""), start, step, end)

    def judged(t):
        random = F.least(t["chi_p"], t["runs_p"], t["serial_p"]) >= REJECT
        powers = F.least(-t["log_ratio"] / F.log(F.lit(10.0)), F.lit(float(DEEPEST)))
        evidence = F.floor(F.greatest(powers, F.lit(0.0)) * FINEST).cast("int")
        return F.struct(
            t["encoding"].alias("encoding"), t["chi"].alias("chi"), t["chi_p"].alias("chi_p"),
            t["runs_p"].alias("runs_p"), t["serial_p"].alias("serial_p"),
            F.least(F.exp(t["log_ratio"]), F.lit(1.0)).alias("language_p"),
            F.when(random & ~token.rlike("^[0-9+/_-]+$"), evidence).alias("evidence"),
        )

    walked = F.transform(F.array(named), walk)
    return F.transform(walked, judged)[0]


def tokens(text: Column) -> Column:
    """The long tokens of a text as structs (start, stop, test), offsets in code points."""
    return F.transform(
        _found(text, TOKEN),
        lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"),
                           battery(x["match"]).alias("test")),
    )


def threshold(docs: DataFrame, rate: float) -> int | None:
    """Least ``evidence`` to report such that at most ``rate`` of the reports are false.

    All tokens of all texts count. None if nothing can be reported.
    """
    each = docs.select(F.explode(tokens(F.col("text"))).alias("token"))
    bins = each.groupBy(F.coalesce("token.test.evidence", F.lit(0)).alias("evidence")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # At most FINEST * DEEPEST + 1 rows, whatever the size of the table.
    down = Window.orderBy(F.desc("evidence"))
    everything = Window.partitionBy()
    counted = bins.withColumns({"k": F.sum("n").over(down), "m": F.sum("n").over(everything)})
    worst = F.pow(F.lit(10.0), -F.col("evidence") / FINEST)
    row = counted.where(worst <= rate * F.col("k") / F.col("m")).agg(F.min("evidence")).first()
    return row[0]


def _spans(text: Column) -> Column:
    """Spans of the three formats as structs (start, stop, kind), unsorted; kind by number."""

    def of(found: Column, kind: int) -> Column:
        return F.transform(found, lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(kind).alias("kind")))

    # The value of an assignment is what its match ends with.
    assigned = F.filter(_found(text, ASSIGN), lambda x: F.char_length(
        F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_VALUE)
    return F.concat(of(assigned, 0), of(_found(text, ACCESS), 1), of(_found(text, HEX), 2))


def scan(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """Find the secrets of every text.

    Adds ``spans`` to all columns of ``docs`` (one called so is replaced): an array of structs
    (start, stop, kind, evidence), sorted by start and then in the order of KINDS, offsets in code
    points from 0, the end exclusive; ``evidence`` is NULL for the three formats. Spans of
    different kinds may overlap. ``rate`` is the share of false reports allowed among the kind
    ``random``. NULL and empty texts have no spans. Two passes over the texts, no shuffle of
    them, one small count in between.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "spans"])
    least = threshold(docs, rate)
    text = F.coalesce("text", F.lit(""))
    base = F.transform(_spans(text), lambda x: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("number"),
        F.lit(None).cast("int").alias("evidence")))
    if least is None:
        spans = base
    else:
        hits = F.filter(tokens(text), lambda x: x["test"]["evidence"] >= least)
        spans = F.concat(base, F.transform(hits, lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), F.lit(3).alias("number"),
            x["test"]["evidence"].alias("evidence"))))
    order = F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["number"].alias("number"), x["stop"].alias("stop"),
        x["evidence"].alias("evidence")))
    names = F.array(*[F.lit(k) for k in KINDS])
    named = F.transform(F.array_sort(order), lambda x: F.struct(
        x["start"].alias("start"), x["stop"].alias("stop"),
        F.element_at(names, x["number"] + 1).alias("kind"), x["evidence"].alias("evidence")))
    return docs.withColumn("spans", named)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by one ``mask``."""
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(s, x):
        # A span that begins where the last ended, or before, only lengthens the masked stretch.
        fresh = (x["start"] > s["at"]) | ((s["at"] == 0) & (s["out"] == ""))
        between = F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int"))
        return F.struct(
            F.when(fresh, F.concat(s["out"], between, F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["stop"]).alias("at"),
        )

    rest = F.aggregate(spans, empty, step, lambda s: F.concat(
        s["out"], F.substr(text, (s["at"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)
