"""Secret scans: fixed patterns, and a battery of randomness tests for other strings; DataFrame functions only.

A candidate is a long run of characters whose encoding can be inferred. Chi-squared uniformity of its
alphabet, a runs test and lag-one serial correlation give p-values under "drawn at random from this
encoding", combined by Fisher's method as if they were independent, which they nearly are. Random strings spread evenly over 0 to 1, others gather near 0;
in each class of encoding and length, the number of random strings is estimated from the upper half, and the
threshold goes down as long as there are no more strings above it than these and a share ``fdr`` explain. Few
strings in the upper half say little, so two standard deviations are added to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

#: Fixed values of the base patterns: pattern, the group whose length counts, its least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is found at the same place as by +
}
#: Candidates of the randomness tests.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Encodings from the narrowest: name, alphabet, and what a string must match. Words alone match none.
ENCODINGS = [
    ("hex", "0123456789abcdef", r"^[0-9a-f]+$"),
    ("HEX", "0123456789ABCDEF", r"^[0-9A-F]+$"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$"),
]
#: Lengths from which a new length class begins, and the steps of the p-value histogram.
LENGTHS, STEPS = (20, 28, 40, 64, 128), 100
#: Distinct strings from which a class stands for itself.
THIN = 20
KINDS = [*BASE, "random"]


def found(text: Column, pattern: str, group: int, least: int, kind: str) -> Column:
    """Leftmost non-overlapping matches as structs (s, e, rank, kind, token): code points, end exclusive; those whose group is shorter than ``least`` are dropped."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole

    def placed(v: Column) -> Column:
        whole, gaps, value = v["whole"], v["gaps"], v["value"]
        # from one match's start to the next: the match before, and the gap after it
        steps = F.transform(whole, lambda x, i: F.length(x) + F.get(gaps, i + 1))
        span = lambda x, i, start: F.struct(start.alias("s"), (start + F.length(x)).alias("e"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x.alias("token"), F.length(F.get(value, i)).alias("size"))
        starts = running(steps, F.get(gaps, 0), lambda a, b: a + b)
        all_ = let(starts, lambda at: F.transform(whole, lambda x, i: span(x, i, F.get(at, i))))
        return F.transform(F.filter(all_, lambda x: x["size"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["rank"].alias("rank"), x["kind"].alias("kind"), x["token"].alias("token")))

    spans = let(F.struct(whole.alias("whole"), gaps.alias("gaps"), value.alias("value")), placed)
    return F.coalesce(F.when(text.rlike(pattern), spans), F.array().cast("array<struct<s:int,e:int,rank:int,kind:string,token:string>>"))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution; Abramowitz and Stegun 26.2.17."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = let(t, lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
    return let(F.exp(-z * z / 2) * 0.3989422804014327 * poly, lambda upper: F.when(z >= 0, upper).otherwise(1 - upper))


def encoding(token: Column) -> Column:
    """Struct (name, alphabet) of the narrowest encoding, or null."""
    first = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, alphabet, pattern in reversed(ENCODINGS):
        first = F.when(token.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(first)
    return first


def p_value(token: Column, alphabet: Column) -> Column:
    """Fisher's combination of the three tests; close to 0 where the token isn't random in its alphabet."""

    # each struct is bound once: a lambda would work out an expression anew for every element
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    before = lambda x, i: F.get(x, F.greatest(i - 1, F.lit(0)))

    def counted(v: Column) -> Column:
        x, k, n = v["x"], v["k"], v["n"]
        return F.struct(
            x.alias("x"), k.alias("k"), n.alias("n"), (total(x) / n).alias("centre"),
            total(F.transform(F.array_distinct(x), lambda c: F.pow(n - F.size(F.array_remove(x, c)), F.lit(2.0)))).alias("squares"),
            total(F.transform(x, lambda c: F.when(c >= k / 2, 1.0).otherwise(0.0))).alias("high"),
            total(F.transform(x, lambda c, i: F.when((i > 0) & ((c >= k / 2) != (before(x, i) >= k / 2)), 1.0).otherwise(0.0))).alias("turns"),
        )

    def moments(v: Column) -> Column:
        x, n, high, centre = v["x"], v["n"], v["high"], v["centre"]
        return F.struct(
            v["k"].alias("k"), n.alias("n"), v["squares"].alias("squares"), high.alias("high"), v["turns"].alias("turns"),
            (2 * high * (n - high) / n + 1).alias("mean"),
            total(F.transform(x, lambda c: (c - centre) * (c - centre))).alias("square"),
            total(F.transform(x, lambda c, i: F.when(i > 0, (c - centre) * (before(x, i) - centre)).otherwise(0.0))).alias("product"),
        )

    def normal(v: Column) -> Column:
        k, n, mean = v["k"], v["n"], v["mean"]
        # Pearson's statistic by its exact mean and variance; runs above and below the alphabet's middle; lag one
        chi = (v["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        spread = F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9))
        runs = F.when((v["high"] == 0) | (v["high"] == n), F.lit(9.0)).otherwise(F.abs(v["turns"] + 1 - mean) / F.sqrt(spread))
        serial = F.when(v["square"] <= 0, F.lit(9.0)).otherwise(F.abs(v["product"] / v["square"]) * F.sqrt(n))
        return F.array(F.struct(chi.alias("z"), F.lit(1.0).alias("sides")), F.struct(runs.alias("z"), F.lit(2.0).alias("sides")), F.struct(serial.alias("z"), F.lit(2.0).alias("sides")))

    def fisher(zs: Column) -> Column:
        half = -total(F.transform(zs, lambda t: F.log(F.least(F.greatest(t["sides"] * upper_tail(t["z"]), F.lit(1e-30)), F.lit(1.0)))))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared tail of 6 degrees at 2 * half

    chars = F.filter(F.split(token, ""), lambda c: c != "")
    index = F.transform(chars, lambda c: (F.call_function("locate", c, alphabet) - 1).cast("double"))
    return let(F.struct(index.alias("x"), F.length(alphabet).cast("double").alias("k"), F.length(token).cast("double").alias("n")), lambda v: let(counted(v), lambda c: let(moments(c), lambda m: let(normal(m), fisher))))


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def candidates(text: Column) -> Column:
    """Structs (s, e, group, hash, step): runs with an inferred encoding, their class and the histogram step of their p-value."""
    spans = found(text, CANDIDATE, 0, 20, "random")

    def tested(span: Column) -> Column:
        def of(v: Column) -> Column:
            step = F.least(F.floor(p_value(v["t"], v["c"]["alphabet"]) * STEPS), F.lit(STEPS - 1)).cast("int")
            group = F.concat_ws("-", v["c"]["name"], length_class(F.length(v["t"])).cast("string"))
            return F.struct(span["s"].alias("s"), span["e"].alias("e"), group.alias("group"), F.xxhash64(v["t"]).alias("hash"), F.when(v["c"].isNotNull(), step).alias("step"))

        return let(F.struct(span["token"].alias("t"), encoding(span["token"]).alias("c")), of)

    return F.filter(F.transform(spans, tested), lambda x: x["step"].isNotNull())


def lowest_step(n: list[int], fdr: float) -> int:
    """The lowest step of a histogram of distinct strings that is still a discovery; 0 only where the whole class is random without any allowance."""
    upper = sum(n[STEPS // 2 :])
    likely, most = upper / 0.5, (upper + 2 * (upper + 1) ** 0.5) / 0.5
    out = STEPS // 2
    for step in range(STEPS // 2, 0, -1):
        above = sum(n[step:])
        if above - most * (1 - step / STEPS) > fdr * above:
            break
        out = step
    for step in range(out, -1, -1):
        above = sum(n[step:])
        if above and above - likely * (1 - step / STEPS) <= fdr * above:
            out = step
    return out


def thresholds(docs: DataFrame, fdr: float = 0.05, text: str = "text") -> dict[str, int]:
    """For each class of encoding and length, the lowest histogram step that is still a discovery.

    The histogram has 100 rows a class and 35 classes at most, and counts the distinct candidates of all documents. A
    class of fewer than ``THIN`` goes no lower than all lengths of its encoding together.
    """
    each = docs.select(F.explode(candidates(F.coalesce(F.col(text), F.lit("")))).alias("c")).select("c.group", "c.step", "c.hash").distinct()
    table = each.groupBy("group", "step").agg(F.count("*").alias("n")).collect()
    counts = {(r["group"], r["step"]): r["n"] for r in table}
    out = {}
    for name, _, _ in ENCODINGS:
        groups = {f"{name}-{i}": [counts.get((f"{name}-{i}", step), 0) for step in range(STEPS)] for i in range(len(LENGTHS))}
        pooled = lowest_step([sum(x) for x in zip(*groups.values())], fdr)
        for group, n in groups.items():
            own = lowest_step(n, fdr)
            out[group] = own if sum(n) >= THIN else max(own, pooled)
    return out


def scan(text: Column, least: dict[str, int]) -> Column:
    """All spans of a text as structs (s, e, rank, kind) by start, then kind: the base patterns' and discoveries that overlap none of them."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(*[found(text, *rule, kind) for kind, rule in BASE.items()])
    known = F.create_map(*[F.lit(x) for pair in sorted(least.items()) for x in pair]) if least else F.create_map().cast("map<string,int>")
    random = KINDS.index("random")
    item = lambda x, rank, kind: F.struct(x["s"].alias("s"), rank.alias("rank"), x["e"].alias("e"), kind.alias("kind"))
    span = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["rank"].alias("rank"), x["kind"].alias("kind"))
    discoveries = F.filter(candidates(text), lambda c: c["step"] >= F.coalesce(F.try_element_at(known, c["group"]), F.lit(STEPS)))
    all_ = F.array_sort(F.concat(F.transform(base, lambda x: item(x, x["rank"], x["kind"])), F.transform(discoveries, lambda c: item(c, F.lit(random), F.lit("random")))))

    def free(v: Column) -> Column:
        # a discovery overlaps a base span where one before it ends after its start, or the next one starts before its end
        is_base, most = lambda x: x["rank"] < random, F.lit(2**31 - 1)
        ends = running(F.transform(v, lambda x: F.when(is_base(x), x["e"]).otherwise(0)), F.lit(0), F.greatest)
        begins = running(F.reverse(F.transform(v, lambda x: F.when(is_base(x), x["s"]).otherwise(most))), most, F.least)
        beside = F.struct(ends.alias("ends"), F.reverse(begins).alias("begins"))
        return let(beside, lambda b: F.filter(v, lambda x, i: is_base(x) | ((F.get(b["ends"], i) <= x["s"]) & (F.get(b["begins"], i) >= x["e"]))))

    left = let(all_, lambda v: F.when(F.exists(v, lambda x: x["rank"] == random), free(v)).otherwise(v))
    return F.transform(left, span)


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_documents(docs: DataFrame, fdr: float = 0.05, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, found (the spans as structs).

    Null and empty texts have no spans; of runs at one place every kind counts, in the order listed; repeated
    rows give repeated rows; no rows give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), scan(F.col(text), thresholds(docs, fdr, text)).alias("found"))
    base = F.filter("found", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select("doc_id", *map(count, BASE), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"), "found")


def redact(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping spans, replaced."""

    def cut(v: Column) -> Column:
        # code points of four bytes each, so that a piece is found without reading what is before it
        piece = lambda a, b: F.decode(F.substring(v["wide"], 4 * a + 1, 4 * (b - a)), "UTF-32")
        new = lambda x, i: F.when(x["s"] >= F.get(v["done"], i), F.concat(piece(F.get(v["done"], i), x["s"]), F.lit(by))).otherwise("")
        end = F.array_max(F.transform(v["spans"], lambda x: x["e"]))
        return F.array_join(F.concat(F.transform(v["spans"], new), F.array(piece(end, F.octet_length(v["wide"]) / 4))), "")

    done = running(F.transform(spans, lambda x: x["e"]), F.lit(0), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(F.struct(F.encode(text, "UTF-32").alias("wide"), spans.alias("spans"), done.alias("done")), cut))


def redact_documents(docs: DataFrame, fdr: float = 0.05, text: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; every row stays, and so do the other columns."""
    least = thresholds(docs, fdr, text)
    clean = let(scan(docs[text], least), lambda spans: redact(docs[text], spans))
    return docs.withColumn(text, F.when(docs[text].isNotNull(), clean))
