"""Secret scans: patterns, and a battery of randomness tests with control of false discoveries.

Patterns give the base spans (``assign``, ``access``, ``hex``). On top, every token of ``min_chars`` or more letters, digits and ``+/_=-`` that mixes
letters with digits is tested. Its encoding is the smallest alphabet that holds it (hexadecimal, base 32, base 36, letters and digits, base 64).
A ``=`` ends a token unless only padding and the end of the run follow. A token that no alphabet holds, because it has ``+`` or ``/`` and also ``_`` or ``-``, is tested
against all of these characters, and so is each of its parts of ``min_chars`` letters and digits between them; parts of a random token are not told again.
Against the hypothesis that its characters are drawn from that alphabet at random stand three tests: chi-squared for equal frequencies, runs
above and below the middle of the alphabet, and serial correlation of neighbours. The least of the three p-values, times three, is the
token's. Within each class of lengths (by powers of two) the Benjamini-Hochberg rule at rate ``q``, over all tokens of all documents,
tells which tokens are not random; the others become ``random`` spans. Classes of lengths are kept apart because short tokens can fail
a test only by chance, and would lend their number to long ones.

All of it is DataFrame functions. Positions come from the lengths of matches and of what lies between them. No text is
shuffled; documents' spans are written once, and the rule needs one count per length class and step of the p-values.

Spans count code points, with an exclusive end. A random token that equals a hex span is not repeated; it may lie inside an ``assign`` span.

Defined cases: a null or empty text has no spans. Repeated rows and null ids are scanned like others; extra columns are not read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.functions.text import compute_once
from topicloom.llm.common import require, text_or_empty
from topicloom.session import cut_lineage

# What each kind of span looks like (a run of hex digits shorter than 32 is no span).
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
# Alphabets by size, in the order of their codes.
_BASE = string.ascii_uppercase + string.ascii_lowercase + string.digits
ALPHABETS = {
    "hex": string.digits + "abcdef", "HEX": string.digits + "ABCDEF", "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase, "BASE36": string.digits + string.ascii_uppercase, "alnum": _BASE,
    "base64": _BASE + "+/", "base64url": _BASE + "-_",
}
_ALL = _BASE + "+/-_"
_BODY = "A-Za-z0-9+/_-"
_STEP = 100  # p-values are told apart to this many steps per power of ten
_LAST = 1600


def _places(text: Column, pattern: str, group: int = 0) -> Column:
    """``(start, end, body)`` of all matches from left to right; ``body`` is the length of a group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bodies = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), whole, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"))),
        bodies, lambda x, b: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.length(b).alias("body")),
    )
    span = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["body"].alias("body"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,body:int>>").alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["size"]).alias("at"), F.concat(acc["spans"], F.array(span(acc["at"], x))).alias("spans"))
    return F.when(text.rlike(pattern), F.aggregate(sizes, empty, step)["spans"]).otherwise(F.array().cast("array<struct<start:int,end:int,body:int>>"))


def _tail(z: Column) -> Column:
    """The upper tail of the normal distribution for ``z >= 0`` (a known approximation, good to 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * series, F.lit(1e-300))


def alphabet_of(token: Column) -> Column:
    """The smallest alphabet that holds a token without its padding, or null."""
    bare = F.regexp_replace(token, "=+$", "")
    found = F.lit(None).cast("string")
    for letters in reversed(ALPHABETS.values()):
        found = F.when(F.length(F.translate(bare, letters, "")) == 0, F.lit(letters)).otherwise(found)
    return F.when(bare.rlike("[A-Za-z]") & bare.rlike("[0-9]"), found)


def token_p_value(token: str, alphabet: str, df: DataFrame) -> DataFrame:
    """``df`` with ``p``: three times the least p-value of the three tests of the column ``token``."""
    values = F.transform(F.split(F.regexp_replace(token, "=+$", ""), ""), lambda c: F.instr(F.col(alphabet), c) - 1)
    df = compute_once(df, {"_v": F.filter(values, lambda v: v >= 0)})
    n, size = F.size("_v").cast("double"), F.length(alphabet).cast("double")
    add = lambda acc, x: acc + x
    total = lambda column: F.aggregate(column, F.lit(0.0), add)
    # Values are sorted so that equal ones stand together: squared counts are sums of (2 i + 1) over the places in a row of equals.
    ordered = F.array_sort("_v")
    df = compute_once(df, {"_s": ordered})
    rows = F.aggregate(
        "_s", F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("row"), F.lit(0.0).alias("sum")),
        lambda acc, v: F.struct(
            v.alias("last"), F.when(v == acc["last"], acc["row"] + 1).otherwise(0.0).alias("row"),
            (acc["sum"] + F.when(v == acc["last"], 2 * acc["row"] + 3).otherwise(1.0)).alias("sum"),
        ),
    )["sum"]
    chi = rows * size / n - n
    free = size - 1
    z_chi = (chi - free) / F.sqrt(2 * free * (n - 1) / n)
    high = F.transform("_v", lambda v: v >= F.length(F.col(alphabet)) / 2)
    ones = F.aggregate(F.transform("_v", lambda v: (v >= F.length(F.col(alphabet)) / 2).cast("double")), F.lit(0.0), add)
    zeros = n - ones
    df = compute_once(df, {"_high": high, "_mean": total(F.transform("_v", lambda v: v.cast("double"))) / n})
    short = F.size("_high") - 1
    turns = F.aggregate(
        F.zip_with(F.slice("_high", F.lit(1), short), F.slice("_high", F.lit(2), short), lambda a, b: (a != b).cast("double")), F.lit(1.0), add
    )
    expected = 2 * ones * zeros / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    z_runs = F.when(spread > 0, F.abs(turns - expected) / F.sqrt(spread)).otherwise(40.0)
    off = lambda v: v - F.col("_mean")
    cross = total(F.zip_with(F.slice("_v", F.lit(1), short), F.slice("_v", F.lit(2), short), lambda a, b: off(a) * off(b)))
    own = total(F.transform("_v", lambda v: off(v) * off(v)))
    z_serial = F.when(own > 0, F.abs(cross / own + 1 / n) * F.sqrt(n)).otherwise(40.0)
    least = F.least(F.when(z_chi > 0, _tail(z_chi)).otherwise(0.5), 2 * _tail(z_runs), 2 * _tail(z_serial))
    return df.withColumn("p", F.least(3 * least, F.lit(1.0))).drop("_v", "_s", "_high", "_mean")


def scan(docs: DataFrame, min_chars: int = 20, q: float = 0.01) -> DataFrame:
    """``(doc_id, base, random)`` per document: arrays of ``(start, kind, end)``, kinds numbered as listed."""
    texts = require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    padding = rf"=+(?![={_BODY}])"
    token = rf"(?<![{_BODY}])(?:[{_BODY}]{{{min_chars},}}+(?:{padding})?|[{_BODY}]++{padding})"
    found = compute_once(
        texts,
        {
            "assign": F.filter(_places(F.col("text"), ASSIGN, 1), lambda s: s["body"] >= 8),
            "access": F.filter(_places(F.col("text"), ACCESS), lambda s: s["body"] >= 16),
            "hex": _places(F.col("text"), HEX),
            "token": F.filter(_places(F.col("text"), token), lambda s: s["body"] >= min_chars),
        },
    )
    numbered = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))
    base = F.array_sort(F.concat(*(numbered(c, k) for k, c in enumerate(KINDS[:3]))))
    cuts = F.transform(
        "token",
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col("text"), s["start"] + 1, s["body"]).alias("text")),
    )
    plain = F.transform("hex", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    fresh = F.filter(cuts, lambda s: ~F.array_contains(plain, F.struct(s["start"].alias("start"), s["end"].alias("end"))) & s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
    spans = cut_lineage(found.select("doc_id", F.monotonically_increasing_id().alias("row"), base.alias("base"), fresh.alias("fresh"), plain.alias("plain")))

    whole = spans.select("row", "plain", F.explode("fresh").alias("t")).select("row", "plain", "t.*").withColumn("alphabet", alphabet_of(F.col("text")))
    # ``outer`` is the start of a token; of a part it is that of the token around it, as ``-1 - start``.
    part = whole.where("alphabet is null").select("row", "plain", F.col("start").alias("outer"), "text", F.explode(_places(F.col("text"), rf"[A-Za-z0-9]{{{min_chars},}}+(?:=+$)?")).alias("p"))
    part = part.select("row", "plain", "outer", (F.col("outer") + F.col("p.start")).alias("start"), (F.col("outer") + F.col("p.end")).alias("end"), F.substring("text", F.col("p.start") + 1, F.col("p.body")).alias("text"))
    part = part.where(~F.array_contains("plain", F.struct("start", "end"))).withColumn("alphabet", alphabet_of(F.col("text"))).where("alphabet is not null")
    names = ("row", "outer", "start", "end", "text", "alphabet")
    tokens = whole.withColumn("outer", F.col("start")).withColumn("alphabet", F.coalesce("alphabet", F.lit(_ALL))).select(*names)
    tokens = tokens.unionByName(part.withColumn("outer", -1 - F.col("outer")).select(*names))
    tested = token_p_value("text", "alphabet", tokens)
    step = F.least(F.floor(-F.log10("p") * _STEP), F.lit(_LAST)).cast("int")
    tested = cut_lineage(tested.select("row", "outer", "start", "end", F.floor(F.log2(F.col("end") - F.col("start"))).cast("int").alias("length"), step.alias("step")))
    # Every step and length class is one row, however many tokens there are.
    counts = tested.groupBy("length", "step").agg(F.count(F.lit(1)).alias("n"))
    down = W.partitionBy("length").orderBy(F.col("step").desc())
    ranked = counts.withColumn("rank", F.sum("n").over(down)).withColumn("m", F.sum("n").over(W.partitionBy("length")))
    passed = ranked.where(F.pow(F.lit(10.0), -F.col("step") / _STEP) <= q * F.col("rank") / F.col("m"))
    limits = passed.groupBy("length").agg(F.min("step").alias("limit"))
    kept = tested.join(limits, "length", "left").where("limit is null or step < limit")
    random = kept.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(3).alias("kind"), "end", "outer")).alias("found"))
    outers = F.transform("found", lambda s: s["outer"])
    outermost = F.filter("found", lambda s: (s["outer"] >= 0) | ~F.array_contains(outers, -1 - s["outer"]))
    random = random.select("row", F.array_sort(F.transform(outermost, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).alias("random"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return spans.join(random, "row", "left").select("doc_id", "base", F.coalesce("random", none).alias("random"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
