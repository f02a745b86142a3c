"""Secret scans with DataFrame functions only: fixed patterns and a randomness test battery.

Base spans come from three patterns (assignments, access keys, long hex). The battery looks at
every other unbroken token of ``TOKEN`` characters with a letter and a digit. The smallest
alphabet that holds the token is its encoding; under that encoding the token is tested for
randomness: chi-squared uniformity over the alphabet, runs above and below the middle, and serial
correlation of neighbours. The smallest of the three p-values (times three) is the token's p. The
tokens of a stratum (encoding and length class, since short strings leave little to test) go
through Benjamini-Hochberg at ``FDR``: rejected tokens are structured text, the others are random
strings and are reported as ``random`` spans.

The text is read once; the spans and candidate tokens of all rows are written to the checkpoint
folder, p-values are counted on a grid per stratum (at most 8 x 17 strata come to the driver), and
the last step is a map. Spans count code points, the end is exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.session import cut_lineage

#: Fixed values of the contract: patterns of the base spans, least sizes.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = "AKIA[A-Z0-9]{12,}"       # a run of 16 or more: shorter runs fail at any start inside
HEX = "[0-9a-f]{32,}"
ASSIGN_LEAST = 8
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FDR = 0.01
GRID = 10                           # p-value buckets a unit of -ln p
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings, smallest alphabet first: (pattern that a token matches whole, alphabet).
ENCODINGS = [("[0-9a-f]+", DIGITS + "abcdef"), ("[0-9A-F]+", DIGITS + "ABCDEF"),
             ("[A-Z2-7]+", UPPER + "234567"), ("[0-9a-z]+", DIGITS + LOWER), ("[0-9A-Z]+", DIGITS + UPPER),
             ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER), ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
             ("[0-9A-Za-z+/_-]+", UPPER + LOWER + DIGITS + "+/_-")]
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
_CAND = "array<struct<start:int,token:string>>"


def _running(x: Column) -> Column:
    """Exclusive prefix sums with the total at the end."""
    return F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))


def prefix_sums(x: Column, block: int = 128) -> Column:
    """Exclusive prefix sums of an int array, by blocks, so that a row with very many matches
    costs about ``block`` steps a match."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                        lambda b: F.slice(x, b * block + 1, F.lit(block)))
    before = _running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, v: a + v)))
    each = F.zip_with(parts, before, lambda p, o: F.when(p.isNotNull(), F.transform(
        F.slice(_running(p), F.lit(1), F.size(p)), lambda v: v + o)))
    return F.when(F.size(x) > 0, F.flatten(F.filter(each, lambda e: e.isNotNull()))).otherwise(
        F.array().cast("array<int>"))


def located(text: Column, pattern: str, hit: Column) -> Column:
    """array<struct<start, match>> of all matches, from the matches and the gaps between them;
    empty unless ``hit`` (a cheap test that holds wherever there is a match)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.char_length(g)).alias("g"))
    steps = F.transform(both, lambda e: e["g"] + F.char_length(e["m"]))
    full = F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.char_length(g)).alias("g"),
                        prefix_sums(steps).alias("p"))
    out = F.transform(full, lambda e: F.struct((e["p"] + e["g"]).alias("start"), e["m"].alias("match")))
    return F.when(hit, out).otherwise(F.array().cast("array<struct<start:int,match:string>>"))


def _as_spans(found: Column, kind: int, value=lambda m: m) -> Column:
    return F.transform(found, lambda e: F.struct(
        e["start"].alias("start"), F.lit(kind).alias("kind"),
        (e["start"] + F.char_length(e["match"])).alias("end"), value(e["match"]).alias("value")))


def base_spans(text: Column) -> Column:
    low = F.lower(text)
    word = F.lit(False)
    for k in KEYWORDS:
        word = word | F.contains(low, F.lit(k))
    assign = _as_spans(located(text, ASSIGN, word), 0, lambda m: F.regexp_extract(m, ASSIGN, 2))
    return F.array_sort(F.concat(
        F.filter(assign, lambda s: F.char_length(s["value"]) >= ASSIGN_LEAST),
        _as_spans(located(text, ACCESS, F.contains(text, F.lit("AKIA"))), 1),
        _as_spans(located(text, HEX, text.rlike(HEX)), 2))).cast(_SPAN)


def candidates(text: Column, spans: Column) -> Column:
    """Tokens with a letter and a digit that overlap no base span."""
    found = F.transform(located(text, TOKEN, text.rlike("[A-Za-z0-9+/_-]{20}")),
                        lambda e: F.struct(e["start"].alias("start"), e["match"].alias("token")))
    mixed = F.filter(found, lambda e: e["token"].rlike("[0-9]") & e["token"].rlike("[A-Za-z]"))
    return F.filter(mixed, lambda e: ~F.exists(spans, lambda s: (s["start"] < e["start"] + F.char_length(e["token"]))
                                               & (e["start"] < s["end"]))).cast(_CAND)


# --------------------------------------------------------------------------- the test battery
def _core(token: Column) -> Column:
    return F.rtrim(token, F.lit("="))


def _pick(token: Column, of) -> Column:
    out = None
    for i, (pattern, alphabet) in enumerate(ENCODINGS):
        cond = token.rlike(f"^{pattern}$")
        out = F.when(cond, of(i, alphabet)) if out is None else out.when(cond, of(i, alphabet))
    return out


def stratum(token: Column) -> Column:
    """Encoding and length class in one number."""
    t = _core(token)
    return _pick(t, lambda i, a: F.lit(i)) * 100 + F.least(F.floor(F.char_length(t) / 8), F.lit(16)).cast("int")


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution at |z| (26.2.17 of the NBS handbook)."""
    z = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def p_value(token: Column) -> Column:
    """Combined p of the three randomness tests; close to 0 for structured text."""
    t = _core(token)
    n = F.char_length(t).cast("double")
    m = _pick(t, lambda i, a: F.lit(float(len(a))))
    alphabet = _pick(t, lambda i, a: F.lit(a))
    chars = F.transform(F.sequence(F.lit(1), F.char_length(t)), lambda i: F.substring(t, i, F.lit(1)))
    x = F.transform(chars, lambda c: F.instr(alphabet, c).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    # chi-squared uniformity, by the cube-root normal approximation
    squares = total(F.transform(F.array_distinct(chars), lambda c: F.pow(n - F.char_length(F.replace(t, c, F.lit(""))), F.lit(2.0))))
    df = m - 1
    cube = F.pow((m / n * squares - n) / df, F.lit(1 / 3))
    z_chi = (cube - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    p_chi = F.when(z_chi >= 0, _tail(z_chi)).otherwise(1 - _tail(z_chi))
    # runs above and below the middle of the alphabet
    side = F.transform(x, lambda v: (v > m / 2).cast("double"))
    pairs = lambda a, f: total(F.zip_with(F.slice(a, F.lit(1), F.char_length(t) - 1),
                                          F.slice(a, F.lit(2), F.char_length(t) - 1), f))
    above = total(side)
    runs = 1 + pairs(side, lambda a, b: F.abs(a - b))
    both = 2 * above * (n - above)
    mean = both / n + 1
    spread = both * (both - n) / (n * n * (n - 1))
    p_runs = F.when(spread > 0, 2 * _tail((runs - mean) / F.sqrt(spread))).otherwise(F.lit(1.0))
    # serial correlation of neighbouring characters
    centre = total(x) / n
    power = total(F.transform(x, lambda v: v * v)) - n * centre * centre
    serial = pairs(x, lambda a, b: a * b) - centre * (2 * total(x) - F.element_at(x, 1) - F.element_at(x, -1)) \
        + (n - 1) * centre * centre
    p_serial = F.when(power > 0, 2 * _tail(serial / power * F.sqrt(n))).otherwise(F.lit(1.0))
    return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial))


def bucket(token: Column) -> Column:
    """Grid cell of -ln p."""
    return F.floor(-F.ln(F.greatest(p_value(token), F.lit(1e-300))) * GRID).cast("int")


def cutoffs(tokens: DataFrame, fdr: float = FDR) -> dict:
    """Per stratum the least grid cell that Benjamini-Hochberg rejects (all p at or below the
    cell's upper edge), from one row ``token`` a candidate. Counts only; strata are few."""
    cells = (tokens.select(stratum(F.col("token")).alias("s"), bucket(F.col("token")).alias("b"))
             .groupBy("s", "b").agg(F.count("*").alias("n")))
    down = Window.partitionBy("s").orderBy(F.desc("b"))                  # some 7,000 cells at most
    cells = (cells.withColumn("rejected", F.sum("n").over(down))
             .withColumn("tests", F.sum("n").over(Window.partitionBy("s"))))
    ok = cells.where(F.col("rejected") * fdr >= F.col("tests") * F.exp(-F.col("b") / F.lit(float(GRID))))
    return {r.s: r.b for r in ok.groupBy("s").agg(F.min("b").alias("b")).collect()}


def _random_spans(cands: Column, limits: dict) -> Column:
    limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv]) if limits else None
    keep = (lambda e: F.lit(True)) if limit is None else (lambda e: F.coalesce(
        bucket(e["token"]) < F.element_at(limit, stratum(e["token"])), F.lit(True)))
    return F.transform(F.filter(cands, keep), lambda e: F.struct(
        e["start"].alias("start"), F.lit(3).alias("kind"),
        (e["start"] + F.char_length(e["token"])).alias("end"), e["token"].alias("value"))).cast(_SPAN)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scan(docs: DataFrame) -> DataFrame:
    """(r, text, base, cands): the row as a struct, so that no column name can clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.struct("*").alias("r"), text.alias("text"), base_spans(text).alias("base"))
    return base.select("r", "text", "base", candidates(F.col("text"), F.col("base")).alias("cands"))


def secret_scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: counts of the base spans, the SHA-256 of their
    list, and all spans, each ``kind:start:end`` by start, then kind. Null and empty texts have no
    spans; repeated rows stay repeated (and count as often in the tests); other columns are
    ignored; an empty table gives an empty result."""
    slim = cut_lineage(_scan(docs.select("doc_id", "text")).select("r.doc_id", "base", "cands"))
    limits = cutoffs(slim.select(F.explode("cands").alias("c")).select("c.token"), fdr)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return slim.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", _random_spans(F.col("cands"), limits)))).alias("spans"))


def _running_max(x: Column, block: int = 128) -> Column:
    """For every entry of an array of ints the largest one before it (0 for the first), by blocks."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                        lambda b: F.slice(x, b * block + 1, F.lit(block)))
    grow = lambda first, a: F.slice(F.aggregate(a, F.array(first), lambda s, v: F.concat(
        s, F.array(F.greatest(F.element_at(s, -1), v)))), F.lit(1), F.size(a))
    before = grow(F.lit(0), F.transform(parts, lambda p: F.array_max(p)))
    return F.flatten(F.zip_with(parts, before, lambda p, b: grow(b, p)))


def masked(text: Column, ranges: Column, mask: str) -> Column:
    """``text`` with the character ranges array<struct<start, end>> replaced by ``mask``; ranges that
    overlap or touch become one."""
    r = F.array_sort(ranges)
    upto = _running_max(F.transform(r, lambda x: x["end"]))
    cuts = F.arrays_zip(r.alias("r"), upto.alias("upto"))
    apart = F.filter(cuts, lambda c: (c["r"]["start"] > c["upto"]) | ((c["r"]["start"] == 0) & (c["upto"] == 0)))
    pieces = F.transform(apart, lambda c: F.concat(
        F.substring(text, c["upto"] + 1, c["r"]["start"] - c["upto"]), F.lit(mask)))
    last = F.array_max(F.transform(ranges, lambda x: x["end"]))
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.char_length(text)))


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """``docs`` with the value of every secret span replaced by ``mask``, where it stands; the same
    words elsewhere stay. Values that overlap or touch become one mask. The columns stay
    (``n_chars``, if there is one, is counted anew for changed texts); null texts and texts without a
    secret are not touched. Texts are searched once and wait in the checkpoint folder for the limits."""
    found = cut_lineage(_scan(docs).select("r", "base", "cands"))
    limits = cutoffs(found.select(F.explode("cands").alias("c")).select("c.token"), fdr)
    spans = F.concat("base", _random_spans(F.col("cands"), limits))
    ranges = F.transform(spans, lambda s: F.struct(
        (s["end"] - F.char_length(s["value"])).alias("start"), s["end"].alias("end")))
    out = found.select("r", F.filter(ranges, lambda x: x["start"] < x["end"]).alias("ranges"))
    some, text = F.size("ranges") > 0, F.col("r.text")
    out = out.select("r", some.alias("some"), F.when(some, masked(text, F.col("ranges"), mask)).otherwise(text).alias("clean"))
    fields = {c: F.col("r")[c] for c in docs.columns} | {"text": F.col("clean")}
    if "n_chars" in fields:
        fields["n_chars"] = F.when(F.col("some"), F.char_length("clean").cast(docs.schema["n_chars"].dataType)) \
            .otherwise(fields["n_chars"])
    return out.select([v.alias(c) for c, v in fields.items()])
