"""Secret scans: fixed forms, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start alike are listed. `markov` is the method's own.
KINDS = ("assign", "access", "hex", "markov")
#: Fixed forms: the pattern and what a match must hold to count.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Whole runs of 24 or more; a shorter run has no such match within it.
HEX = r"[0-9a-f]{24,}"
#: Strings that the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words that the model of ordinary strings learns from.
PLAIN_WORD = r"[A-Za-z]{6,}"

#: Characters of candidates, each a state; any other ends a string.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Parts of ordinary identifiers.
PARTS = (
    "get set is has add remove find list make load save read write open close start stop run init parse format build check update delete create "
    "user name file path data value key item index count size type text line word page node tree table row column field record user account "
    "number string array object class method function module package version request response message event error result status state time date "
    "client server session cache queue stack buffer stream socket thread process task worker handler manager factory service controller model view "
    "license document language source content summary section paragraph sentence translation international responsibility administration"
).split()


def samples(spark: SparkSession, n: int = 6000, salt: str = "") -> DataFrame:
    """Labelled samples: label 1 random strings (hexadecimal, base 64 of both alphabets, capitals with digits, letters), 0 ordinary ones (snake,
    camel, kebab and path forms of common parts, some with a number or a year, UUIDs, times, versions, rules of one character). Built from
    digests, so always the same; another salt gives others."""
    d = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 512))
    b64 = F.translate(F.base64(F.unhex("h")), "=\r\n", "")
    plain = F.translate(b64, "+/", "")
    kind = F.col("id") % 5
    random = d.select(
        F.when(kind == 0, F.substring("h", 1, 40)).when(kind == 1, F.substring(b64, 1, 40)).when(kind == 2, F.substring(F.upper(plain), 1, 24)).when(kind == 3, F.substring(F.translate(b64, "+/", "-_"), 1, 40)).otherwise(F.substring(F.translate(plain, "0123456789", ""), 1, 32)).alias("text"),
        F.lit(1).alias("label"),
    )
    parts = F.array(*map(F.lit, PARTS))

    def number(k: int, below: int, width: int = 0):
        x = (F.conv(F.substring("h", 1 + 6 * k, 6), 16, 10).cast("int") % below).cast("string")
        return F.lpad(x, width, "0") if width else x

    def part(k: int):
        return F.element_at(parts, (F.conv(F.substring("h", 1 + 6 * k, 6), 16, 10).cast("int") % len(PARTS) + 1).cast("int"))

    four = [part(k) for k in range(4)]
    tail = F.when(F.conv(F.substring("h", 40, 2), 16, 10).cast("int") % 5 == 0, F.col("id").cast("string")).otherwise("")
    year = F.concat(F.lit("20"), number(5, 40, 2))
    uuid = F.concat_ws("-", *[F.substring("h", i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    day = F.concat_ws("-", year, number(6, 13, 2), number(7, 32, 2))
    clock = F.concat_ws("-", number(8, 24, 2), number(9, 60, 2), number(10, 60, 2))
    form = F.col("id") % 11
    rule = F.repeat(F.substring(F.lit(ALPHABET), F.conv(F.substring("h", 1, 6), 16, 10).cast("int") % len(ALPHABET) + 1, F.lit(1)), 24)
    name = (
        F.when(form == 0, F.concat_ws("_", *four)).when(form == 1, F.concat(four[0], *map(F.initcap, four[1:]))).when(form == 2, F.concat_ws("-", *four))
        .when(form == 3, F.concat_ws("/", *four)).when(form == 4, F.concat(*four)).when(form == 5, uuid).when(form == 6, F.concat(day, F.lit("T"), clock, F.lit("Z")))
        .when(form == 7, F.concat(F.initcap(four[0]), four[1], four[2], year)).when(form == 8, F.concat(F.concat_ws("/", *four[:3]), F.lit("-"), year, F.lit("/v"), number(11, 20)))
        .when(form == 9, F.upper(F.concat_ws("_", *four[:3]))).otherwise(rule)
    )
    text = F.when(form < 5, F.concat(name, tail)).otherwise(name)
    return random.unionByName(d.select(text.alias("text"), F.lit(0).alias("label")))


def mined(docs: DataFrame, text_col: str = "text", rows: int = 5_000) -> DataFrame:
    """Distinct labelled strings of about `rows` of the texts, taken by hash of the text: label 1 what the fixed forms find
    (of an assignment its value), if it is a candidate; 0 words of six letters or more that are in no
    candidate, as those are yet to be judged."""
    n = max(1, docs.count())
    few = docs.where(F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))) if n > rows else docs
    df = _masked(few.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    value = f"CASE WHEN x.kind = 0 THEN regexp_extract(x.m, '{_quoted(ASSIGN)}', 2) ELSE x.m END"
    one = df.select(F.explode(F.expr(f"filter(transform(_base, x -> {value}), v -> v RLIKE '^{CANDIDATE}$')")).alias("text"), F.lit(1).alias("label"))
    two = df.select(F.explode(F.expr(f"array_distinct(regexp_extract_all(regexp_replace(_rest, '{CANDIDATE}', ' '), '{PLAIN_WORD}', 0))")).alias("text"), F.lit(0).alias("label"))
    return one.unionByName(two).distinct()


def train(*labelled: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each step between two states, the start state last; row-major.

    labelled: text, label; of several, none has more weight than the first, so that many plain words don't hide how
    identifiers go on. Of strings beyond 64 characters a step counts once, so that no long
    string outweighs others. Steps are counted on the executors; at most states squared counts per label come back."""
    size = len(ALPHABET) + 1
    counts = [[smoothing] * (size * size) for _ in range(2)]
    first: list[float] = []
    for frame in labelled:
        chars = F.filter(F.split("text", ""), lambda c: c != "")
        both = frame.select("label", chars.alias("b")).withColumn("a", F.expr("concat(array(''), slice(b, 1, size(b) - 1))")).where("size(b) > 0")
        steps = both.select("label", F.explode(F.when(F.size("b") <= 64, F.arrays_zip("a", "b")).otherwise(F.array_distinct(F.arrays_zip("a", "b")))).alias("s")).groupBy("label", "s.a", "s.b").count().collect()
        totals = [sum(r["count"] for r in steps if r.label == k) for k in (0, 1)]
        first = first or totals
        for r in steps:
            i, j = ALPHABET.find(r.a) if r.a else size - 1, ALPHABET.find(r.b)
            if i >= 0 and j >= 0:
                counts[r.label][i * size + j] += r["count"] * min(1.0, first[r.label] / totals[r.label])
    sums = [[sum(c[i * size : i * size + size - 1]) for i in range(size)] for c in counts]
    return [math.log(counts[1][k] / sums[1][k // size]) - math.log(counts[0][k] / sums[0][k // size]) for k in range(size * size)]


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _running(values: str, step: str) -> str:
    """SQL for the running values before each item of an array of INT: what `step` (of a, from 0, and item x) has made of the
    items before. The array is cut into about as many pieces as each has items, for an array that grows item by item
    costs the square of its length."""

    def along(items: str, start: str) -> str:
        return f"aggregate({items}, struct({start} AS a, CAST(array() AS ARRAY<INT>) AS out), (c, x) -> struct({step.format(a='c.a', x='x')} AS a, concat(c.out, array(c.a)) AS out)).out"

    pieces = "transform(sequence(0, (size(w.v) - 1) div w.b), k -> slice(w.v, k * w.b + 1, w.b))"
    totals = f"transform(ps, p -> aggregate(p, 0, (c, x) -> {step.format(a='c', x='x')}))"
    whole = f"transform(array({pieces}), ps -> flatten(zip_with(ps, {along(totals, '0')}, (p, o) -> {along('p', 'o')})))[0]"
    return f"transform(array({values}), v -> transform(array(struct(v AS v, CAST(ceil(sqrt(size(v))) AS INT) AS b)), w -> {whole})[0])[0]"


SPANS = "ARRAY<STRUCT<s: INT, e: INT, kind: INT, m: STRING>>"


def _spans(kind: str, pattern: str, ok: str, text: str = "text") -> str:
    """SQL for the spans of a pattern in a column: pieces between matches and matches alternate, so running sums of their
    lengths are the places. Leftmost, non-overlapping, in code points, the end exclusive; `ok` is a test of match m."""
    quoted = _quoted(pattern)
    lengths = "transform(z.m, (m, i) -> length(z.p[i]) + length(m))"
    spans = f"transform(z.m, (m, i) -> struct(q[i] + length(z.p[i]) AS s, q[i] + length(z.p[i]) + length(m) AS e, {KINDS.index(kind)} AS kind, m AS m))"
    return f"""CASE WHEN {text} RLIKE '{quoted}' THEN transform(array(struct(split({text}, '{quoted}', -1) AS p, regexp_extract_all({text}, '{quoted}', 0) AS m)), z ->
      filter(transform(array({_running(lengths, '{a} + {x}')}), q -> {spans})[0], x -> {ok.format(m="x.m")}))[0] ELSE CAST(array() AS {SPANS}) END"""


def _replaced(text: str, spans: str, by: str) -> str:
    """SQL for the text with each stretch of overlapping spans replaced by `by`, an expression of span x and of `o`, how far
    the spans before it reach. Cuts are made in UTF-32, where a place needs no search."""
    cut = "decode(substring(u.t, 4 * ({0}) + 1, 4 * greatest(0, ({1}) - ({0}))), 'UTF-32')"
    each = f"flatten(transform(u.x, (x, i) -> transform(array(u.o[i]), o -> array({cut.format('o', 'x.s')}, {by}))[0]))"
    rest = cut.format("greatest(u.o[size(u.o) - 1], u.x[size(u.x) - 1].e)", "length(u.t) div 4")
    upto = _running(f"transform({spans}, x -> x.e)", "greatest({a}, {x})")
    return f"""CASE WHEN size({spans}) = 0 THEN {text} ELSE
      transform(array(struct(encode({text}, 'UTF-32') AS t, {spans} AS x, {upto} AS o)), u -> array_join(concat({each}, array({rest})), ''))[0] END"""


def _masked(df: DataFrame) -> DataFrame:
    """df, which has text, with the spans of the fixed forms, `_base` by start and kind, and the text with blanks in their
    place, `_rest`."""
    group = _quoted(ASSIGN)
    forms = {"assign": (ASSIGN, f"length(regexp_extract({{m}}, '{group}', 2)) >= 6"), "access": (ACCESS, "length({m}) >= 20"), "hex": (HEX, "true")}
    df = df.withColumns({f"_{kind}": F.expr(_spans(kind, *form)) for kind, form in forms.items()})
    order = "(a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE a.kind - b.kind END"
    df = df.withColumn("_base", F.expr(f"array_sort(concat(_assign, _access, _hex), {order})")).drop("_assign", "_access", "_hex")
    return df.withColumn("_rest", F.expr(_replaced("text", "_base", "repeat(' ', greatest(0, x.e - greatest(x.s, o)))")))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = 10.0, share: float = 0.2, text_col: str = "text", keep: list | None = None) -> DataFrame:
    """`spans` of each document: array of struct(s, e, kind, m), by start, then kind.

    The fixed forms come first. Then each candidate string of 16 or more characters that lies outside their spans is
    scored by the log-likelihood ratio of its character steps, the sum over the string, and taken if that is over
    `threshold` and over `share` a character. Without a model, one is trained on samples() and on what is mined() from
    docs.

    Other columns: those of `keep`, or all of docs as struct `row`. Null texts have no spans. Texts of any length are
    scanned whole, in time that grows with their length and little more with the number of their spans. All work is in
    SQL expressions; a pattern's places are worked out only where it matches.
    """
    keep = keep if keep is not None else [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    model = model if model is not None else train(samples(docs.sparkSession), mined(docs, text_col))
    size = len(ALPHABET) + 1
    df = _masked(docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    df = df.withColumn("_markov", F.expr(_spans("markov", CANDIDATE, "true", "_rest")))
    table = "array(" + ", ".join(f"{x:.6f}D" for x in model) + ")"
    state = "array(" + ", ".join(str(ALPHABET.find(chr(i))) for i in range(128)) + ")"
    codes = "transform(split(x.m, ''), c -> g.s[ascii(c)])"
    score = f"transform(array({codes}), cs -> aggregate(zip_with(concat(array({size - 1}), slice(cs, 1, size(cs) - 1)), cs, (a, b) -> g.t[a * {size} + b]), 0D, (acc, v) -> acc + v))[0]"
    likely = f"""CASE WHEN size(_markov) = 0 THEN _markov ELSE transform(array(struct({table} AS t, {state} AS s)), g ->
        filter(_markov, x -> {score} > greatest({threshold}D, {share}D * length(x.m))))[0] END"""
    df = df.withColumn("_found", F.expr(likely))
    spans = F.expr("array_sort(concat(_base, _found), (a, b) -> CASE WHEN a.s <> b.s THEN a.s - b.s ELSE a.kind - b.kind END)")
    return df.withColumn("spans", spans).drop("text", "_base", "_rest", "_found", "_markov")


def redacted(docs: DataFrame, mark: str = "[REDACTED]", text_col: str = "text", **options) -> DataFrame:
    """docs with each stretch of overlapping spans replaced by `mark`; other texts, null too, are as they were."""
    found = scan(docs, text_col=text_col, **options)
    quoted = mark.replace("\\", "\\\\").replace("'", "\\'")
    clean = F.expr(_replaced(f"row.`{text_col}`", "spans", f"CASE WHEN x.s < o THEN '' ELSE '{quoted}' END"))
    return found.select(*[(clean if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    names = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), x.kind + 1)"
    listed = "array_join(transform({0}, x -> concat(" + names + ", ':', x.s, ':', x.e)), ',')"
    base = f"filter(spans, x -> x.kind < {KINDS.index('markov')})"
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.kind = {i})) AS BIGINT)").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(F.expr(listed.format(base)).cast("binary"), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))
