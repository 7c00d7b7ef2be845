"""Operator 10: secret scans, in DataFrame operations only.

Base rules find assignments, access keys and long hex runs. Beside them two
first-order Markov models over characters, one of random strings and one of
ordinary identifiers, score every long token: the log-likelihood ratio of its
character pairs is summed, and a token whose ratio exceeds the prior odds is a
secret too. Both models are counted by DataFrame aggregates from labelled samples:
strings drawn at random, and identifiers made of a fixed list of words and of the words
of a bounded sample of the texts themselves.

Places are code points, end exclusive. Spark has no function for the places of all
matches; they follow from the lengths of the matches and of what split() leaves
between them.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, text_of, without

#: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ with 32 characters or more
)
KIND = "markov"

#: Long tokens that stand alone; shorter ones carry too little evidence.
TOKEN = r"(?<![\p{L}\p{N}+/_=-])[A-Za-z0-9+/_=-]{20,}+(?![\p{L}\p{N}])"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"

#: Natural log of how much likelier an ordinary token is before its characters are seen.
PRIOR_NATS = 10.0
#: Labelled strings of either class, the bound of the training sample.
SAMPLE_STRINGS = 20_000
#: Texts, and of these the most frequent words, that ordinary identifiers are made of beside WORDS.
SAMPLE_TEXTS = 1_000
SAMPLE_WORDS = 2_000

#: Words of which ordinary identifiers are made.
WORDS = (
    "account action address after amount array before border buffer button cache call change channel check child "
    "class client close code color column command config connect content context count create current data date "
    "default delete detail device display document email entry error event factory field file filter find first "
    "format frame group handle header height image index input insert item language last layout length level list "
    "load local manager message method model name node number object offset option order output page parent parse "
    "path position process project query range read record remove report request result return schema search "
    "select server service session size source start state status string style table target test text time title "
    "total type update user value version view width window write "
    "nachricht sprache wichtig zeichen straße schule freundlich verbindung einstellung gesellschaft "
    "bonjour maison travail toujours semaine quelque ensemble lumière mouvement naissance "
    "ciudad mañana trabajo siempre palabra gobierno mientras corazón escuela pregunta"
)


def words_of_sample(docs: DataFrame, text: str = "text") -> list[str]:
    """The SAMPLE_WORDS most frequent words of 3 to 12 letters (ties by name) of about SAMPLE_TEXTS texts."""
    share = min(1.0, SAMPLE_TEXTS / max(docs.count(), 1))
    words = F.explode(F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"(?<![\p{L}\p{N}])[a-z]{3,12}(?![\p{L}\p{N}])"), F.lit(0)))
    counts = docs.sample(share, seed=10).select(words.alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.col("n").desc(), "w").limit(SAMPLE_WORDS).collect()]


def labelled(spark: SparkSession, n: int = SAMPLE_STRINGS, more: list[str] | None = None) -> DataFrame:
    """(id, s, random): n random strings and n ordinary identifiers of WORDS and, as often, of
    the words `more`; the same in every run.

    Random: hex, base64 and upper case alphanumeric strings of 16 to 40 characters
    from SHA-256. Ordinary: two to four words joined by _, -, /, nothing, or as camel
    case, some of them with a short number behind.
    """
    fixed, more = WORDS.split(), more or WORDS.split()
    # Parts of an odd id are of the one list, those of an even id of the other.
    lists = [F.from_json(F.lit(json.dumps(x, ensure_ascii=False)), "array<string>") for x in (fixed, more)]
    ids = spark.range(n)
    digest = F.sha2(F.concat(F.lit("secret-"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    size = F.lit(16) + F.col("id") % 25
    form = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, b64).otherwise(F.upper(F.regexp_replace(b64, "[+/]", "7")))
    random = ids.select("id", F.substring(form, F.lit(1), size.cast("int")).alias("s"), F.lit(True).alias("random"))

    def pick(k: int) -> Column:
        first, second = (F.get(x, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(found))).cast("int")) for x, found in zip(lists, (fixed, more), strict=True))
        return F.when(F.col("id") % 2 == 1, first).otherwise(second)

    parts = F.slice(F.array(*[pick(k) for k in range(4)]), F.lit(1), (2 + F.col("id") % 3).cast("int"))
    camel = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.initcap(x))), "")
    style = F.pmod(F.xxhash64("id", F.lit("style")), F.lit(6))
    joined = reduce(lambda c, p: c.when(style == p[0], p[1]), [(k, F.array_join(parts, by)) for k, by in ((1, "_"), (2, "-"), (3, ""), (4, "/"))], F.when(style == 0, camel))
    joined = joined.otherwise(F.upper(F.array_join(parts, "_")))
    number = F.when(F.pmod(F.xxhash64("id", F.lit("number")), F.lit(5)) == 0, (F.col("id") % 100).cast("string")).otherwise("")
    ordinary = ids.select("id", F.concat(joined, number).alias("s"), F.lit(False).alias("random"))
    return random.unionByName(ordinary)


def pair_codes(s: Column) -> Column:
    """Codes of neighbouring characters, of pairs within the alphabet."""
    size = len(ALPHABET)
    place = F.transform(F.split(s, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))
    pairs = let(place, lambda p: F.transform(F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda c, i: F.when((c > 0) & (F.get(p, i) > 0), (F.get(p, i) - 1) * size + c - 1)))
    return F.filter(pairs, lambda c: c.isNotNull())


def train(sample: DataFrame) -> list[float]:
    """Log-likelihood ratio of each pair of characters, random over ordinary.

    Counted with one added to every pair; the probability is that of the second
    character after the first. The table has len(ALPHABET)**2 entries, whatever the
    sample's size, and is all that reaches the driver.
    """
    size = len(ALPHABET)
    codes = sample.select("random", F.explode(pair_codes(F.col("s"))).alias("code"))
    counts = codes.groupBy("code").agg(F.count(F.when(F.col("random"), 1)).alias("r"), F.count(F.when(~F.col("random"), 1)).alias("o"))
    grid = sample.sparkSession.range(size * size).select(F.col("id").cast("int").alias("code")).join(counts, "code", "left").na.fill(0, ["r", "o"])
    by_first = grid.groupBy(F.floor(F.col("code") / size).cast("int").alias("a")).agg(F.sum("r").alias("tr"), F.sum("o").alias("to"))
    ratio = F.log((F.col("r") + 1) / (F.col("tr") + size)) - F.log((F.col("o") + 1) / (F.col("to") + size))
    rows = grid.withColumn("a", F.floor(F.col("code") / size).cast("int")).join(by_first, "a").select("code", F.round(ratio, 4).alias("llr")).collect()
    table = [0.0] * (size * size)
    for row in rows:
        table[row["code"]] = row["llr"]
    return table


def score(s: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios of a string's pairs of characters."""
    ratios = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<double>")
    return F.aggregate(pair_codes(s), F.lit(0.0), lambda acc, c: acc + F.get(ratios, c))


#: Matches that are placed one after the other; the places of such runs are then joined, so
#: that the work stays near the number of matches.
PLACED = 256


def spans(text: Column, kind: str, order: int, pattern: str, keep) -> Column:
    """Array of (s, k, e, kind, m) of the matches of pattern for which keep(m) holds."""
    shape = "array<struct<s:int,k:int,e:int,kind:string,m:string>>"

    def some(pairs: Column, at: Column) -> Column:
        """The spans of a few pairs (match, gap before it) from a place on, and the place behind them."""

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            end = start + F.length(p["m"])
            span = F.struct(start.alias("s"), F.lit(order).alias("k"), end.alias("e"), F.lit(kind).alias("kind"), p["m"].alias("m"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).cast(shape).alias("out"))

        return F.aggregate(pairs, F.struct(at.alias("at"), F.array().cast(shape).alias("out")), step)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("gap")))

        def run(pairs: Column) -> Column:
            def step(acc: Column, i: Column) -> Column:
                return let(some(F.slice(pairs, i, F.lit(PLACED)), acc["at"]), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).cast(f"array<{shape}>").alias("out")))

            begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{shape}>").alias("out"))
            return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(pairs), F.lit(PLACED)), begin, step)["out"])

        return F.filter(let(pairs, run), lambda x: keep(x["m"]))

    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(matches, lambda f: F.when(F.size(f) == 0, F.array().cast(shape)).otherwise(placed(f)))


def scan(docs: DataFrame, table: list[float], text: str = "text", base: str = "base_spans", found: str = "spans") -> DataFrame:
    """docs plus two arrays of (s, k, e, kind, m), by start, then kind: the spans of the
    base rules, and all spans.

    A token that a base span covers is not reported again. A null text counts as
    empty; an empty text has empty arrays; rows stay as often as they come; columns
    of docs named like the results give way to them.
    """
    docs = without(docs, [base, found])
    t = text_of(text)

    def enough(pattern: str, group: int, least: int):
        return lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least

    own = F.concat(*[spans(t, kind, k, pattern, enough(pattern, group, least)) for k, (kind, pattern, group, least) in enumerate(BASE)])
    rows = docs.withColumn(base, F.sort_array(own))
    tokens = spans(t, KIND, len(BASE), TOKEN, lambda m: score(m, table) > PRIOR_NATS)
    more = F.filter(tokens, lambda x: ~F.exists(F.col(base), lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"])))
    return rows.withColumn(found, F.sort_array(F.concat(F.col(base), more)))


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = scan(docs, train(labelled(spark, more=words_of_sample(docs))))

    def n(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
