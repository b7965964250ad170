"""Personal data in text: exact base patterns, and further spans that boosted trees select. JVM functions only.

The base finds addresses, IP numbers, cards and phone numbers by fixed patterns and checks. Wider generators propose
overlapping spans with high recall (numbers in groups, addresses written out); gradient-boosted trees score a proposal
by its format (digits, groups, separators, checks) and its context (words and letters around it). They are trained on all
labelled proposals of the corpus and the examples of ``_examples``, by hash one half of both; the other half sets the
threshold at which ``PRECISION`` of what is selected was right. Proposals that look the same to the trees are one row with a
weight, so that the rows of a fit grow with the formats of a corpus, not with its size. Selected proposals that touch no
base span are added. Base spans always stay.

A proposal is labelled right where a base span confirms it or words before it name its kind and its format fits, and
wrong where its format is that of a date, a version, a list or a failed check, or a word for a code stands before it.
What nothing speaks for or against has no label: that the base has missed it says nothing. The marks by which the
base knows a span (``+`` and the prefix after it, ``@``) are hidden from the trees, and grouped or written-out spans are
also shown without their context, so that the trees judge what the base cannot see. Proposals labelled wrong
are never added.

Patterns are possessive and start at the beginning of a run, so that a text of any length is read in linear time. Places
are code points, from the lengths of the matches and of the text between them.

Defined results: a null or empty text has no spans; rows that repeat are searched each for itself; a table
without proposals beyond the base gets base spans alone; columns besides the named ones are left out.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.session import durable

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99
BUCKETS = 20
TREES, DEPTH = 10, 3
BINS, BINNED = 32, 10_000  # places where a feature may be cut, and the rows up to which Spark takes them from all rows with so many
FIT_ROWS = 50_000  # rows of a fit in one task

# Fixed patterns of the base, written possessively: they match what the plain ones match.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
WIDE = (
    ("wide_number", r"(?<![A-Za-z0-9@._-])[+(]?[0-9](?:[\x20().\-/]{0,2}+[0-9])++(?![A-Za-z0-9])", None),
    ("wide_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:(?:\x20\.\x20|\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++", "at"),
)
NEAR_WORDS = {
    "says_mail": "mail|contact|write|kontakt|correo|courriel", "says_phone": "phone|tel|call|fax|mobile|telefon|anruf|llam", "says_card": "card|visa|credit|payment|karte|carte|tarjeta",
    "says_ip": r"\bip\b|server|host|address|client", "says_code": "token|key|secret|id|version|=|isbn|order",
}
FEATURES = ["length", "digits", "groups", "first", "last", "longest", "shortest", "paren", "dots", "hyphens", "spaces", "luhn", "letters", "ending", "letter_before", "letter_after", *NEAR_WORDS]

# Evidence for labels. A word for the kind stands before the match, with no other figure between; a word for a code stands right before it.
NAMED = {
    "phone": r"\b(?:phone|tel|telephone|call|calls|fax|mobile|cell|telefon|anruf|rufen|tel[eé]fono|llame|llamar|appelez)\b[^0-9]*$",
    "card": r"\b(?:card|visa|mastercard|credit|karte|kreditkarte|carte|tarjeta)\b[^0-9]*$",
    "email": r"\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b[^0-9@]*$",
}
CODED = r"(?:\b(?:version|ver|v|release|build|isbn|issn|order|invoice|ticket|serial|token|key|secret|id|ref|number of)\b[\x20.:#=]*|[=#]\x20?)$"
YEAR = "(?:19|20)[0-9]{2}"
DATE = rf"^\(?(?:{YEAR}[-/.\x20]{{1,2}}[01]?[0-9][-/.\x20]{{1,2}}[0-3]?[0-9]|[0-3]?[0-9][-/.\x20]{{1,2}}[0-3]?[0-9][-/.\x20]{{1,2}}{YEAR}|{YEAR}\x20?[-/]\x20?{YEAR})(?:[^0-9].*)?$"


def _digits(m: str) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets(m: str) -> Column:
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|(?<=0))"
    return F.col(m).rlike(rf"^{part}(?:\.{part}){{3}}$")


def _valid(kind: str, m: str) -> Column:
    digits = _digits(m)
    if kind == "ip":
        return _octets(m)
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(F.when(F.length(digits) <= 19, digits).otherwise(""))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _guard(sign: str | None) -> Column:
    some = F.col("_text").rlike("[0-9]") if sign != "@" else F.lit(True)
    if sign == "at":
        return F.contains(F.col("_text"), F.lit("@")) | F.col("_text").rlike(r"[(\[]at[)\]]")
    return some & F.contains(F.col("_text"), F.lit(sign)) if sign else some


def proposals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, doc_id, gen, start, stop, match, before, after, valid``: all matches; a row without ``gen`` for every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    made = rows
    for gen, pattern, sign in BASE + WIDE:
        guard = _guard(sign)
        made = made.withColumn(f"m_{gen}", F.when(guard, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    for gen, pattern, _ in BASE + WIDE:
        made = made.withColumn(f"g_{gen}", F.when(F.size(f"m_{gen}") > 0, F.split("_text", pattern)).otherwise(none))
    every = []
    for gen, _, _ in BASE + WIDE:
        m, g = F.col(f"m_{gen}"), F.col(f"g_{gen}")
        zipped = F.arrays_zip(m.alias("m"), F.slice(g, F.lit(1), F.size(m)).alias("g"), F.slice(g, F.lit(2), F.size(m)).alias("h"))
        every.append(F.transform(zipped, lambda z, i: F.struct(F.lit(gen).alias("gen"), i.alias("k"), F.length(z["g"]).alias("gap"), z["m"].alias("match"), F.right(z["g"], F.lit(32)).alias("before"), F.left(z["h"], F.lit(8)).alias("after"))))
    found = made.select("_row", "doc_id", F.explode_outer(F.concat(*every)).alias("x")).select("_row", "doc_id", "x.*").repartition("_row")
    so_far = Window.partitionBy("_row", "gen").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("match")).over(so_far)
    valid = F.lit(False)
    for gen, _, _ in BASE:
        valid = F.when(F.col("gen") == gen, _valid(gen, "match")).otherwise(valid)
    return found.withColumn("stop", stop).select("_row", "doc_id", "gen", (F.col("stop") - F.length("match")).alias("start"), "stop", "match", "before", "after", valid.alias("valid"))


def _shown(m: str = "match") -> Column:
    """The match without the marks that the base goes by: addresses are all written with ``@`` and ``.``, a number has no ``+``."""
    address = F.regexp_replace(F.regexp_replace(m, r"\x20?(?:@|[(\[]at[)\]])\x20?", "@"), r"\x20\.\x20|\x20?[(\[]dot[)\]]\x20?", ".")
    return F.when(F.col("gen") == "wide_email", address).otherwise(F.regexp_replace(m, r"^\+", ""))


def features(wide: DataFrame) -> DataFrame:
    """``wide`` with ``shown`` (the match as the trees see it) and ``before`` as numbers."""
    m, d = F.col("shown"), _digits("shown")
    sizes = F.transform(F.filter(F.split(m, "[^0-9]+"), lambda x: x != ""), lambda x: F.length(x))
    count = lambda sign: (F.length(m) - F.length(F.replace(m, F.lit(sign), F.lit("")))).cast("double")
    made = wide.withColumn("_sizes", sizes).withColumns(
        {
            "length": F.length(m), "digits": F.length(d), "groups": F.size("_sizes"), "first": F.coalesce(F.get("_sizes", F.lit(0)), F.lit(0)),
            "last": F.coalesce(F.get("_sizes", F.size("_sizes") - 1), F.lit(0)),
            "longest": F.coalesce(F.array_max("_sizes"), F.lit(0)), "shortest": F.coalesce(F.array_min("_sizes"), F.lit(0)), "paren": count("("), "dots": count("."),
            "hyphens": count("-"), "spaces": count(" "), "luhn": _luhn(F.when(F.length(d).between(12, 19), d).otherwise("1")),
            "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "ending": F.length(F.regexp_extract(m, r"\.([A-Za-z]+)$", 1)),
            "letter_before": F.coalesce(F.col("before"), F.lit("")).rlike("[A-Za-z0-9]$"), "letter_after": F.coalesce(F.col("after"), F.lit("")).rlike("^[A-Za-z0-9]"),
            **{name: F.lower(F.coalesce(F.col("before"), F.lit(""))).rlike(words) for name, words in NEAR_WORDS.items()},
        }
    )
    return made.withColumns({c: F.col(c).cast("double") for c in FEATURES}).drop("_sizes")


def labelled(wide: DataFrame) -> DataFrame:
    """``label``: 1 where there is evidence for the proposal, 0 where there is only evidence against it, else null."""
    m, n = F.col("match"), F.length(_digits("match"))
    near = F.lower(F.coalesce("before", F.lit("")))
    number, coded = F.col("gen") == "wide_number", near.rlike(CODED)
    luhn = _luhn(F.when(n.between(12, 19), _digits("match")).otherwise("1"))
    date, parts = m.rlike(DATE), m.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & ~_octets("match")
    figures = (n < 7) | date | parts | ~m.rlike("[0-9][0-9]") | m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3}){2,}+$") | (n > 19) | ((n > 15) & ~luhn)
    ends = _shown().rlike(r"\.[A-Za-z]{2,24}$")
    phone, card = near.rlike(NAMED["phone"]) & n.between(7, 15), near.rlike(NAMED["card"]) & n.between(13, 19) & luhn
    pro = F.when(number, ~figures & ~coded & (phone | card)).otherwise(ends & ~coded & near.rlike(NAMED["email"]))
    # Without its sign a bare run of digits is like any other number: only words or the check digit speak for it.
    bare = number & ~m.rlike(r"[0-9][^0-9]+[0-9]") & ~luhn
    pro = pro | (F.col("touches") & ~(bare & ~near.rlike(NAMED["phone"])))
    con = F.when(number, figures | coded).otherwise(~ends | coded) & ~F.col("touches")
    return wide.withColumn("label", F.when(pro, 1.0).when(con, 0.0))


def _views(known: DataFrame) -> DataFrame:
    """One row per way in which the trees see a labelled proposal: ``shown`` and ``before``."""
    cut = F.regexp_replace("match", r"^\+[0-9]{1,3}[\x20.-]*(?=[\x20.(-])[\x20.-]*", "")
    whole = F.struct(_shown().alias("shown"), F.col("before").alias("before"))
    grouped = (F.col("gen") == "wide_email") | F.col("shown").rlike("[0-9][^0-9]+[0-9]")
    also = F.array(F.struct("shown", F.lit("").alias("before")))
    short = (F.col("gen") == "wide_number") & F.col("match").startswith("+") & (F.length(_digits("match")) <= 15) & (F.length(F.regexp_replace(cut, "[^0-9]", "")) >= 7) & cut.rlike("^[(0-9]")
    local = F.array(F.struct(cut.alias("shown"), F.lit("").alias("before")))
    none = F.array().cast("array<struct<shown:string,before:string>>")
    right = F.col("label") == 1
    ways = F.concat(F.array(whole), F.when(right & grouped, also).otherwise(none), F.when(right & short, local).otherwise(none))
    return known.withColumn("shown", _shown()).withColumn("_w", F.explode(ways)).withColumns({"shown": F.col("_w.shown"), "before": F.col("_w.before")}).drop("_w")


def _examples(spark: SparkSession) -> DataFrame:
    """Formats whose meaning is fixed, with and without context: they teach the trees where a corpus has few labels."""
    rows = []
    for i in range(40):
        a, b, c = 200 + i * 19, 100 + i * 21, 1000 + i * 217
        y, mo, d = 1980 + i, i % 12 + 1, i % 28 + 1
        call, mail = ("", "call ", "tel: ", "reach us: ")[i % 4], ("", "mail ", "contact: ", "hello ")[i % 4]
        user, host = ("joe", "mary.ann", "info", "j_doe7")[i // 4 % 4], ("example", "mail7.example", "uni-x", "acme")[i // 16 % 4]
        rows += [("wide_number", x, call, 1.0) for x in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"0{i % 9 + 1} {a % 90 + 10} {b % 90 + 10} {c % 90 + 10} {d + 10}", f"1 ({a}) {b}-{c}", f"0049 {a} {b}{c}")]
        rows += [("wide_number", f"{a}{b}{c}", "call ", 1.0), ("wide_email", f"{user} (at) {host} (dot) {('com', 'org', 'de', 'net')[i % 4]}", mail, 1.0)]
        other = ("", "on ", "about ", "in ")[i % 4]
        rows += [("wide_number", x, other, 0.0) for x in (f"{a}{b}{c}", f"{y}-{mo:02}-{d:02}", f"{d}.{mo}.{y}", f"{y}-{y + 3}", f"{i}.{i % 7}", f"{i % 9}.{mo}.{d}", f"{i % 99} {i % 8}-{i % 5}", f"{a}", f"{a}.{b}.300.{i}", f"1.{b}.{a}.{b}", f"{a}{b}")]
        rows += [("wide_number", f"{a}{c}{b}{c}{a % 100}", other, 0.0), ("wide_number", f"{a}-{b}-{c}", "order id: ", 0.0), ("wide_email", f"{user} @ {i}.{mo}.{d}", other, 0.0)]
    df = spark.createDataFrame(rows, "gen string, match string, before string, label double")
    return df.select(F.lit("").alias("after"), *df.columns).filter((F.col("label") == 1) | ~_luhn(_digits("match")) | (F.length("match") < 12))


def marked(found: DataFrame) -> DataFrame:
    """``touches``: whether a valid base span of the same document overlaps the row. Windows over one document."""
    base = F.when(F.col("valid"), F.lit(True))
    upto = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("_row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    before, after = F.max(F.when(base, F.col("stop"))).over(upto), F.min(F.when(base, F.col("start"))).over(past)
    return found.withColumn("touches", F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False)))


def counted(known: DataFrame) -> DataFrame:
    """(half, the features, label, weight) of labelled proposals with ``_h``: every way in which the trees see one, and how often."""
    return features(_views(known)).groupBy(F.pmod(F.col("_h"), F.lit(2)).alias("half"), *FEATURES, "label").agg(F.count("*").cast("double").alias("weight"))


def selector(wide: DataFrame):
    """A function that keeps the proposals to add, trained on all labelled rows of ``wide``; None where there is nothing to judge."""
    if wide.filter(~F.col("touches")).isEmpty():
        return None
    columns = ["gen", "match", "before", "after", "label", "_h"]
    known = labelled(wide).filter(F.col("label").isNotNull()).withColumn("_h", F.xxhash64("doc_id", "start", "match")).select(columns)
    seen = durable(counted(known.unionByName(_examples(wide.sparkSession).withColumn("_h", F.xxhash64("before", "match")).select(columns))))
    learnt = seen.filter("half = 0")
    n = learnt.count()
    together = VectorAssembler(inputCols=FEATURES, outputCol="_v")
    # beyond ``BINNED`` rows Spark draws as many as the square of the bins to place them; with a bin per root it draws all
    trees = GBTClassifier(featuresCol="_v", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=7, maxBins=BINS if n <= BINNED else math.isqrt(n) + 1)
    trees = trees.setPredictionCol("_y").setRawPredictionCol("_r").setProbabilityCol("_p")
    model = trees.fit(together.transform(learnt.repartition(n // FIT_ROWS + 1, *FEATURES).sortWithinPartitions(*FEATURES, "label")))

    def scored(df: DataFrame) -> DataFrame:
        return model.transform(together.transform(df)).withColumn("score", vector_to_array("_p")[1])

    bucket = F.least(F.floor(F.col("score") * BUCKETS), F.lit(BUCKETS - 1))
    held = scored(seen.filter("half = 1")).groupBy(bucket.alias("b")).agg(F.sum(F.col("label") * F.col("weight")).alias("right"), F.sum("weight").alias("n"))
    right = n = 0.0
    threshold = 2.0
    for row in sorted(held.collect(), key=lambda r: -r["b"]):  # at most BUCKETS rows
        right, n = right + row["right"], n + row["n"]
        if right / n < PRECISION:
            break
        threshold = row["b"] / BUCKETS
    return lambda df: scored(features(labelled(df).filter(~F.col("label").eqNullSafe(0.0)).withColumn("shown", _shown()))).filter(F.col("score") >= threshold)


def personal_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, kind number, kind, stop, base), in order."""
    found = durable(marked(proposals(docs, doc_id, text)))
    base = found.filter(F.col("gen").isNull() | F.col("valid")).select("_row", "doc_id", F.col("gen").alias("kind"), "start", "stop", F.lit(True).alias("base"))
    wide = found.filter(F.col("gen").isin([g for g, _, _ in WIDE]))
    choose = selector(wide)
    if choose is not None:
        free = choose(wide.filter(~F.col("touches")))
        kind = F.when(F.col("gen") == "wide_email", "email").when((F.col("digits") >= 13) & (F.col("luhn") > 0), "card").otherwise("phone")
        base = base.unionByName(free.select("_row", "doc_id", kind.alias("kind"), "start", "stop", F.lit(False).alias("base")))
    everyone = found.select("_row", "doc_id").distinct().select("_row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"), F.lit(True).alias("base"))
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.when(F.col("kind").isNotNull(), F.struct("start", number.alias("number"), "kind", "stop", "base"))
    return base.unionByName(everyone).groupBy("_row", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans")).drop("_row")


def _of_kind(kind: str):
    return lambda s: s["base"] & (s["kind"] == kind)


def report(docs: DataFrame) -> DataFrame:
    spans = personal_spans(docs)
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
