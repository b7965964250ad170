"""What references denote, as rows: pieces of text in reading order, and the values they state.

A reference may take in one block or a million. Nothing here gathers the text or the values of a reference: a
piece is one block (or one cell of a saved result), figures meet values by an equi-join on the precision the figure is
written at, and quotes meet pieces by their rarest word. What runs over the end of a piece is found at the seams: a date
or a figure's unit between two neighbours, a quote by following it from piece to piece.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.numbers import UNIT, evidence_numbers, find_dates, is_close, round_half_up, sql_numbers
from attestra.functions.text import collapse, norm_quote
from attestra.operators.refs import TARGET, parsed_refs, resolve
from attestra.scale import pinned, rank_within
from attestra.session import durable

ELLIPSIS = r"(?U)\s*(?:\.\.\.|…|\[\.\.\.\])\s*"  # fixed value: what stands for words left out of a quote


class Evidence(NamedTuple):
    """``refs``: ref, n_blocks, error (null where the reference is good). ``pieces``: ref, pos (from 0), text; blank pieces
    are left out. ``values``: ref, value; with repeats."""

    refs: DataFrame
    pieces: DataFrame
    values: DataFrame


def evidence(refs: DataFrame, docs: DataFrame | None, blocks: DataFrame | None, results: DataFrame, rows: DataFrame) -> Evidence:
    """Evidence of every distinct reference. Without documents every reference to one is reported as such."""
    asked = durable(refs.select("ref").distinct())
    calc, saved, cells = _of_results(asked.filter("ref like 'calc:%'"), results, rows)
    named = asked.filter("ref not like 'calc:%'")
    if docs is None or blocks is None:
        missing = named.select("ref", F.lit(0).cast("long").alias("n_blocks"), F.lit("no index").alias("error"))
        return Evidence(durable(missing.unionByName(calc)), durable(_ranked(saved)), durable(cells))
    p = parsed_refs(named, docs).join(docs.select("doc_id", "title", "path"), "doc_id", "left")
    p = durable(p.withColumn("at", F.coalesce(F.concat(F.lit("#"), "target"), F.lit(""))))
    found = resolve(p.filter("doc_id is not null").select(*TARGET), blocks).select("doc_id", F.coalesce(F.concat(F.lit("#"), "target"), F.lit("")).alias("at"), "seq")
    found = durable(p.select("ref", "doc_id", "at").join(found, ["doc_id", "at"]).select("ref", "doc_id", "seq"))
    sizes = durable(found.groupBy("ref").agg(F.count("*").alias("n_blocks")))
    told = p.join(sizes, "ref", "left")
    error = (
        F.when(~F.col("ok"), F.concat(F.lit("Malformed reference '"), "ref", F.lit("'")))
        .when(F.col("doc_id").isNull(), F.concat(F.lit("Unknown document '"), "doc_key", F.lit("'")))
        .when(F.col("n_blocks").isNull() & F.col("target").isNotNull(), F.concat(F.lit("Anchor '"), "target", F.lit("' not found in "), "doc_id"))
    )
    told = told.select("ref", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), error.alias("error"))
    cited = blocks.select("doc_id", "seq", "text").join(found.select("doc_id", "seq").distinct(), ["doc_id", "seq"], "left_semi")
    cited = pinned(cited, "words", F.split(collapse(F.col("text")), " "))
    cited = durable(cited.filter(F.get("words", F.lit(0)) != "").withColumn("stated", F.array_distinct(evidence_numbers(F.col("text")))))
    one = found.join(sizes.filter("n_blocks = 1"), "ref").select("ref", "doc_id", "seq", F.lit(0).cast("long").alias("pos"))
    many = found.join(sizes.filter("n_blocks > 1"), "ref").join(cited.select("doc_id", "seq"), ["doc_id", "seq"])
    many = rank_within(many.select("ref", "doc_id", "seq"), ["ref"], ["seq"], "rn").select("ref", "doc_id", "seq", (F.col("rn") - 1).alias("pos"))
    many = durable(many)
    placed = one.unionByName(many)
    pieces = placed.join(cited.select("doc_id", "seq", "text"), ["doc_id", "seq"]).select("ref", "pos", "text")
    dated = _dates(F.concat_ws(" ", "title", F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?<=.)\.[^.]*$", "")))
    values = _values(placed, many, cited).unionByName(p.select("ref", F.explode(dated).alias("value")))
    return Evidence(durable(told.unionByName(calc)), durable(pieces.unionByName(_ranked(saved))), durable(values.unionByName(cells)))


def _dates(c: Column) -> Column:
    return F.transform(find_dates(c), lambda d: d["value"])


def _values(placed: DataFrame, many: DataFrame, cited: DataFrame) -> DataFrame:
    """(ref, value): what the blocks state by themselves, and what stands across the end of one.

    Only two things do: a unit that begins the next block changes the last figure of this one, and a date, which has three
    words, may begin in the last two words of a block, or have a block of one word in its middle.
    """
    n = F.size("words")
    last = lambda k: F.array_join(F.slice("words", F.greatest(n - k + 1, F.lit(1)), F.least(n, F.lit(k))), " ")
    edges = cited.select(
        "doc_id", "seq", F.get("words", F.lit(0)).alias("first"), F.array_join(F.slice("words", 1, 2), " ").alias("head"), last(1).alias("end"), last(2).alias("tail"),
        (n == 1).alias("single"), F.col("text").rlike(r"(?U)\d$").alias("open"), F.regexp_extract("text", UNIT, 1).alias("unit"),
    )
    here = durable(many.join(edges, ["doc_id", "seq"]))
    after = here.select("ref", (F.col("pos") - 1).alias("pos"), F.col("first").alias("next_first"), F.col("head").alias("next_head"), F.col("unit").alias("next_unit"))
    before = here.filter(F.col("end").rlike(r"(?U)\d|\p{L}{3}")).select("ref", (F.col("pos") + 1).alias("pos"), F.col("end").alias("last_end"))
    seams = here.join(after, ["ref", "pos"]).join(before, ["ref", "pos"], "left")
    seams = durable(seams.select("ref", "doc_id", "seq", "pos", F.when(F.col("open") & (F.col("next_unit") != ""), F.col("next_unit")).alias("unit"), "tail", "next_head", F.when(F.col("single"), F.concat_ws(" ", "last_end", "first", "next_first")).alias("across")))
    dates = seams.select("ref", F.explode(F.concat(_dates(F.concat_ws(" ", "tail", "next_head")), _dates(F.coalesce("across", F.lit(""))))).alias("value"))
    changed = seams.filter("unit is not null").select("ref", "doc_id", "seq", "unit")
    longer = changed.join(cited.select("doc_id", "seq", "text"), ["doc_id", "seq"])
    longer = longer.select("ref", F.explode(evidence_numbers(F.concat("text", F.lit("\n"), "unit"))).alias("value"))
    own = placed.join(changed.select("ref", "doc_id", "seq"), ["ref", "doc_id", "seq"], "left_anti").join(cited.select("doc_id", "seq", "stated"), ["doc_id", "seq"])
    return own.select("ref", F.explode("stated").alias("value")).unionByName(dates).unionByName(longer)


def _of_results(asked: DataFrame, results: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References ``calc:N``: the table of references, pieces to be ranked (query, column names, text cells), and values.

    Booleans are no figures; number literals of the query are. A saved result may have any number of rows.
    """
    r = asked.select("ref", F.regexp_extract("ref", r"^calc:(\d+)$", 1).try_cast("int").alias("result_id"))
    known = durable(r.join(results.select("result_id", "sql", "columns"), "result_id", "left"))
    told = known.select("ref", F.lit(0).cast("long").alias("n_blocks"), F.when(F.col("sql").isNull(), F.concat("ref", F.lit(" not found"))).alias("error"))
    each = rows.join(known.filter("sql is not null").select("ref", "result_id"), "result_id").select(
        "ref", "row_no", F.posexplode(F.map_values(F.from_json("row_json", "map<string,variant>"))).alias("c", "x")
    )
    kind, text = F.schema_of_variant("x"), F.expr("cast(x as string)")
    each = each.select("ref", F.col("row_no").cast("long").alias("a"), F.col("c").cast("long").alias("b"), kind.alias("kind"), text.alias("v"))
    each = each.filter("v is not null and kind <> 'BOOLEAN'")
    worded = F.col("kind") == "STRING"
    head = [F.array(F.lit(-2), F.lit(-1)), F.array(F.col("sql"), F.array_join("columns", " "))]
    heads = known.filter("sql is not null").select("ref", F.explode(F.arrays_zip(head[0].alias("a"), head[1].alias("t"))).alias("h"))
    heads = heads.select("ref", F.col("h.a").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("h.t").alias("text"))
    pieces = heads.unionByName(each.filter(worded).select("ref", "a", "b", F.concat(F.lit("| "), "v").alias("text")))
    values = each.select("ref", F.explode(F.when(worded, evidence_numbers(F.col("v"))).otherwise(F.array(F.col("v").try_cast("double")))).alias("value"))
    literals = known.filter("sql is not null").select("ref", F.explode(sql_numbers(F.col("sql"))).alias("value"))
    return told, pieces.filter(collapse(F.col("text")) != ""), values.unionByName(literals)


def _ranked(pieces: DataFrame) -> DataFrame:
    return rank_within(pieces, ["ref"], ["a", "b"], "rn").select("ref", (F.col("rn") - 1).alias("pos"), "text")


# --- figures ----------------------------------------------------------------------------------------------

FIGURE_KEY = ["value", "decimals", "is_percent", "trailing_zeros", "approx"]
NEAR = 1e-8  # width of a bucket of logarithms; values that count as equal are within a tenth of it
TINY = 1e-11  # width of a bucket of values near zero


def _near(x: Column) -> Column:
    """Bucket of the logarithm, negative numbers apart; null near zero."""
    bucket = F.floor(F.log(F.abs(x)) / NEAR) + F.when(x < 0, 0.5).otherwise(0.0)
    return F.when(F.abs(x) >= 5e-4, bucket)


def _tiny(x: Column) -> Column:
    return F.when(F.abs(x) <= 2e-3, F.floor(x / TINY).cast("double"))


def _probes(value: Column, decimals: Column, zeros: Column) -> list[Column]:
    """What a value must equal, in one of the forms that :func:`_keyed` gives to evidence."""

    def probe(form: str, digits: Column, key: Column) -> Column:
        return F.struct(F.lit(form).alias("form"), digits.cast("int").alias("digits"), key.cast("double").alias("key"), value.alias("target"))

    none = F.lit(0)
    step = F.pow(F.lit(10.0), zeros)
    out = [probe("near", none, _near(value * (1 + side * 2e-9))) for side in (-1, 1)]
    out += [probe("tiny", none, _tiny(value + side * 2e-12)) for side in (-1, 1)]
    out.append(probe("written", decimals, round_half_up(value, decimals)))
    out.append(probe("coarse", zeros, F.when(zeros > 0, F.bround(value / step, 0) * step)))
    return out


def figures_found(claims: DataFrame, values: DataFrame) -> DataFrame:
    """The distinct claims (ref and a figure's parts) that a value of their reference states at the precision written.

    The rule is that of ``numbers_match``. Evidence is rounded at the precisions that figures about its reference are
    written at (a few dozen at most), and rounded values meet by an equi-join; equality but for floating point noise is
    bucketed. What meets is compared exactly.
    """
    claims = durable(claims.select("ref", *FIGURE_KEY).distinct())
    zeros = F.when(F.col("approx"), F.col("trailing_zeros")).otherwise(0)
    plain = F.array(*_probes(F.col("value"), F.col("decimals"), zeros))
    fraction = F.array(*_probes(F.col("value") / 100.0, F.col("decimals") + 2, F.lit(0)))
    probes = claims.select("ref", *FIGURE_KEY, F.explode(F.array_distinct(F.when(F.col("is_percent"), F.concat(plain, fraction)).otherwise(plain))).alias("p"))
    probes = durable(probes.select("ref", *FIGURE_KEY, "p.*").filter("key is not null"))
    forms = probes.select("ref", "form", "digits").distinct().groupBy("ref").agg(F.collect_set(F.struct("form", "digits")).alias("forms"))
    keyed = values.filter(F.abs("value") < float("inf")).join(forms, "ref").select("ref", "value", F.explode("forms").alias("f"))
    form, digits, x = F.col("f.form"), F.col("f.digits"), F.col("value")
    step = F.pow(F.lit(10.0), digits)
    key = F.when(form == "near", _near(x)).when(form == "tiny", _tiny(x)).when(form == "written", round_half_up(x, digits)).otherwise(F.bround(x / step, 0) * step)
    exact = F.when(form.isin("near", "tiny"), x)
    keyed = keyed.select("ref", form.alias("form"), digits.alias("digits"), key.cast("double").alias("key"), exact.alias("found")).filter("key is not null").distinct()
    met = probes.join(keyed, ["ref", "form", "digits", "key"])
    gap = F.abs(F.col("key") - F.col("target"))
    true = F.when(F.col("found").isNotNull(), is_close(F.col("target"), F.col("found"))).when(F.col("form") == "written", gap < F.pow(F.lit(10.0), -F.col("digits")) / 1000).otherwise(gap < 1e-9)
    return met.filter(true).select("ref", *FIGURE_KEY).distinct()


# --- quotes -----------------------------------------------------------------------------------------------

GRAM = 3  # characters of a key for parts without a whole word inside
FEW = 10_000  # keys of a reference that are sent to its pieces; more are met by a join


def quotes_found(quoted: DataFrame, pieces: DataFrame) -> DataFrame:
    """(ref, quote, found) of the distinct quotes (ref, quote): whether their parts (around ellipses) stand in the pieces
    of the reference in order, whatever case, white space and marks they are written with, and across the ends of pieces.

    A part is looked for in the pieces that hold its rarest word (or, if it has no word that must be whole, its rarest
    three characters), and where a piece ends with its beginning. Part after part, each quote keeps the earliest place where
    the part can end; that is one aggregate per part, of quotes that are still alive.
    """
    quoted = durable(quoted.select("ref", "quote").distinct())
    cut = F.transform(F.split("quote", ELLIPSIS), lambda p: F.btrim(norm_quote(p), F.lit(" .,;:")))
    parts = quoted.select("ref", "quote", F.posexplode(F.filter(cut, lambda p: p != "")).alias("i", "part"))
    parts = durable(parts)
    asked = durable(parts.select("ref", "part", F.split("part", " ").alias("words")).distinct())
    held = pieces.join(asked.select("ref").distinct(), "ref", "left_semi").select("ref", "pos", norm_quote(F.col("text")).alias("t"))
    held = durable(held.filter("t <> ''"))
    places = durable(_inside(asked, held))
    across = durable(_across(asked, held))
    n = parts.agg(F.max("i")).first()[0]
    state = quoted.select("ref", "quote", F.struct(F.lit(0).cast("long").alias("pos"), F.lit(1).alias("at")).alias("after"))
    counts = parts.groupBy("ref", "quote").agg(F.count("*").alias("n"))
    done = []
    for i in range((n if n is not None else -1) + 1):
        if i:
            done.append(state.join(counts.filter(F.col("n") == i), ["ref", "quote"]).select("ref", "quote"))
        now = state.join(parts.filter(F.col("i") == i), ["ref", "quote"])
        here = now.join(places, ["ref", "part"]).filter(F.col("pos") >= F.col("after.pos"))
        start = F.position("part", "t", F.when(F.col("pos") == F.col("after.pos"), F.col("after.at")).otherwise(1))
        here = here.select("ref", "quote", "part", "pos", start.alias("at")).filter("at > 0")
        here = here.select("ref", "quote", F.struct("pos", "at").alias("begin"), F.struct("pos", (F.col("at") + F.length("part")).alias("at")).alias("after"))
        over = now.join(across, ["ref", "part"]).filter(F.col("begin") >= F.col("after")).select("ref", "quote", "begin", F.col("end").alias("after"))
        state = durable(here.unionByName(over).groupBy("ref", "quote").agg(F.min(F.struct("begin", "after"))["after"].alias("after")))
    alive = state if n is not None else quoted.limit(0)
    if n is not None:
        alive = alive.join(counts.filter(F.col("n") == n + 1), ["ref", "quote"]).select("ref", "quote")
        for d in done:
            alive = alive.unionByName(d)
    bare = quoted.join(counts, ["ref", "quote"], "left_anti")  # nothing but marks: nothing to look for
    good = alive.select("ref", "quote").unionByName(bare.select("ref", "quote")).withColumn("found", F.lit(True))
    return quoted.join(good, ["ref", "quote"], "left").select("ref", "quote", F.coalesce("found", F.lit(False)).alias("found"))


def _grams(c: Column, size: int) -> Column:
    return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))


def _keyed_pieces(held: DataFrame, wanted: DataFrame, sizes: DataFrame, keys: Column, kept: list[str]) -> DataFrame:
    """``kept`` and ``key``: pieces with each of their keys that is wanted of their reference (ref, key).

    The wanted keys of a reference go to its pieces, and only those found leave them: a piece has a key for every character.
    Where a reference is asked for more than ``FEW``, the keys of its pieces meet them by a join.
    """
    each = durable(wanted.select("ref", "key").distinct())
    n = durable(each.groupBy("ref").agg(F.count("*").alias("n")).join(sizes, "ref"))
    few = each.join(n.filter(F.col("n") <= FEW).select("ref"), "ref", "left_semi").groupBy("ref").agg(F.collect_list("key").alias("_wanted")).join(n, "ref")
    out = held.join(few, "ref").select(*kept, F.explode(F.array_intersect(keys, F.col("_wanted"))).alias("key"))
    more = n.filter(F.col("n") > FEW)
    if more.isEmpty():
        return out
    return out.unionByName(held.join(more, "ref").select(*kept, F.explode(F.array_distinct(keys)).alias("key")).join(each, ["ref", "key"], "left_semi"))


def _inside(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(ref, part, pos, t): pieces that hold the whole part."""
    n = F.size("words")
    size = F.least(F.length("part"), F.lit(GRAM))
    inner = F.transform(F.slice("words", F.lit(2), F.greatest(n - 2, F.lit(0))), lambda w: F.concat(F.lit("w"), w))
    grams = F.when(size == 1, _grams(F.col("part"), 1)).when(size == 2, _grams(F.col("part"), 2)).otherwise(_grams(F.col("part"), 3))
    keys = F.when(n > 2, inner).otherwise(F.transform(grams, lambda g: F.concat(F.lit("g"), g)))
    wanted = durable(asked.select("ref", "part", F.explode(F.array_distinct(keys)).alias("key")))
    sizes = wanted.groupBy("ref").agg(F.collect_set(F.when(F.substring("key", 1, 1) == "g", F.length("key") - 1)).alias("sizes"))
    own = F.transform(F.split("t", " "), lambda w: F.concat(F.lit("w"), w))
    some = lambda k: F.when(F.array_contains("sizes", k), F.transform(_grams(F.col("t"), k), lambda g: F.concat(F.lit("g"), g))).otherwise(F.array().cast("array<string>"))
    postings = durable(_keyed_pieces(held, wanted, sizes, F.concat(own, *(some(k) for k in range(1, GRAM + 1))), ["ref", "pos"]))
    often = postings.groupBy("ref", "key").agg(F.count("*").alias("often"))
    rarest = wanted.join(often, ["ref", "key"], "left").groupBy("ref", "part").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "key")).alias("r"))
    rarest = rarest.filter("r.often > 0").select("ref", "part", F.col("r.key").alias("key"))
    return rarest.join(postings, ["ref", "key"]).select("ref", "part", "pos").join(held, ["ref", "pos"]).filter(F.col("t").contains(F.col("part"))).select("ref", "part", "pos", "t")


def _across(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(ref, part, begin, end): places of parts that run over the end of a piece, each struct(pos, at).

    A piece may end with the first i words of a part, the first of them cut at its front. Its last word is then the
    i-th word, or ends with the first one: both are keys of an equi-join. What is left must begin the next piece, or hold the
    whole of it and go on in the one after; a part of k words ends after k pieces at most.
    """
    long = asked.filter(F.size("words") > 1)
    first = F.get("words", F.lit(0))
    sizes = long.groupBy("ref").agg(F.collect_set(F.length(first)).alias("sizes"))
    splits = long.select("ref", "part", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("i"))
    key = F.when(F.col("i") == 1, F.concat(F.lit("e"), first)).otherwise(F.concat(F.lit("w"), F.element_at("words", F.col("i"))))
    splits = splits.select("ref", "part", key.alias("key"), F.array_join(F.slice("words", F.lit(1), F.col("i")), " ").alias("start"))
    last = F.substring_index("t", " ", -1)
    ends = F.transform(F.filter("sizes", lambda k: k <= F.length(last)), lambda k: F.concat(F.lit("e"), F.right(last, k)))
    splits = durable(splits)
    tails = _keyed_pieces(held, splits, sizes, F.concat(ends, F.array(F.concat(F.lit("w"), last))), ["ref", "pos", "t"])
    met = tails.join(splits, ["ref", "key"]).filter(F.col("t").endswith(F.col("start")))
    begin = F.struct("pos", (F.length("t") - F.length("start") + 1).alias("at"))
    open_ = met.select("ref", "part", begin.alias("begin"), (F.col("pos") + 1).alias("pos"), F.expr("substring(part, length(start) + 2)").alias("rest"))
    out = None
    while True:
        on = durable(open_.join(held, ["ref", "pos"]))
        end = F.struct("pos", (F.length("rest") + 1).alias("at"))
        found = on.filter(F.col("t").startswith(F.col("rest"))).select("ref", "part", "begin", end.alias("end"))
        out = found if out is None else out.unionByName(found)
        open_ = on.filter(F.col("rest").startswith(F.concat("t", F.lit(" ")))).select("ref", "part", "begin", (F.col("pos") + 1).alias("pos"), F.expr("substring(rest, length(t) + 2)").alias("rest"))
        if open_.isEmpty():
            return out
