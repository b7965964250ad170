"""Very long texts, and plans that touch a text once."""

import random
import re

from attestra.llm import decontam, line_dedup
from attestra.session import durable
from tests.llm import plain


def test_line_dedup_of_a_hundred_thousand_lines(spark):
    rng = random.Random(4)
    lines = [f"line {rng.randint(0, 60_000)} of a long text" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "short\n" + lines[0])], "doc_id long, text string")
    got = {r["_row"]["doc_id"]: r for r in line_dedup.deduplicated(docs).collect()}
    kept = list(dict.fromkeys(lines))
    assert got[1]["_text"] == "\n".join(kept) and got[1]["_dropped"] == len(lines) - len(kept) and got[1]["_lines"] == len(lines)
    assert got[2]["_text"] == "short"


def test_lines_do_not_carry_their_text(spark):
    docs = durable(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))
    plan = line_dedup._lines(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    generate = next(x for x in plan.splitlines() if "Generate" in x)
    assert "text#" not in generate and "lines#" in generate


def test_decontamination_cuts_a_text_once(spark):
    words = [f"w{i % 5000}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing here")], "doc_id long, text string")
    items = [(k, " ".join(words[100 * k : 100 * k + 20])) for k in range(50)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found, _ = decontam.matches(docs, bench)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambdafunction\([^\n]*split\(", plan)
    got = sorted(tuple(r) for r in decontam.contamination(docs, bench).collect())
    assert got == sorted(plain.contamination([(1, " ".join(words)), (2, "nothing here")], items))
